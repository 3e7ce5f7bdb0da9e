import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from tidemark.llm import balltree


def plain(rows, k):
    good = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max(len(v) for _, v in good)
    good = [(i, np.pad(v, (0, width - len(v)))) for i, v in good]
    out = []
    for at, (i, q) in enumerate(good):
        if i % 50 == 0:
            ranked = sorted((-int(q @ v), j) for other, (j, v) in enumerate(good) if other != at)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("shard_bytes", [2500, 1 << 20])
def test_same_as_all_products(spark, shard_bytes):
    rng = random.Random(3)
    rows = [(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(600)]
    rows += [(1000 + k, rows[50][1]) for k in range(200)]  # one vector many times: ties go to the smaller id
    rows += [(100, rows[7][1])] * 3 + [(50, rows[9][1]), (3, rows[9][1])]  # rows that share an id
    rows += [(2000, None), (2050, [1.0, None]), (2100, [float("nan"), 1.0]), (2150, [float("inf")]), (None, [1.0]), (2200, []), (2250, [1.0, 2.0]), (2300, [1e6] * 8)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("shard", F.lit("clash"))
    found = balltree.top_k(df, F.col("vec_id") % 50 == 0, k=5, shard_bytes=shard_bytes).collect()
    assert sorted(tuple(r) for r in found) == plain(rows, 5)


def test_rows_of_one_id_are_queries_and_candidates_each_for_itself(spark):
    df = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [0.5])], "vec_id bigint, embedding array<double>")
    found = sorted(tuple(r) for r in balltree.top_k(df, F.col("vec_id") % 50 == 0).collect())
    assert found == [(0, 1, 0, 65536), (0, 1, 0, 65536), (0, 2, 1, 32768), (0, 2, 1, 32768)]


def test_a_third_of_rows_under_one_id(spark):
    rng = random.Random(8)
    rows = [(7, [1.0, -2.0, 3.0])] * 400 + [(k, [rng.gauss(0, 1) for _ in range(3)]) for k in range(800)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert sorted(tuple(r) for r in balltree.top_k(df, F.col("vec_id") % 50 == 0, shard_bytes=1000).collect()) == plain(rows, 5)
    laid = balltree._laid_out(df.withColumn("row", F.monotonically_increasing_id()).select("row", "vec_id", "embedding"), 24)
    sizes = sorted(r["count"] for r in laid.groupBy("shard").count().collect())
    assert sum(sizes) == 1200 and sizes[-1] < 3 * 1200 / 24


def test_queries_go_only_to_shards_that_can_matter(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(16, 12)) * 20
    vectors = np.repeat(centres, 60, axis=0) + rng.normal(size=(960, 12)) * 0.05
    df = spark.createDataFrame([(k, k, v.tolist()) for k, v in enumerate(vectors)], "row bigint, vec_id bigint, embedding array<double>")
    rows = balltree._laid_out(df, 16)
    floors = {k: sorted((int(np.floor(256 * v) @ np.floor(256 * w)) for w in vectors), reverse=True)[5] for k, v in enumerate(vectors) if k % 50 == 0}
    asked = spark.createDataFrame([(k, vectors[k].tolist(), f, -1) for k, f in floors.items()], "query bigint, embedding array<double>, floor bigint, first int")
    assert 0 < balltree.reached(balltree._balls(rows), asked, 2).count() < len(floors) * 16 / 2


def test_fewer_candidates_than_asked_for_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id bigint, embedding array<double>")
    assert [tuple(r) for r in balltree.top_k(df, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, 256 * 512)]
    assert balltree.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_prune():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 16)) * 2000
    vectors = np.floor(np.repeat(centres, 200, axis=0) + rng.normal(size=(4000, 16)) * 10)
    tree = balltree.BallTree(np.arange(4000), np.arange(4000), vectors)
    seen = []
    products = balltree._products
    balltree._products = lambda q, v: seen.append(len(q) * len(v)) or products(q, v)
    try:
        tree.search(np.arange(10), vectors[:10], np.full(10, balltree._NONE), 5)
    finally:
        balltree._products = products
    assert sum(seen) < 10 * 4000 / 4
