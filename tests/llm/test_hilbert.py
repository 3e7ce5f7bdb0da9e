import itertools
import zlib

import numpy as np
import pytest
from texts import documents, frame

from pyspark.sql import functions as F

from tidemark.llm import hilbert, queries


@pytest.mark.parametrize(("dimensions", "bits"), [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_every_cell_and_moves_by_one(dimensions, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dimensions)))
    index = hilbert.curve_index(cells, bits)
    assert sorted(index) == list(range(len(cells)))
    steps = np.abs(np.diff(cells[np.argsort(index)], axis=0)).sum(axis=1)
    assert set(steps) == {1}


def sharded(spark, rows, shards):
    docs = frame(spark, rows).select("doc_id", F.length("text").alias("size"), "source", "lang", F.col("curve").alias("other"))
    return hilbert.cut(hilbert.ordered(docs, logarithms=["size"], ranges=["doc_id"], names=["source", "lang"]), shards, order_by=["curve", "doc_id"])


@pytest.mark.parametrize("shards", [1, 7, 40, 500])
def test_counts_differ_by_one_at_most_and_slots_have_no_gaps(spark, shards):
    rows = sharded(spark, documents(), shards).collect()
    assert len(rows) == len(documents())
    held = [sorted(r["slot"] for r in rows if r["shard"] == k) for k in range(shards)]
    assert max(map(len, held)) - min(map(len, held)) <= 1
    assert all(slots == list(range(len(slots))) for slots in held)


def test_empty_table(spark):
    assert sharded(spark, [], 40).count() == 0


def test_shards_cover_narrow_ranges_of_every_dimension(spark):
    rows = [(k, "x" * (1 + k * 7919 % 4000), "aa", f"s{k * 31 % 20:02d}", 0) for k in range(4000)]
    found = sharded(spark, rows, 64).groupBy("shard").agg(F.countDistinct("source").alias("sources"), (F.max("doc_id") - F.min("doc_id")).alias("ids")).collect()
    assert np.mean([r["sources"] for r in found]) < 12
    assert np.mean([r["ids"] for r in found]) < 3000


def test_the_query_agrees_with_a_plain_count(spark):
    folder = "/root/testdata/sf0.001"
    (query,) = [q for name, q in queries.QUERIES.items() if name.startswith("op7_")]
    rows = query(spark, folder).collect()
    texts = [(r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    expected = sorted((doc_id, len(text) + 16, zlib.crc32(text)) for doc_id, text in texts)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == expected
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}
    held = {k: sorted(r["slot"] for r in rows if r["shard"] == k) for k in range(40)}
    assert sum(map(len, held.values())) == len(texts)
    assert max(map(len, held.values())) - min(map(len, held.values())) <= 1
    assert all(slots == list(range(len(slots))) for slots in held.values())
