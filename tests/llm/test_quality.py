"""Learnt quality: held-out accuracy, trees walked one by one, every kind of odd row."""

import math

import numpy as np
import pytest

from texts import frame, prose
from tidemark.llm import quality
from tidemark.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    scored = QUERIES["op11_quality"](spark, SF_DIR)
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert scored.count() == docs.count()
    rows = [r for r in scored.join(labels, "doc_id").collect() if r["held_out"]]
    assert len(rows) > 40
    right = sum(r["predicted"] == r["quality"] for r in rows) / len(rows)
    assert right >= 0.95
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = [r["score"] for r in rows if r["quality"] == 0]
    ahead = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert ahead >= 0.97


def _walked(model, row):
    total = model.base
    inner = model.feature.shape[1]
    for tree in range(len(model.feature)):
        at = 0
        while at < inner:
            at = 2 * at + (2 if row[model.feature[tree, at]] > model.threshold[tree, at] else 1)
        total += model.leaf[tree, at - inner]
    return 1 / (1 + math.exp(-total))


def test_traversal_equals_a_walk_of_every_tree():
    rng = np.random.default_rng(3)
    values = rng.standard_normal((400, 5)).round(1)
    labels = ((values[:, 0] > 0) ^ (values[:, 3] > 0.5)).astype(np.int64)
    model = quality.fit(values, labels, np.ones(400))
    assert np.allclose(model.score(values), [_walked(model, r) for r in values])
    assert ((model.score(values) > 0.5) == labels).mean() > 0.97
    assert model.feature.shape == (quality.TREES, 2**quality.DEPTH - 1)


def test_first_split_is_the_best_of_all_splits():
    """The root of the first tree against every statistic and threshold tried one by one."""
    rng = np.random.default_rng(8)
    values = rng.integers(0, 9, (120, 4)).astype(float)
    labels = (values[:, 2] + rng.integers(0, 3, 120) > 5).astype(np.int64)
    model = quality.fit(values, labels, np.ones(120))
    share = labels.mean()
    g, h = share - labels, np.full(120, share * (1 - share))

    def gain(f, t):
        side = values[:, f] > t
        parts = [g[s].sum() ** 2 / (h[s].sum() + quality.SMOOTHING) for s in (side, ~side)]
        return sum(parts) if min(h[side].sum(), h[~side].sum()) >= quality.LEAST_WEIGHT / 4 else -1

    best = max(gain(f, t) for f in range(4) for t in range(9))
    assert gain(model.feature[0, 0], model.threshold[0, 0]) == pytest.approx(best)


def test_statistics_are_of_the_whole_text():
    names = quality.STATISTICS
    assert quality.statistics("") == [0.0] * len(names)
    got = dict(zip(names, quality.statistics("Ab ab ab. x## 12\n\nAb ab ab. x## 12"), strict=True))
    assert got["words"] == math.log1p(10)
    assert got["lines"] == math.log1p(2)
    assert got["different_lines"] == 0.5
    assert got["same_as_before"] == 0.0
    assert got["marked_words"] == 0.2
    assert got["commonest_word"] == 0.2
    assert got["longest_word"] == math.log1p(3)
    long = "word " * 500_000
    tail = dict(zip(names, quality.statistics(long + "$$$"), strict=True))
    assert tail["symbols"] > 0
    assert tail["same_as_before"] > 0.99


def _labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int, text string")


def test_odd_rows_and_labels(spark):
    docs = frame(spark)
    labels = _labels(spark, [(None, 1, 0, "?"), (5, 0, 0, "?"), (5, 1, 0, "?"), (6, None, 0, "?"), (7, 7, 0, "?"), (20, 1, 0, "?"), (999, 0, 0, "?")] + [(100 + k, k % 2, 0, "?") for k in range(60)])
    model = quality.learn(docs, labels)
    got = quality.predict(docs, model, carry=("source",)).collect()
    assert len(got) == docs.count()
    assert all(0 <= r["score"] <= 1 for r in got)
    same = {r["score"] for r in got if r["doc_id"] == 20}
    assert len(same) == 1
    empty = {r["doc_id"]: r["score"] for r in got}
    assert empty[0] == empty[1]  # NULL is empty
    assert quality.predict(docs.limit(0), model).count() == 0


@pytest.mark.parametrize(("rows", "score"), [([], 0.5), ([(3, 1, 0, "")], 1.0), ([(3, 0, 0, "")], 0.0)])
def test_one_kind_of_label_or_none(spark, rows, score):
    docs = frame(spark)
    model = quality.learn(docs, _labels(spark, rows))
    got = quality.predict(docs, model).collect()
    assert all(abs(r["score"] - score) < 0.01 for r in got)


def test_an_id_of_many_rows_does_not_outgrow_the_sample(spark):
    rows = [(1, f"w{k} some words", "aa", "s", 0) for k in range(900)] + [(k, prose_of(k), "aa", "s", 0) for k in range(2, 300)]
    labels = _labels(spark, [(1, 1, 0, "")] + [(k, 0, 0, "") for k in range(2, 300)])
    model = quality.learn(frame(spark, rows), labels, sample=100)
    assert len(model.feature) == quality.TREES


def prose_of(k):
    import random

    return prose(random.Random(k), 12)
