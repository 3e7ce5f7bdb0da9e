import re
from collections import defaultdict

import pytest
from texts import documents, frame

from tidemark.llm import curriculum

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, demand=1.5, most=2.0):
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sizes)}
    target, left, open_ = {}, demand * sum(sizes.values()), set(sizes)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def mixed(spark, rows=None):
    return curriculum.mix(curriculum.sizes(frame(spark, rows)))


def test_takes_meet_targets_and_no_document_comes_too_often(spark):
    rows = mixed(spark).collect()
    assert len(rows) == len(documents())
    names = sorted({r["source"] for r in rows if r["source"] is not None}) + [None]
    sizes = {s: sum(len(WORD.findall(d[1] or "")) for d in documents() if d[3] == s) for s in names}
    targets, taken = plain_targets(sizes), defaultdict(int)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(targets[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in names:
        assert abs(taken[s] - targets[s]) <= 1


def test_positions_follow_the_schedule_and_the_order(spark):
    placed = curriculum.positions(mixed(spark))
    rows = curriculum.curriculum(placed).collect()
    assert [r["position"] for r in rows] == sorted(r["position"] for r in rows)
    assert all(0 <= r["position"] <= 1 and r["words"] > 0 for r in rows)
    assert sum(r["words"] for r in rows) == sum(r["taken"] for r in mixed(spark).collect())


def test_a_falling_schedule_puts_words_early(spark):
    rows = [(k, "a b c d", "x", s, 0) for k, s in enumerate(["s1", "s2"] * 200)]
    placed = curriculum.curriculum(curriculum.positions(mixed(spark, rows), slopes=(-0.9, 0.9))).collect()
    early = [r["source"] for r in placed if r["position"] < 0.3]
    assert early.count("s1") > 2 * early.count("s2")


def test_reruns_agree(spark):
    assert sorted(map(repr, mixed(spark).collect())) == sorted(map(repr, mixed(spark).collect()))


def test_texts_are_cut_after_whole_words(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(" a  b\tc d ", 2, 4), ("a b", 2, 2)], "text string, words bigint, size bigint")
    cut = df.select(curriculum.cut_text(F.col("text"), F.col("words"), F.col("size")).alias("t"))
    assert [r["t"] for r in cut.collect()] == [" a  b", "a b"]


def test_empty_tables_and_texts(spark):
    assert mixed(spark, []).count() == 0
    rows = mixed(spark, [(1, None, "aa", "s1", 0), (2, " ", "aa", None, 0)]).collect()
    assert {(r["size"], r["taken"]) for r in rows} == {(0, 0)}
