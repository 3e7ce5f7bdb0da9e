import hashlib
import random

import numpy as np
import pytest
from texts import documents, frame, prose

from pyspark.sql import functions as F

from tidemark.llm import sketch


@pytest.mark.parametrize("range_rows", [5, 1000])
def test_edited_texts_and_fingerprints(spark, monkeypatch, range_rows):
    monkeypatch.setattr(sketch, "RANGE_ROWS", range_rows)
    rows = [r for r in documents() if r[0] is not None and r[0] != 20]
    found = {r["doc_id"]: r for r in sketch.fingerprints(frame(spark, rows)).collect()}
    ordered = sorted(rows)
    for k, (doc_id, text, *_) in enumerate(ordered):
        text, following = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        row = found[doc_id]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1
        if edited == text:
            assert row["near_edited"] == 1 and row["fingerprint"] == row["edited_fingerprint"]
        if following == text:
            assert row["near_next"] == 1
    assert found[6]["fingerprint"] == found[7]["fingerprint"] != found[5]["fingerprint"]


def test_repeated_rows_missing_ids_and_empty_tables(spark):
    assert sketch.fingerprints(frame(spark)).count() == len(documents())
    assert sketch.fingerprints(frame(spark, [])).count() == 0
    alone = sketch.fingerprints(frame(spark, [(1, "a b c d e f", "aa", "s", 0)])).first()
    assert alone["near_next"] == 1


def test_containment_of_unequal_texts_and_merging(spark):
    rng = random.Random(9)
    part, rest = prose(rng, 3000), prose(rng, 9000)
    df = spark.createDataFrame([(part, rest, f"{part} {rest}")], "a string, b string, both string")
    for name in ("a", "b", "both"):
        df = sketch.with_sketch(df, name, f"s_{name}")
    row = df.select(
        sketch.likeness(F.col("s_a"), F.col("s_both")).alias("inside"),
        sketch.likeness(F.col("s_a"), F.col("s_b")).alias("apart"),
        F.size(F.array_except(sketch.merged(F.col("s_a"), F.col("s_b")), "s_both")).alias("lost"),
        F.size(F.array_except("s_both", sketch.merged(F.col("s_a"), F.col("s_b")))).alias("border"),
    ).first()
    assert row["inside"] == pytest.approx(1, abs=0.01) and row["apart"] < 0.05
    assert row["lost"] == 0 and row["border"] <= 4


def test_likeness_is_close_to_the_true_share(spark):
    rows = [r for r in documents() if r[0] is not None and r[0] >= 100]
    errors = []
    ordered = sorted(rows)
    found = {r["doc_id"]: r for r in sketch.fingerprints(frame(spark, rows)).collect()}
    for k, (doc_id, text, *_) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        half = len(text) // 2
        sets = []
        for t in (text, text[: len(text) - half] + following[:half]):
            w = t.split()
            sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
        errors.append(found[doc_id]["near_edited"] - len(sets[0] & sets[1]) / min(map(len, sets)))
    assert np.mean(np.abs(errors)) < 0.2


def test_no_python_in_the_plan(spark):
    plan = sketch.fingerprints(frame(spark).repartition(2))._jdf.queryExecution().toString()
    assert "Python" not in plan and "mapInArrow" not in plan
