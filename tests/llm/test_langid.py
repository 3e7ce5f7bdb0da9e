import numpy as np
from texts import documents, frame

from pyspark.sql import functions as F

from tidemark.llm import langid

SF_DIR = "/root/testdata/sf0.01"


def test_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    held = langid.held_out(F.col("doc_id"))
    model = langid.learn(docs.filter(~held), per_language=100)
    rows = langid.predict(docs.filter(held), model, carry=("doc_id", "lang")).collect()
    assert len(rows) > 100
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_held_out_is_the_checksum_of_the_id_as_text(spark):
    import zlib

    rows = spark.range(200).select("id", langid.held_out(F.col("id")).alias("held")).collect()
    assert all(r["held"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)


def test_edge_cases(spark):
    docs = frame(spark)
    model = langid.learn(docs)
    assert model.languages == ("aa", "bb")
    rows = langid.predict(docs, model).collect()
    assert len(rows) == len(documents())
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows}
    for none in (0, 1, 2, 11):
        assert found[none] == ("und", 0.0)
    assert found[12][0] in model.languages  # letters that no n-gram is known of
    assert {p for p, _ in found.values()} <= {"aa", "bb", "und"}


def test_no_labels_and_no_rows(spark):
    model = langid.learn(frame(spark, []))
    assert model.languages == ()
    assert {r["lang_pred"] for r in langid.predict(frame(spark), model).collect()} == {"und"}
    assert langid.predict(frame(spark, []), model).count() == 0


def test_unseen_words_go_to_shorter_grams():
    model = langid.Model(("x", "y"), {0: {"abc": (-1.0, -9.0)}, 4: {"^abd": (-9.0, -1.0)}, 3: {}, 2: {}, 1: {"q": (-1.0, -2.0)}})
    scorer = langid.Scorer(model)
    assert scorer.predict("abc")[0] == "x"
    assert scorer.predict("abd")[0] == "y"
    assert scorer.predict("qqq")[0] == "x"
    assert scorer.predict("zzz")[1] == 0.5
