"""Small documents with every case that operators must take."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names that operators use for columns of their own.
CLASHING = "fingerprint string, size string, group string, bucket string, draw string, place string, content string, base string, spans string, label string, kind string, first string, words string, position string, curve string, shard string, ids string, score string, lang_pred string, target string, sketch string, next_text string"


def prose(rng: random.Random, words: int) -> str:
    parts = ["ba", "ke", "lo", "mi", "nu", "ra", "se", "ti", "vo", "é"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(words))


def documents() -> list[tuple]:
    rng = random.Random(5)
    shared = prose(rng, 70)
    rows = [
        (0, None, "aa", "s1", None),
        (1, "", "aa", "s1", 0),
        (2, " \t\n", "aa", None, 3),
        (3, "word", "aa", "s2", 4),
        (4, "two words", None, "s2", 9),
        (5, prose(rng, 4000), "aa", "s1", None),
        (6, shared, "bb", "s3", None),
        (7, shared, "bb", "s3", None),
        (8, f"{prose(rng, 20)} {shared} {prose(rng, 30)}", "bb", None, None),
        (9, "x" * 3000, "bb", "s1", None),
        (10, "mail a.b@c.de or +1 (234) 567-8901, 10.0.0.1, 4111 1111 1111 1111 \u0001 end", "bb", "", 0),
        (11, "12345 67890 !!!", "aa", "s1", 15),
        (12, "日本語 テキスト <|endoftext|> don't  stop", None, None, None),
        (None, "no id here", "aa", "s1", 10),
    ]
    rows += [(20, shared, "bb", "s3", 5)] * 3
    rows += [(100 + k, prose(rng, rng.randint(1, 120)), rng.choice(["aa", "bb"]), rng.choice(["s1", "s2", "s3"]), 0) for k in range(60)]
    return rows


def frame(spark, rows=None, clashing: bool = True):
    rows = documents() if rows is None else rows
    if not clashing:
        return spark.createDataFrame(rows, SCHEMA)
    extra = tuple("?" for _ in CLASHING.split(","))
    return spark.createDataFrame([(*r, *extra) for r in rows], f"{SCHEMA}, {CLASHING}")
