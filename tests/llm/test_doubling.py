import hashlib
import random
from collections import Counter

from texts import documents, frame, prose

from tidemark.llm import doubling


def plain(rows):
    counts = Counter()
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    for _, b in data:
        counts.update(b[i : i + 200] for i in range(len(b) - 199))
    out = []
    for doc_id, b in data:
        removed = [False] * len(b)
        for i in range(len(b) - 199):
            if counts[b[i : i + 200]] > 1:
                removed[i : i + 200] = [True] * 200
        spans = sum(removed[i] and (i == 0 or not removed[i - 1]) for i in range(len(b)))
        kept = bytes(c for c, gone in zip(b, removed, strict=True) if not gone)
        out.append((doc_id, len(b), sum(removed), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def same(spark, rows):
    found = sorted((tuple(r) for r in doubling.without_repeats(frame(spark, rows)).collect()), key=repr)
    assert found == plain(rows)


def test_edge_cases(spark):
    same(spark, documents())


def test_overlaps_borders_and_near_copies(spark):
    rng = random.Random(8)
    passage, other = prose(rng, 120), prose(rng, 90)
    rows = [
        (1, passage[:200]), (2, passage), (3, f"{prose(rng, 5)}{passage[10:209]}{prose(rng, 5)}"), (4, f"x{passage[10:211]}y"),
        (5, other + other), (6, passage[:300] + other[:250] + passage[150:400]), (7, "ab" * 300), (8, "a" * 199), (9, "a" * 401), (10, "é" * 150),
    ]
    for k in range(30):  # near copies of one text, each with a word of its own
        words = passage.split()
        words[rng.randrange(len(words))] = f"w{k}"
        rows.append((20 + k, " ".join(words)))
    same(spark, [(i, t, None, None, 0) for i, t in rows])


def test_random_repeats(spark):
    rng = random.Random(11)
    pool = [prose(rng, rng.randint(20, 60)) for _ in range(12)]
    rows = [(k, "".join(rng.choice(pool)[rng.randint(0, 30) :] for _ in range(rng.randint(1, 5))), None, None, 0) for k in range(80)]
    same(spark, rows)


def test_empty_table(spark):
    assert doubling.without_repeats(frame(spark, [])).count() == 0


def test_rows_that_share_an_id_or_have_none_are_rows_of_their_own(spark):
    """Many different texts under one id and under none, a few of which repeat elsewhere."""
    rng = random.Random(4)
    texts = [prose(rng, 60) for _ in range(200)]
    rows = [(1, t, None, None, 0) for t in texts[:100]] + [(None, t, None, None, 0) for t in texts[100:]]
    rows += [(2, texts[3], None, None, 0), (None, texts[150], None, None, 0), (1, texts[7][20:260], None, None, 0)]
    same(spark, rows)


def test_joins_go_by_row_number_alone():
    assert doubling._ID == ["row"]
