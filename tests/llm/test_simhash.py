import random

import numpy as np
import pytest
import xxhash
from texts import documents, frame, prose

from tidemark.llm import simhash


def plain_fingerprint(text, shingle=3):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_groups(values, most):
    label = {v: v for v in values}

    def root(v):
        while label[v] != v:
            v = label[v]
        return v

    ordered = sorted(values)
    for i, a in enumerate(ordered):
        for b in ordered[i + 1 :]:
            if (a ^ b).bit_count() <= most:
                label[max(root(a), root(b))] = min(root(a), root(b))
    return {v: root(v) for v in values}


def test_fingerprints_and_components_of_edge_cases(spark):
    docs = frame(spark)
    marked = simhash.fingerprints(docs).persist()
    rows = simhash.near_duplicates(marked, "doc_id").collect()
    assert len(rows) == len(documents())
    texts = {r[0]: r[1] for r in documents()}
    values = {d: plain_fingerprint(t) for d, t in texts.items()}
    groups = plain_groups(set(values.values()), 2)
    least = {}
    for d, v in values.items():
        if d is not None:
            least[groups[v]] = min(d, least.get(groups[v], d))
    for r in rows:
        assert r["fingerprint"].hex() == f"{values[r['doc_id']]:016x}"
        assert r["component"] == least.get(groups[values[r["doc_id"]]])


@pytest.mark.parametrize("unit", [4, 64, 8192])
def test_trie_join_finds_all_links_at_any_unit(spark, unit):
    rng = random.Random(unit)
    values = {rng.getrandbits(64) for _ in range(300)}
    values |= {v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for v in list(values)[:150]}
    values |= {0, 1, 3, 7, 15, (1 << 64) - 1}
    hub = rng.getrandbits(64)  # a ball of links around one fingerprint
    values |= {hub ^ (1 << a) for a in range(64)} | {hub}
    prints = spark.createDataFrame([(v.to_bytes(8, "big"),) for v in values], "fingerprint binary")
    found = simhash.components(simhash.links(prints, unit=unit)).collect()
    names = {int.from_bytes(r["node"], "big"): int.from_bytes(r["label"], "big") for r in found}
    groups = plain_groups(values, 2)
    ours, theirs = {}, {}
    for v in values:
        ours.setdefault(names.get(v, v), set()).add(v)
        theirs.setdefault(groups[v], set()).add(v)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_a_large_group_gives_out_a_forest_not_its_pairs(spark):
    rng = random.Random(1)
    text = prose(rng, 400).split()
    copies = []
    for k in range(120):
        words = list(text)
        words[rng.randrange(400)] = f"w{k}"
        copies.append((k, " ".join(words)))
    docs = spark.createDataFrame(copies, "doc_id bigint, text string")
    how = {"bits": 256, "offsets": tuple(range(0, 240, 12)), "budgets": ((8, 0), (24, 2), (256, 44))}
    marked = simhash.fingerprints(docs, shingle=5, bits=256).persist()
    links = simhash.links(marked.select("fingerprint").distinct(), **how)
    assert links.count() < 120 * 20
    assert {r["component"] for r in simhash.near_duplicates(marked, "doc_id", **how).collect()} == {0}


def test_wide_fingerprints_find_pairs_of_similarity_over_four_fifths(spark):
    rng = random.Random(2)
    rows, pairs = [], []
    for k in range(60):
        words = prose(rng, 300).split()
        near = list(words)
        for _ in range(4):
            near[rng.randrange(300)] = prose(rng, 1) + "x"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(near))]
        a, b = ({" ".join(w[i : i + 5]) for i in range(296)} for w in (words, near))
        if len(a & b) / len(a | b) >= 0.85:
            pairs.append(k)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    how = {"bits": 256, "offsets": tuple(range(0, 240, 12)), "budgets": ((8, 0), (24, 2), (256, 44))}
    marked = simhash.fingerprints(docs, shingle=5, bits=256).persist()
    found = {r["doc_id"]: r["component"] for r in simhash.near_duplicates(marked, "doc_id", **how).collect()}
    assert all(c in (d, d - 1) and c % 2 == 0 or c == d for d, c in found.items())  # strangers stay apart
    assert np.mean([found[2 * k + 1] == 2 * k for k in pairs]) >= 0.9


def test_empty_table(spark):
    marked = simhash.fingerprints(frame(spark, [])).persist()
    assert simhash.near_duplicates(marked, "doc_id").count() == 0
