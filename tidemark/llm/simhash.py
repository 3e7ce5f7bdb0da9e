"""SimHash fingerprints and a binary trie self-join that links close ones.

A fingerprint's bits, read from the top, are a path in a binary trie. The self-join walks
pairs of trie nodes of one depth, starting from the root with itself, adds up the bits in
which the two paths differ, and drops a pair as soon as the sum passes the budget of its
depth. ``Budgets`` lists (depth, most differing bits up to there): ((64, 2),) finds all
64-bit fingerprints within two bits. Wide fingerprints with a large whole budget are
joined in several tries, each over the bits from another offset on and with small budgets
for its first bits; a pair that stays within one trie's budgets and the whole budget links.

On Spark the upper levels are joins of node tables, level by level, until both nodes of a
pair hold few enough fingerprints; those pairs are walked to the end inside a task, which
gives out a spanning forest of what it linked and never the pairs of a group. Components
come from the forests by contraction rounds of joins and aggregates.

Equal texts meet as one fingerprint before anything is joined. A text without words, or a
NULL text, has fingerprint zero, which is linked like any other. Repeated rows all come
out; extra columns are left out. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import accumulate, combinations, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import in_parts, map_batches, text_or_empty
from tidemark.operators.staging import staged

Budgets = Sequence[tuple[int, int]]
STEP = 4  # trie levels that one round of joins goes down
UNIT = 8192  # fingerprints of a node pair that one task walks
CHUNK = 1 << 16


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """Another 64 bits for each hash; lane 0 is the hash itself."""
    if not lane:
        return h
    with np.errstate(over="ignore"):
        h = h + np.uint64(lane) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: str, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of every shingle, in blocks; only A-Z are lower-cased."""
    tokens = text.encode().lower().split()
    if not tokens:
        return
    joined = b" ".join(tokens)
    ends = list(accumulate(len(t) + 1 for t in tokens))
    begins = [0, *ends[:-1]]
    lasts = ends[shingle - 1 :] or [ends[-1]]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(lasts), CHUNK):
        spans = zip(begins[at : at + CHUNK], lasts[at : at + CHUNK], strict=False)
        yield np.array([digest(joined[a : b - 1], 42) for a, b in spans], np.uint64)


def fingerprint(text: str, shingle: int, lanes: int) -> bytes:
    ones, total = np.zeros(64 * lanes, np.int64), 0
    for hashes in shingle_hashes(text, shingle):
        total += len(hashes)
        wide = np.stack([_mixed(hashes, k) for k in range(lanes)], axis=1).astype(">u8")
        bits = np.unpackbits(wide.view(np.uint8), axis=1)
        for at in range(0, len(bits), 255):
            ones += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > total).tobytes()


def fingerprints(docs: DataFrame, carry: Sequence[str] = ("doc_id",), *, shingle: int = 3, bits: int = 64) -> DataFrame:
    """The ``carry`` columns and ``fingerprint`` (binary, highest bit first) of the ``text`` of every row of ``docs``."""
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), shingle, bits // 64) for t in batch.column(batch.num_columns - 1)]
            columns = [*batch.columns[:-1], pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "fingerprint"])

    return in_parts(docs.select(*carry, text_or_empty().alias("_hashed")), run, f"{fields}, fingerprint binary")


def _lanes(values: Sequence[bytes]) -> np.ndarray:
    """Fingerprints as rows of unsigned 64-bit integers."""
    return np.frombuffer(b"".join(values), ">u8").astype(np.uint64).reshape(len(values), -1)


def _keys(lanes: np.ndarray, offset: int) -> np.ndarray:
    """The 64 bits from ``offset`` on, going round."""
    lane, shift = divmod(offset, 64)
    key = lanes[:, lane % lanes.shape[1]] << np.uint64(shift)
    return key | (lanes[:, (lane + 1) % lanes.shape[1]] >> np.uint64(64 - shift)) if shift else key


def _allowed(budgets: Budgets, depth: int) -> int:
    return next((bits for until, bits in budgets if depth <= until), budgets[-1][1])


class Walk:
    """All links between two sorted sets of fingerprints (or within one), as labels of linked groups."""

    def __init__(self, lanes: np.ndarray, keys: np.ndarray, budgets: Budgets) -> None:
        self.lanes, self.keys, self.budgets = lanes, keys, budgets
        self.deepest = min(64, budgets[-2][0] if len(budgets) > 1 else 64)  # below it the whole budget alone decides
        self.labels = np.arange(len(keys))

    def _join(self, i: np.ndarray, j: np.ndarray) -> None:
        labels = self.labels
        while True:
            a, b = labels[i], labels[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(further := labels[labels], labels):
                labels[:] = further

    def _close(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.lanes[i] ^ self.lanes[j]).sum(axis=1, dtype=np.int64) <= self.budgets[-1][1]

    def _pairs(self, alo, ahi, blo, bhi) -> None:
        """Compare the members of small node pairs one by one."""
        width = bhi - blo
        sizes = (ahi - alo) * width
        owner = np.repeat(np.arange(len(sizes)), sizes)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        i, j = alo[owner] + within // width[owner], blo[owner] + within % width[owner]
        wanted = (i < j) & (self.labels[i] != self.labels[j])
        i, j = i[wanted], j[wanted]
        close = self._close(i, j)
        self._join(i[close], j[close])

    def _bucket(self, alo: int, ahi: int, blo: int, bhi: int) -> None:
        """Members of two large leaves: each is compared only with those it is not yet linked to."""
        for i in range(alo, ahi):
            others = np.arange(max(blo, i + 1), bhi)
            others = others[self.labels[others] != self.labels[i]]
            if len(others):
                close = others[self._close(np.full(len(others), i), others)]
                self._join(np.full(len(close), i), close)

    def run(self, cut: int, depth: int, differing: int) -> np.ndarray:
        """Walk from one node pair: rows before ``cut`` against those after, or all among themselves at ``cut`` 0."""
        n = len(self.keys)
        first = (0, n, 0, n) if not cut else (0, cut, cut, n)
        stack = [(depth, *[np.array([x]) for x in (*first, differing)])]
        while stack:
            depth, alo, ahi, blo, bhi, diff = stack.pop()
            if len(alo) > CHUNK:
                middle = len(alo) // 2
                stack += [(depth, *[x[s] for x in (alo, ahi, blo, bhi, diff)]) for s in (slice(middle), slice(middle, None))]
                continue
            small = (ahi - alo) * (bhi - blo) <= 8
            if small.any():
                self._pairs(alo[small], ahi[small], blo[small], bhi[small])
                alo, ahi, blo, bhi, diff = (x[~small] for x in (alo, ahi, blo, bhi, diff))
            if not len(alo):
                continue
            if depth >= self.deepest:
                for k in range(len(alo)):
                    self._bucket(alo[k], ahi[k], blo[k], bhi[k])
                continue
            bit = (self.keys >> np.uint64(63 - depth)) & np.uint64(1)
            ones = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
            amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
            same = alo == blo
            children = []
            for af, at, bf, bt, more, kept in (
                (alo, amid, blo, bmid, 0, None),
                (amid, ahi, bmid, bhi, 0, None),
                (alo, amid, bmid, bhi, 1, None),
                (amid, ahi, blo, bmid, 1, ~same),
            ):
                good = (af < at) & (bf < bt) & (diff + more <= _allowed(self.budgets, depth + 1))
                good &= (af != bf) | (at - af > 1)
                good = good if kept is None else good & kept
                children.append([x[good] for x in (af, at, bf, bt, diff + more)])
            joined = [np.concatenate(x) for x in zip(*children, strict=True)]
            if len(joined[0]):
                stack.append((depth + 1, *joined))
        return self.labels


def _walk_unit(ours: list[bytes], theirs: list[bytes], offset: int, budgets: Budgets, depth: int, differing: int):
    """Links of one node pair as (fingerprint, representative)."""
    sides = []
    for values in (ours, theirs):
        lanes = _lanes(values) if values else np.empty((0, len(ours[0]) // 8), np.uint64)
        keys = _keys(lanes, offset)
        order = np.argsort(keys, kind="stable")
        sides.append((lanes[order], keys[order], [values[k] for k in order]))
    (a, ka, na), (b, kb, nb) = sides
    names = na + nb
    if nb:  # the trie of each side keeps its own order: bit sums work on ranges of either side
        walk = Walk(np.concatenate([a, b]), np.concatenate([ka, kb]), budgets)
    else:
        walk = Walk(a, ka, budgets)
    labels = walk.run(len(na) if nb else 0, depth, differing)
    return [(names[k], names[labels[k]]) for k in np.flatnonzero(labels != np.arange(len(labels)))]


def _nodes(rows: DataFrame, depth: int) -> DataFrame:
    return rows.groupBy("trie", F.shiftrightunsigned("key", 64 - depth).alias("node")).agg(F.count(F.lit(1)).alias("n"))


def _first_pairs(nodes: DataFrame, depth: int, budget: int) -> DataFrame:
    """Node pairs of the starting depth: every node with itself and with those within the budget."""
    masks = [sum(1 << b for b in bits) for k in range(min(budget, depth) + 1) for bits in combinations(range(depth), k)]
    wanted = nodes.select(
        "trie", F.col("node").alias("a"), F.col("n").alias("na"), F.explode(F.array(*[F.lit(m).cast("bigint") for m in masks])).alias("mask")
    ).withColumn("b", F.col("a").bitwiseXOR(F.col("mask")))
    wanted = wanted.filter("a <= b").withColumn("differing", F.bit_count("mask").cast("int"))
    others = nodes.select("trie", F.col("node").alias("b"), F.col("n").alias("nb"))
    return wanted.join(others, ["trie", "b"]).select("trie", "a", "b", "na", "nb", "differing")


def _deeper(pairs: DataFrame, nodes: DataFrame, budget: int) -> DataFrame:
    """The children of node pairs that stay within the budget."""
    for side in ("a", "b"):
        own = nodes.select(
            "trie", F.shiftrightunsigned("node", STEP).alias(side), F.col("node").alias(f"{side}2"), F.col("n").alias(f"n{side}2")
        )
        pairs = pairs.join(own, ["trie", side])
    low = F.col("a2").bitwiseXOR(F.col("b2")).bitwiseAND(F.lit((1 << STEP) - 1))
    differing = (F.col("differing") + F.bit_count(low)).cast("int")
    return (
        pairs.filter("a < b OR a2 <= b2")
        .select("trie", F.col("a2").alias("a"), F.col("b2").alias("b"), F.col("na2").alias("na"), F.col("nb2").alias("nb"), differing.alias("differing"))
        .filter(F.col("differing") <= budget)
    )


def links(fingerprints: DataFrame, *, bits: int = 64, offsets: Sequence[int] = (0,), budgets: Budgets = ((64, 2),), unit: int = UNIT) -> DataFrame:
    """Linked fingerprints as (a, b), enough of them to connect every group. ``fingerprints(fingerprint)`` are distinct."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0)
            lanes = _lanes(values.to_pylist()) if batch.num_rows else np.empty((0, bits // 64), np.uint64)
            for trie, offset in enumerate(offsets):
                key = _keys(lanes, offset).view(np.int64)
                columns = [pa.array(np.full(len(key), trie, np.int32)), pa.array(key), values]
                yield pa.RecordBatch.from_arrays(columns, ["trie", "key", "fingerprint"])

    rows = map_batches(fingerprints.select("fingerprint"), keyed, "trie int, key bigint, fingerprint binary")
    rows = staged(rows)
    depth = STEP if budgets[0][1] else max(STEP, budgets[0][0])
    pairs = staged(_first_pairs(_nodes(rows, depth), depth, _allowed(budgets, depth)))
    held = F.when(F.col("a") == F.col("b"), F.col("na")).otherwise(F.col("na") + F.col("nb"))
    units, members = [], []
    while True:
        small = pairs.filter((held <= unit) | F.lit(depth >= 64)).filter((F.col("a") != F.col("b")) | (F.col("na") > 1))
        small = small.select(F.lit(depth).alias("depth"), "trie", "a", "b", "differing")
        units.append(small)
        used = small.select("depth", "trie", F.col("a").alias("node")).union(small.select("depth", "trie", F.col("b").alias("node"))).distinct()
        placed = rows.select(F.lit(depth).alias("depth"), "trie", F.shiftrightunsigned("key", 64 - depth).alias("node"), "fingerprint")
        members.append(placed.join(used, ["depth", "trie", "node"], "left_semi"))
        large = pairs.filter(held > unit)
        if depth >= 64 or large.isEmpty():
            break
        depth += STEP
        pairs = staged(_deeper(large, _nodes(rows, depth), _allowed(budgets, depth)))
    work, nodes = units[0], members[0]
    for more_units, more_members in zip(units[1:], members[1:], strict=True):
        work, nodes = work.union(more_units), nodes.union(more_members)
    held_by = staged(nodes.groupBy("depth", "trie", "node").agg(F.collect_list("fingerprint").alias("held")))
    ours = held_by.withColumnsRenamed({"node": "a", "held": "ours"})
    theirs = held_by.withColumnsRenamed({"node": "b", "held": "theirs"})
    own = work.filter("a = b").join(ours, ["depth", "trie", "a"]).select("depth", "trie", "differing", "ours", F.array().cast("array<binary>").alias("theirs"))
    across = work.filter("a <> b").join(ours, ["depth", "trie", "a"]).join(theirs, ["depth", "trie", "b"])
    todo = own.union(across.select("depth", "trie", "differing", "ours", "theirs"))

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                at, trie, differing, ours, theirs = (c[k].as_py() for c in batch.columns)
                found = _walk_unit(ours, theirs, offsets[trie], budgets, at, differing)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*found, strict=True)], ["a", "b"])

    return map_batches(todo, walked, "a binary, b binary")


def components(pairs: DataFrame) -> DataFrame:
    """``(node, label)`` of every node of ``pairs(a, b)``: connected nodes have one label, itself a node.

    Each round every node moves to the least of itself and its neighbours in an order
    that is drawn anew, which leaves a fraction of the nodes; the moves are then followed
    backwards. All rounds are aggregates and joins on a node.
    """
    moves: list[DataFrame] = []
    pairs = staged(pairs.select("a", "b").filter("a <> b").distinct())
    for turn in count():
        if pairs.isEmpty():
            break
        both = pairs.union(pairs.select("b", "a"))

        def drawn(name: str, turn: int = turn):
            return F.struct(F.xxhash64(F.col(name), F.lit(turn)).alias("draw"), F.col(name).alias("node"))

        nearest = both.groupBy(F.col("a").alias("node")).agg(F.min(drawn("b")).alias("least"))
        move = staged(nearest.select("node", F.least(F.col("least"), drawn("node"))["node"].alias("label")))
        moves.append(move)
        for side in ("a", "b"):
            pairs = pairs.join(move.withColumnsRenamed({"node": side, "label": f"{side}2"}), side)
        pairs = staged(pairs.filter("a2 <> b2").select(F.col("a2").alias("a"), F.col("b2").alias("b")).distinct())
    if not moves:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = moves[-1]
    for move in reversed(moves[:-1]):
        later = labels.select(F.col("node").alias("label"), F.col("label").alias("final"))
        labels = move.join(later, "label", "left").select("node", F.coalesce("final", "label").alias("label"))
    return labels


def near_duplicates(marked: DataFrame, key: str, **how) -> DataFrame:
    """``marked(key, fingerprint)`` with ``component``: the smallest key of all rows that links lead to."""
    held = marked.groupBy("fingerprint").agg(F.min(key).alias("least"))
    held = staged(held)
    labels = staged(components(links(held, **how)))
    linked = held.join(labels.withColumnRenamed("node", "fingerprint"), "fingerprint")
    least = linked.groupBy("label").agg(F.min("least").alias("component"))
    linked = labels.join(least, "label").select(F.col("node").alias("fingerprint"), "component")
    named = staged(held.join(linked, "fingerprint", "left").select("fingerprint", F.coalesce("component", "least").alias("component")))
    return marked.join(named, "fingerprint").select(key, "fingerprint", "component")
