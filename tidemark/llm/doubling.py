"""Repeated byte strings by distributed prefix doubling on chosen positions.

Every byte covered by a ``SPAN``-byte string that also starts anywhere else is removed.
Sorting all positions at doubling offsets would shuffle every byte of the corpus many
times. Positions are therefore first thinned out by content: of the ``CORE``-byte strings
that start within a ``SPAN``-byte window, the one with the least hash is the window's
anchor. Equal windows have their anchor at the same offset, so a window can repeat only if
its anchor's string does, and all windows that share an anchor are settled together.

From there on it is prefix doubling: anchors are ranked by the hash of a string around
them and the length of that string grows towards ``SPAN`` as the interval of windows that
share it is cut to parts from round to round. Per round and interval of windows

- a string common to all its windows that no other anchor has: none of them repeats;
- the string of all its windows together occurs twice: all of them repeat;
- else the parts of the interval go on to the next round.

Anchors that are alike go on as one. Ranking is by aggregates and joins on hashes, so a
string found in a third of all texts is counted before it is shuffled. Texts are joined
twice in compressed form: once to cut out the strings around open anchors, once to take
out what is removed.

Rows are numbered once, and that numbering is written with the texts: rows that share an id,
or have none, are rows of their own. A NULL text is empty, texts shorter than ``SPAN`` bytes are kept as they are; a NULL id is
an id. Extra columns are left out, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import compact, in_parts, map_batches, text_or_empty

SPAN, CORE = 200, 32
REACH = SPAN - CORE  # an anchor lies at most so far behind the start of its window
SIZES = (64, 8, 1)  # windows of an interval, from round to round
BLOCK = 1 << 20  # windows that are hashed at once
_BASE = 0x9E3779B97F4A7C15
_PLACE = np.uint64((1 << 21) - 1)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 14, 1 << n.bit_length())
        with np.errstate(over="ignore"):
            factors = [np.full(size, b, np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
            for row in factors:
                row[0] = 1
            _powers[:] = [np.cumprod(row, dtype=np.uint64) for row in factors]
    return _powers[0], _powers[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def anchors(data: bytes) -> Iterator[tuple[np.ndarray, ...]]:
    """Per block of windows: first and last window start of each anchor, its place, hash of its string and of all its windows."""
    for begin in range(0, len(data) - SPAN + 1, BLOCK):
        windows = min(BLOCK, len(data) - SPAN + 1 - begin)
        part = np.frombuffer(data, np.uint8, windows + SPAN - 1, begin)
        with np.errstate(over="ignore"):
            power, inverse = _power_tables(len(part) + 1)
            sums = np.concatenate([[np.uint64(0)], np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], dtype=np.uint64)])
            starts = np.arange(len(part) - CORE + 1)
            keys = (_mixed((sums[CORE:] - sums[:-CORE]) * inverse[: len(starts)]) & ~_PLACE) | starts.astype(np.uint64)
            width = REACH + 1
            padded = np.concatenate([keys, np.full(-len(keys) % width, np.uint64(2**64 - 1))]).reshape(-1, width)
            ahead = np.minimum.accumulate(padded, axis=1).ravel()
            behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
            least = np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows])
            first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
            last = np.concatenate([first[1:], [windows]]) - 1
            place = (least[first] & _PLACE).astype(np.int64)
            core = _mixed((sums[place + CORE] - sums[place]) * inverse[place])
            whole = (sums[last + SPAN] - sums[first]) * inverse[first]
            whole = _mixed(_mixed(whole) + ((place - first) * 1024 + (last - first)).astype(np.uint64))
        yield first + begin, last + begin, place + begin, core.view(np.int64), whole.view(np.int64)


_ID = ["row"]


def _anchor_table(docs: DataFrame) -> DataFrame:
    """Anchors of all rows ``(row, text)``; ``windows`` packs first start, number of starts less one, and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts = [], []
            for k, text in enumerate(batch.column(1)):
                data = text.as_py().encode()
                for first, last, place, core, whole in anchors(data) if len(data) >= SPAN else ():
                    rows.append(np.full(len(first), k))
                    parts.append((first << 16 | (last - first) << 8 | (place - first), core, whole))
            if parts:
                of = pa.array(np.concatenate(rows))
                columns = [pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), *columns], [*_ID, "windows", "core", "whole"])

    return in_parts(docs, run, "row bigint, windows bigint, core bigint, whole bigint")


def _unpacked() -> list[Column]:
    """``first``, ``last`` and ``place`` of packed windows."""
    first = F.shiftright("windows", 16)
    last = first + F.shiftright("windows", 8).bitwiseAND(F.lit(255))
    return [first.alias("first"), last.alias("last"), (first + F.col("windows").bitwiseAND(F.lit(255))).alias("place")]


def _compressed(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = [packer.compress(t.as_py().encode()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), *batch.columns[2:]], [*_ID, "packed", *batch.schema.names[2:]])

    return in_parts(docs, run, "row bigint, packed binary" + (", doc_id bigint" if "doc_id" in docs.columns else ""))


def _cut_out(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows(row, windows, stands)`` with ``around``: the bytes of all windows of their anchor."""
    wanted = rows.groupBy(*_ID).agg(F.collect_list(F.struct("windows", "stands")).alias("wanted"))
    joined = _compressed(docs).join(wanted, _ID)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for k in range(batch.num_rows):
                data = unpacker.decompress(batch.column(1)[k].as_py())
                asked = batch.column(2)[k].as_py()
                starts = [(x["windows"] >> 16, x["windows"] >> 8 & 255) for x in asked]
                around = [data[first : first + more + SPAN] for first, more in starts]
                of = pa.array([k] * len(asked))
                columns = [pa.array([x["windows"] for x in asked], pa.int64()), pa.array([x["stands"] for x in asked], pa.bool_()), pa.array(around, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), *columns], [*_ID, "windows", "stands", "around"])

    schema = "row bigint, windows bigint, stands boolean, around binary"
    return map_batches(joined, run, schema)


def _ranked(rows: DataFrame, size: int) -> DataFrame:
    """Ranks of intervals of ``size`` windows, which are counted by how far the anchor lies behind their start.

    ``common`` ranks the string that all windows of the whole interval share, ``joint`` the
    string of the anchor's own windows in it together.
    """
    low, high = F.col("place") - F.col("last"), F.col("place") - F.col("first")
    least, most = F.greatest(F.col("begin"), low), F.least(F.col("begin") + (size - 1), high)

    def cut(start: Column, end: Column) -> Column:
        return F.substring("around", (start - F.col("first") + 1).cast("int"), (end - start).cast("int"))

    place = F.col("place")
    common = F.xxhash64(F.lit(size), F.col("begin"), cut(place - F.col("begin"), place - F.col("begin") - (size - 1) + SPAN))
    joint = F.xxhash64(F.lit(-size), least, most, cut(place - most, place - least + SPAN))
    span = [(place - most).alias("from"), (place - least + SPAN).alias("to")]
    return rows.select("at", *_ID, "begin", "stands", common.alias("common"), joint.alias("joint"), *span)


def repeated(docs: DataFrame) -> DataFrame:
    """Spans ``(row, from, to)`` that cover all repeated strings of rows ``(row, text)``."""
    # What a join keeps by is written first: each side then has a shuffle of its own, which can be split for a hot string.
    several = compact(_anchor_table(docs).groupBy("core").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("core"))
    found = compact(_anchor_table(docs).join(several, "core", "left_semi"))
    kinds = found.groupBy("core", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*_ID, "windows")).alias("one"))
    kinds = compact(kinds)
    whole = found.join(kinds.filter("n > 1").select("core", "whole"), ["core", "whole"], "left_semi").select(*_ID, *_unpacked())
    spans = [whole.select(*_ID, F.col("first").alias("from"), (F.col("last") + SPAN).alias("to"))]
    mixed = compact(kinds.groupBy("core").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("core"))
    rest = kinds.join(mixed, "core", "left_semi").select("one.*", (F.col("n") > 1).alias("stands"))
    cut = _cut_out(docs, rest).select(F.monotonically_increasing_id().alias("at"), *_ID, "stands", "around", *_unpacked())
    cut = compact(cut)
    open_, last_size = cut.select("at", "stands", F.lit(0).cast("bigint").alias("begin")), 1 << REACH.bit_length()
    for size in SIZES:
        halves = F.explode(F.sequence(F.col("begin"), F.col("begin") + (last_size - size), F.lit(size).cast("bigint"))).alias("begin")
        parts = open_.select("at", "stands", halves)
        strings = cut.drop("stands")
        low, high = F.col("place") - F.col("last"), F.col("place") - F.col("first")
        if size == SIZES[0]:
            parts = cut.withColumn("begin", F.lit(0).cast("bigint")).select("stands", *strings.columns, halves)
        else:
            parts = parts.groupBy("at").agg(F.collect_list(F.struct("begin", "stands")).alias("parts"))
            parts = strings.join(parts, "at").select(*strings.columns, F.explode("parts").alias("part")).select(*strings.columns, "part.*")
        ranked = compact(_ranked(parts.filter((F.col("begin") <= high) & (F.col("begin") + (size - 1) >= low)), size))
        kinds = ranked.groupBy("common", "joint").agg(F.count(F.lit(1)).alias("n"), F.max("stands").alias("stands"), F.min(F.struct("at", "begin")).alias("one"))
        kinds = compact(kinds)
        twice = kinds.filter("n > 1").select("common", "joint")
        spans.append(ranked.filter("NOT stands").join(twice, ["common", "joint"], "left_semi").select(*_ID, "from", "to"))
        several = compact(kinds.groupBy("common").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("common"))
        open_ = kinds.join(several, "common", "left_semi").select("one.*", (F.col("stands") | (F.col("n") > 1)).alias("stands"))
        last_size = size
    covered = spans[0]
    for more in spans[1:]:
        covered = covered.union(more)
    return covered


def without_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (bytes) digests of every row of ``docs(doc_id, text)``."""
    text = text_or_empty()
    rows = compact(docs.select(F.monotonically_increasing_id().alias("row"), text.alias("text"), F.col("doc_id").cast("bigint").alias("doc_id")))
    covered = repeated(rows.select("row", "text")).groupBy(*_ID).agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    joined = _compressed(rows).join(covered, _ID, "left").select("doc_id", "packed", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                data = unpacker.decompress(batch.column(1)[k].as_py())
                merged: list[list[int]] = []
                for x in sorted((x["from"], x["to"]) for x in batch.column(2)[k].as_py() or ()):
                    if merged and x[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x[1])
                    else:
                        merged.append(list(x))
                kept, at = hashlib.sha256(), 0
                for begin, end in merged:
                    kept.update(data[at:begin])
                    at = end
                kept.update(data[at:])
                out.append((len(data), sum(b - a for a, b in merged), len(merged), kept.hexdigest()))
            columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)] if out else []
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return map_batches(joined, run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
