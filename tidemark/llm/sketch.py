"""Document fingerprints: the hashes of all word shingles below a fixed share of the hash range.

Whether a shingle is kept depends on its hash alone, so the sketch of two texts together is
the union of their sketches, and the share of one sketch found in another estimates how
much of one text the other contains, however unequal their lengths. The likeness of two
texts is that share for the smaller sketch. A text none of whose shingles falls below the
share keeps its least hash; unions keep to that rule too, so merging stays exact.

Shingles are five words; a text of one to four words is one shingle. A NULL text is empty:
its sketch has no hash, and it is like another empty text only. All of it is built-in
DataFrame functions.

The next document in order of id comes from one window over ranges of ids, each with the
first document of the next range added at its end. NULL ids come first; rows of one id are
ordered by content, and repeated rows follow each other. A single document follows itself.
Extra columns are left out, an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, text_or_empty

SHINGLE = 5
SHARE = 4  # one in so many hashes is kept
RANGE_ROWS, MOST_RANGES = 1000, 8192
_LIMIT = -(1 << 63) + (1 << 64) // SHARE


def _kept(hashes: Column) -> Column:
    below = F.array_sort(F.array_distinct(F.filter(hashes, lambda h: h < _LIMIT)))
    return F.when((F.size(below) == 0) & (F.size(hashes) > 0), F.array(F.array_min(hashes))).otherwise(below)


def with_sketch(rows: DataFrame, text: str, name: str) -> DataFrame:
    """``rows`` with the sketch of a text column, an ascending array of 64-bit hashes."""
    kept = rows.columns
    rows = rows.withColumn("_words", F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)))
    rows = rows.withColumn("_hashed", F.transform("_words", lambda word: F.xxhash64(word)))
    last = F.size("_hashed") - SHINGLE
    places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    shingles = F.transform(places, lambda at: F.xxhash64(*[F.get("_hashed", at + k) for k in range(SHINGLE)]))
    few = F.when(F.size("_words") > 0, F.array(F.xxhash64(F.array_join("_words", " ")))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("_shingles", F.when(last >= 0, shingles).otherwise(few))
    return rows.select(*kept, _kept(F.col("_shingles")).alias(name))


def merged(left: Column, right: Column) -> Column:
    """The sketch of two texts together, shingles across their border aside."""
    return _kept(F.array_union(left, right))


def likeness(left: Column, right: Column) -> Column:
    """Estimated share of the smaller text's shingles that the larger contains, 0 to 1."""
    smaller = F.least(F.size(left), F.size(right))
    both_empty = (F.size(left) == 0) & (F.size(right) == 0)
    share = F.size(F.array_intersect(left, right)) / smaller
    return F.when(both_empty, F.lit(1.0)).when(smaller == 0, F.lit(0.0)).otherwise(share)


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def _bounds(ids: DataFrame) -> list:
    """Bounds that cut ids into at most ``MOST_RANGES`` ranges of about equal counts."""
    rows = ids.count()
    parts = max(1, min(MOST_RANGES, rows // RANGE_ROWS))
    shares = [k / parts for k in range(1, parts)]
    if not shares:
        return []
    bounds = ids.agg(F.percentile_approx("doc_id", shares, 10 * parts).alias("b")).first()["b"]  # at most MOST_RANGES numbers
    return sorted(set(bounds or []))


def _range_of(doc_id: Column, bounds: list) -> Column:
    """How many bounds lie below an id, found by halving."""
    if not bounds:
        return F.lit(0)
    steps = F.array(*[F.lit(1 << k) for k in range(len(bounds).bit_length() - 1, -1, -1)])
    held = F.array(*[F.lit(b) for b in bounds])
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(held, at + step - 1) < doc_id, at + step).otherwise(at))
    return F.coalesce(found, F.lit(0))


def with_next(rows: DataFrame, carry: list[str], derive=lambda rows: rows) -> DataFrame:
    """``rows(doc_id, content, ...)`` with ``next_<name>`` of the next document for every column in ``carry``.

    ``derive`` adds columns to rows once they are in place.
    """
    bounds = _bounds(rows.select("doc_id"))
    placed = rows.withColumn("_range", _range_of(F.col("doc_id"), bounds))
    firsts = placed.groupBy("_range").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "content")).alias("least"))
    order = Window.orderBy("_range")
    around = firsts.select(
        F.coalesce(F.lag("_range").over(order), F.max("_range").over(Window.partitionBy())).alias("_goes_to"), "least.doc_id", "least.content"
    ).withColumnsRenamed({"doc_id": "_id", "content": "_content"})
    same = placed["doc_id"].eqNullSafe(F.col("_id")) & (placed["content"] == F.col("_content"))
    added = placed.join(F.broadcast(around), same).dropDuplicates(["_goes_to"])  # one row per range: at most MOST_RANGES
    added = added.withColumn("_range", F.col("_goes_to").cast("int")).select(*placed.columns, F.lit(True).alias("_added"))
    together = derive(placed.withColumn("_added", F.lit(False)).unionByName(added))
    following = Window.partitionBy("_range").orderBy("_added", F.col("doc_id").asc_nulls_first(), "content")
    out = together.withColumns({f"next_{c}": F.lead(c).over(following) for c in carry})
    return out.filter(~F.col("_added")).drop("_added", "_range")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text of ``docs(doc_id, text)`` and of its edited text, and likenesses.

    The edited text is the text with its second half replaced by the start of the next document.
    """
    text = text_or_empty()
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("content"))
    rows = with_next(rows, ["text", "sketch"], lambda placed: with_sketch(placed, "text", "sketch"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    rows = with_sketch(rows, "edited", "edited_sketch")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
