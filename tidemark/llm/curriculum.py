"""Mixing sources to target weights by a curriculum that changes over the training run.

Every source has a weight schedule over the run, from 0 to 1: a straight line whose mean
is the source's weight. Integrated, it is the source's cumulative demand for words at each
time. Targets share ``demand`` times all words by weight; a target stops at ``most`` times
its source's words and the excess is shared by weight among the others. A source's
documents stand in an order drawn from their ids; they are taken in passes, each one whole
but the last, which ends within the document where the target is met. Where a document's
middle word falls in the demand, the inverse of the demand gives the time of training: its
position. Sorted by position, range by range, the documents are the curriculum.

Running sums are never one task per source: rows fall by their draw into many buckets, the
buckets are summed first, and sums within a bucket are added to those of the buckets
before. Everything is built-in DataFrame functions.

A NULL text has size 0 and is taken 0 times, as is every document when all are empty. The
NULL source is a source, the last one. Rows with one id and size are interchangeable;
repeated rows are taken each for itself. Extra columns are left out unless named to be
carried along. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, text_or_empty

WEIGHTS = (5.0, 2.0, 1.0)  # by the source's place in code point order, repeating
SLOPES = (-0.5, 0.0, 0.5)  # change of the weight over the run, as a share of it, repeating
BUCKET, LEAST_BUCKETS = 4096, 1024


def sizes(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id``, ``source``, carried columns and the number of words of every row of ``docs``."""
    size = F.regexp_count(text_or_empty(), F.lit(WORD)).cast("bigint").alias("size")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), *carry, size)


def targets(totals: DataFrame, *, demand: float = 1.5, most: float = 2.0, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """``source, source_size, place, target`` from one row per source ``(source, source_size)``.

    With sources in the order of the level at which they are full (their limit by weight),
    those before some place are at their limits and the rest share what is left by weight:
    at the first place whose source would not overflow. One row per source meets in a task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1).cast("bigint")
    named = totals.withColumn("place", place)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    named = named.withColumns({"weight": weight, "limit": F.col("source_size") * F.lit(float(most))})
    by_level = Window.orderBy(F.col("limit") / F.col("weight"), "place")
    before, everything = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    wanted = F.sum("source_size").over(everything) * F.lit(float(demand))
    level = (wanted - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    filled = named.withColumn("level", level)
    open_level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct(F.col("limit") / F.col("weight"), F.col("place"), F.col("level")))).over(everything)
    reached = F.least(F.col("limit"), F.coalesce(open_level["level"] * F.col("weight"), F.col("limit")))
    return filled.select("source", "source_size", "place", reached.alias("target"))


def _group(source: str):
    """A source's name as a key that is never NULL, so that sums and joins share one way of dealing rows out."""
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")).alias("group")


def mix(sized: DataFrame, *, demand: float = 1.5, most: float = 2.0, weights: Sequence[float] = WEIGHTS, carry: Sequence[str] = ()) -> DataFrame:
    """What the mix takes of every row of ``sized(doc_id, source, size)``.

    ``source_size``, ``target``, ``begin`` (words of the source before this document),
    ``whole`` (passes that take it whole), ``rest`` (its words in the last, partial pass)
    and ``taken`` are added. ``sized`` is read three times.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    rows = sums.agg(F.sum("rows").alias("n")).first()["n"] or 0  # one number
    buckets = max(LEAST_BUCKETS, 1 << max(0, (rows // BUCKET)).bit_length())
    planned = targets(sums.select("source", "source_size"), demand=demand, most=most, weights=weights)
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    drawn = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")  # 60 bits
    bucket = F.floor(F.col("draw") / F.lit((1 << 60) // buckets)).cast("bigint")
    placed = sized.select("doc_id", "source", "size", *carry, drawn.alias("draw"), _group("source")).withColumn("bucket", bucket)
    per_bucket = placed.groupBy("group", "bucket").agg(F.sum("size").alias("held"))
    ahead = Window.partitionBy("group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_bucket.withColumn("ahead", F.coalesce(F.sum("held").over(ahead), F.lit(0))).drop("held")
    plan = per_bucket.join(planned.select("source_size", "place", "target", _group("source")), "group")
    within = Window.partitionBy("group", "bucket").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = summed.join(plan, ["group", "bucket"])
    words = F.floor(F.col("target") + 0.5)
    whole = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    begin = F.col("ahead") + F.col("inside")
    left = words - whole * F.col("source_size") - begin
    rest = F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("bigint")
    out = joined.withColumns({"whole": whole, "begin": begin, "rest": rest})
    return out.select(
        "doc_id", "source", "size", *carry, "source_size", "place", "target", "begin", "whole", "rest",
        (F.col("whole") * F.col("size") + F.col("rest")).alias("taken"),
    )


def positions(mixed: DataFrame, *, slopes: Sequence[float] = SLOPES) -> DataFrame:
    """``mixed`` with ``turns``: per time a document is taken, the ``words`` taken and their ``position`` from 0 to 1."""
    slope = F.element_at(F.array(*map(F.lit, slopes)), (F.col("place") % len(slopes) + 1).cast("int"))

    def taken(turn):
        words = F.when(turn < F.col("whole"), F.col("size")).otherwise(F.col("rest"))
        share = (turn * F.col("source_size") + F.col("begin") + words / 2) / F.greatest("target", F.lit(1.0))
        share = F.least(F.lit(1.0), share)
        # The demand s(t) = (1 - slope) t + slope t^2 of a source, solved for t.
        position = 2 * share / ((1 - slope) + F.sqrt((1 - slope) * (1 - slope) + 4 * slope * share))
        return F.struct(turn.alias("turn"), words.alias("words"), position.alias("position"))

    passes = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("whole")), taken)
    return mixed.withColumn("turns", F.filter(passes, lambda x: x["words"] > 0))


def curriculum(positioned: DataFrame) -> DataFrame:
    """One row per time a document is taken, range-sorted by position: the order of training."""
    taken = positioned.select("*", F.explode("turns").alias("_taken")).drop("turns")
    return taken.select("*", "_taken.*").drop("_taken").orderBy("position", "doc_id", "turn")


def cut_text(text, words, size):
    """The first ``words`` of a text of ``size`` words, with the space before each; the whole text if that is all."""
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    return F.when(words < size, F.array_join(F.slice(pieces, F.lit(1), words.cast("int")), "")).otherwise(text)
