"""Surrogate keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from tidemark.operators.staging import staged

# monotonically_increasing_id() is the partition number above these bits and the
# position within the partition below them.
_POSITION_BITS = 33


def with_surrogate_key(df: DataFrame, name: str, order_by: Sequence[str], *, unique: bool = False) -> DataFrame:
    """Add ``name``: 1..N without gaps in the order of ``order_by`` (NULLs first).

    A window without partitions would bring all rows into one task. Instead the rows
    are sorted by range, each keeps its position within its range, and the number of
    rows in the ranges before is added. Rows with equal order columns are ordered by
    their content, and exact copies by the place they were first written to, so that
    the ranges also split a key or a group of copies that holds most of the rows.
    Both steps are written out: places and positions must not move when a task is
    repeated. With ``unique`` the order columns are said to tell (nearly) all rows apart;
    the first step is then left out, and rows that they leave equal stay in one range.
    """
    if unique:
        return _numbered(staged(df.orderBy(*order_by).select("*", F.monotonically_increasing_id().alias("_slot"))), name, df.columns)
    hashable = [f.name for f in df.schema.fields if not isinstance(f.dataType, MapType | VariantType)]
    placed = staged(df.withColumn("_place", F.monotonically_increasing_id()))
    ordered = staged(
        placed.withColumn("_content", F.xxhash64(*hashable))
        .orderBy(*order_by, "_content", "_place")
        .select(*df.columns, F.monotonically_increasing_id().alias("_slot"))
    )
    return _numbered(ordered, name, df.columns)


def extend_surrogate_key(
    df: DataFrame, given: DataFrame, name: str, business_key: Sequence[str], order_by: Sequence[str]
) -> DataFrame:
    """Add ``name`` to ``df``: the key that ``given(name, *business_key)`` has for a row, or the next free one.

    Keys once given never change; rows with a new business key, which is unique (NULL is a
    value), are numbered after the largest given key in the order of ``order_by``.
    """
    known = given.select(name, *[F.col(c).alias(f"_given_{c}") for c in business_key])
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_given_{c}")) for c in business_key])
    kept = df.join(known, same).select(name, *df.columns)
    top = known.agg(F.max(name)).first()[0] or 0  # one number
    fresh = with_surrogate_key(df.join(known, same, "left_anti"), name, order_by, unique=True)
    return kept.unionByName(fresh.withColumn(name, F.col(name) + top))


def _numbered(ordered: DataFrame, name: str, columns: Sequence[str]) -> DataFrame:
    """Rows with ``_slot``, their range and place within it, with their number over all ranges."""
    sizes = ordered.groupBy(F.shiftright("_slot", _POSITION_BITS).alias("range")).count().orderBy("range")
    # One small row per range, that is per shuffle partition; it does not grow with the rows of a range.
    starts: dict[int, int] = {}
    total = 0
    for row in sizes.collect():
        starts[row["range"]] = total
        total += row["count"]
    if not starts:
        return ordered.select(F.lit(None).cast("bigint").alias(name), *columns)
    per_range = ",".join(str(starts.get(i, 0)) for i in range(max(starts) + 1))
    start = F.element_at(
        F.split(F.lit(per_range), ",").cast("array<bigint>"), F.shiftright("_slot", _POSITION_BITS).cast("int") + 1
    )
    position = F.col("_slot").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    return ordered.select((start + position + 1).alias(name), *columns)
