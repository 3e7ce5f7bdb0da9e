"""Change logs: windows, extraction, latest state per key, snapshot difference."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType

from tidemark.functions import timestamp_literal
from tidemark.operators.staging import in_slice, slices_of, staged, staged_parts

INSERT, UPDATE, DELETE = "INSERT", "UPDATE", "DELETE"
# Changes up to which a join is planned so that they can be broadcast; more are shuffled anyway, once.
FEW = 300_000


def in_window(df: DataFrame, column: str, after: datetime | str | None, until: datetime | str | None) -> DataFrame:
    """Rows with ``after < column <= until``; an open end is None."""
    data_type = df.schema[column].dataType
    if after is not None:
        df = df.filter(F.col(column) > timestamp_literal(after, data_type))
    if until is not None:
        df = df.filter(F.col(column) <= timestamp_literal(until, data_type))
    return df


def batch_end(log: DataFrame, table_name: str, fallback: datetime | str | None = None) -> DataFrame:
    """One row ``batch_end``: time of the last logged change of a table, or the fallback (default now)."""
    data_type = log.schema["changed_at"].dataType
    otherwise = F.current_timestamp().cast(data_type) if fallback is None else timestamp_literal(fallback, data_type)
    last = F.coalesce(F.max("changed_at"), otherwise)
    return log.filter(F.col("table_name") == table_name).agg(last.alias("batch_end"))


def logged_changes(
    log: DataFrame, table_name: str, key_type: DataType, after: datetime | str | None, until: datetime | str | None
) -> DataFrame:
    """Log rows of one table and window, with the logged id in the type of the key; NULL where it has no such form."""
    return in_window(log.filter(F.col("table_name") == table_name), "changed_at", after, until).select(
        "log_id", "operation_type", "changed_at", F.col("id").try_cast(key_type).alias("_logged_key")
    )


def rows_of_keys(source: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Source rows whose key is among ``keys``, compared as it is stored, so that filters reach its scan."""
    return source.join(keys, source[key] == keys[key], "left_semi")


def extract_changes(
    log: DataFrame,
    source: DataFrame,
    *,
    table_name: str,
    key: str,
    after: datetime | str | None = None,
    until: datetime | str | None = None,
) -> DataFrame:
    """Logged changes of one table in ``(after, until]`` with the current source row.

    A deleted row has NULL in every source column but its key, which is taken from
    the log. The window's changes are written once, their ids in the type of the key: so
    the log is read once, and the planner and adaptive execution know from the true size
    whether the ids are broadcast to cut the source down where it is scanned. The changed
    source rows are written too, and join the changes by their own true size: broadcast, or
    shuffled by key, where an id with most of the changes is split. More than ``FEW`` changes
    join the source as it is, which is shuffled once either way; very many do so slice by slice
    of the keys and are written, so that the disk holds the shuffle of one slice at a time.
    """
    logged = staged(logged_changes(log, table_name, source.schema[key].dataType, after, until), tight=True)

    def joined(logged: DataFrame, changed: DataFrame) -> DataFrame:
        recovered = F.coalesce(changed[key], logged["_logged_key"]).alias(key)
        return logged.join(changed, logged["_logged_key"] == changed[key], "left").select(
            "log_id", "operation_type", "changed_at", *[recovered if c == key else changed[c] for c in source.columns]
        )

    many = logged.count()
    if many <= FEW:
        return joined(logged, staged(rows_of_keys(source, logged.select(F.col("_logged_key").alias(key)).distinct(), key)))
    slices = slices_of(many)
    if slices == 1:
        return joined(logged, source)
    return staged_parts(
        [joined(logged.filter(in_slice([logged["_logged_key"]], i, slices)), source.filter(in_slice([source[key]], i, slices))) for i in range(slices)], tight=True
    )


def latest_per_key(df: DataFrame, key: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order_by``.

    Planned as a group limit ahead of the shuffle: every task keeps one row per key,
    so a key that holds most of the rows still sends one row per task.
    """
    newest_first = Window.partitionBy(*key).orderBy(*[F.col(c).desc_nulls_last() for c in order_by])
    return df.withColumn("_rank", F.row_number().over(newest_first)).filter(F.col("_rank") == 1).drop("_rank")


def distinct_rows(df: DataFrame) -> DataFrame:
    """Each different row once."""
    return df.distinct()


def same_key(left: DataFrame, right: DataFrame, key: Sequence[str]) -> Column:
    """Equality of all key columns of two frames."""
    return reduce(and_, [left[c] == right[c] for c in key])


def snapshot_diff(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Change rows that turn ``old`` into ``new``: ``operation_type`` and the columns of ``new``.

    Both are snapshots of a table in which ``key`` is unique. A deleted row carries
    its key and NULL elsewhere. Values are compared null-safely.
    """
    values = [c for c in new.columns if c not in key]
    before = old.select(*[F.col(c).alias(f"_old_{c}") for c in new.columns], F.lit(True).alias("_in_old"))
    after = new.withColumn("_in_new", F.lit(True))
    both = before.join(after, reduce(and_, [before[f"_old_{c}"] == after[c] for c in key]), "full_outer")
    differs = reduce(or_, [~F.col(c).eqNullSafe(F.col(f"_old_{c}")) for c in values], F.lit(False))
    operation = (
        F.when(F.col("_in_old").isNull(), INSERT).when(F.col("_in_new").isNull(), DELETE).when(differs, UPDATE)
    )
    keys = {c: F.coalesce(F.col(c), F.col(f"_old_{c}")).alias(c) for c in key}
    return both.select(operation.alias("operation_type"), *[keys.get(c, F.col(c)) for c in new.columns]).filter(
        F.col("operation_type").isNotNull()
    )


def row_digest(df: DataFrame, columns: Sequence[str]) -> Column:
    """128 bits that tell rows of one schema apart by ``columns``; NULL is a value, and 0.0 and -0.0 are one."""
    floats = (DoubleType, FloatType)
    values = [F.col(c) + F.lit(0.0).cast(df.schema[c].dataType) if isinstance(df.schema[c].dataType, floats) else F.col(c) for c in columns]
    named = [v.alias(f"c{i}") for i, v in enumerate(values)]
    return F.unhex(F.md5(F.to_json(F.struct(*named)) if named else F.lit("")))


def wide_snapshot_diff(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """``snapshot_diff`` in two phases, for rows that are wide and mostly unchanged.

    First only keys and row digests are shuffled and compared; what differs is written once
    and fetches its rows from ``new`` by a join of its true size. Rows without a whole key
    match nothing; they pass both phases by and so do not meet in one task.
    """
    values = [c for c in new.columns if c not in key]
    whole = reduce(and_, [F.col(c).isNotNull() for c in key])
    sides = {
        name: df.filter(whole).select(*[F.col(c).alias(f"_{name}_{c}") for c in key], row_digest(df, values).alias(f"_{name}"))
        for name, df in (("old", old.select(*new.columns)), ("new", new))
    }
    met = sides["old"].join(sides["new"], reduce(and_, [F.col(f"_old_{c}") == F.col(f"_new_{c}") for c in key]), "full_outer")
    operation = F.when(F.col("_old").isNull(), INSERT).when(F.col("_new").isNull(), DELETE).when(F.col("_old") != F.col("_new"), UPDATE)
    keys = [F.coalesce(F.col(f"_old_{c}"), F.col(f"_new_{c}")).alias(f"_key_{c}") for c in key]
    differing = staged(met.select(operation.alias("operation_type"), *keys).filter(F.col("operation_type").isNotNull()))
    same = reduce(and_, [new[c] == differing[f"_key_{c}"] for c in key])
    fetched = new.join(differing.filter(F.col("operation_type") != DELETE), same).select("operation_type", *[new[c] for c in new.columns])
    nothing = {c: F.lit(None).cast(new.schema[c].dataType).alias(c) for c in values}
    gone = differing.filter(F.col("operation_type") == DELETE).select(
        "operation_type", *[nothing.get(c, F.col(f"_key_{c}").alias(c) if c in key else None) for c in new.columns]
    )
    keyless_gone = old.filter(~whole).select(F.lit(DELETE).alias("operation_type"), *[nothing.get(c, F.col(c)) for c in new.columns])
    keyless_new = new.filter(~whole).select(F.lit(INSERT).alias("operation_type"), *new.columns)
    return fetched.unionByName(gone).unionByName(keyless_gone).unionByName(keyless_new)
