"""Write an intermediate result once and read it back."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

# Rows of a shuffled step that are worked on at once, about, and how often its inputs are read at most.
SLICE = 25_000_000
MOST_SLICES = 8
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_noted: ContextVar[list[str] | None] = ContextVar("noted", default=None)


@contextmanager
def noting_scratch() -> Iterator[list[str]]:
    """The scratch folders that are taken within, so that their owner can release them."""
    folders: list[str] = []
    before = _noted.set(folders)
    try:
        yield folders
    finally:
        _noted.reset(before)


def release(spark: SparkSession, folders: Iterable[str]) -> None:
    """Remove scratch folders that nothing will read again."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Have Spark's cleaner remove the shuffle files of steps that have been written: it acts on what the JVM collects."""
    spark._jvm.System.gc()


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query go when it ends, not when the JVM next collects what held them; the session's own setting comes back."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


@contextmanager
def scratch_released(spark: SparkSession) -> Iterator[None]:
    """Scratch folders that are taken within go at the end: for steps whose results are written by then."""
    with noting_scratch() as folders:
        try:
            yield
        finally:
            release(spark, folders)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below the session's shared checkpoint folder, which every executor must see."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = f"{shared.rstrip('/')}/tidemark-{uuid.uuid4().hex}"
    if (noted := _noted.get()) is not None:
        noted.append(folder)
    return folder


def tightly(writer: DataFrameWriter) -> DataFrameWriter:
    """A writer of Parquet that stays: zstd, and texts and numbers told by what differs from the row before."""
    return writer.option("compression", "zstd").option("parquet.writer.version", "v2")


def staged(df: DataFrame, *, tight: bool = False) -> DataFrame:
    """``df`` written to Parquet and read back; ``tight`` is for what stays for long.

    The rows are then fixed (a lost executor cannot change them), the upstream plan
    runs once, columns can be pruned, and the planner knows the true size, which is
    what decides whether a join may broadcast it.
    """
    return staged_parts([df], tight=tight)


def staged_parts(parts: Sequence[DataFrame], *, tight: bool = False) -> DataFrame:
    """``parts`` of one schema written one after the other, so that only one's shuffle takes room at a time, and read back as one."""
    spark, folder = parts[0].sparkSession, scratch_folder(parts[0].sparkSession)
    for part in parts:
        (tightly(part.write) if tight else part.write).mode("append").parquet(folder)
    return spark.read.schema(parts[0].schema).parquet(folder)


def slices_of(rows: int) -> int:
    """In how many slices a step over so many rows is worked on, each of which reads its inputs."""
    return max(1, min(MOST_SLICES, -(-rows // SLICE)))


def in_slice(values: Sequence[Column], which: int, of: int) -> Column:
    """Whether a row is in slice ``which``: rows of equal ``values`` of equal types are in one slice, NULL is a value."""
    return F.pmod(F.xxhash64(*values), F.lit(of)) == which
