"""What several operators share."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.staging import scratch_folder

# Fixed value: a word is a run of anything but these six space characters.
WORD = r"[^\x20\x09-\x0D]+"


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark application, through Spark's own file server."""
    context = spark.sparkContext
    if getattr(context, "_tidemark_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    with tempfile.TemporaryDirectory() as folder:
        copy = shutil.copytree(package, f"{folder}/tree/{package.name}", ignore=shutil.ignore_patterns("__pycache__"))
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='tidemark-package-')}/{package.name}", "zip", copy.rpartition("/")[0])
    context.addPyFile(archive)
    context._tidemark_shipped = True


def map_batches(rows: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` with this package at hand in the workers."""
    ship(rows.sparkSession)
    return rows.mapInArrow(function, schema)


def compact(rows: DataFrame) -> DataFrame:
    """``rows`` written once to the shared scratch folder, tightly compressed, and read back."""
    folder = scratch_folder(rows.sparkSession)
    rows.write.option("compression", "zstd").parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def in_parts(docs: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` over record batches cut to at most ``_ROWS`` rows, so that few long texts are Python objects at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cut() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, _ROWS):
                    yield batch.slice(start, _ROWS)

        return function(cut())

    return map_batches(docs, run, schema)


_ROWS = 512
