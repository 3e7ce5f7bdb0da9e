"""Merge change files as they arrive; the stream's checkpoint replaces the file ledger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType, TimestampNTZType

from tidemark.operators.changes import latest_per_key
from tidemark.operators.staging import staged
from tidemark.sinks.tables import CatalogTable, VersionedTable


def stream_changes(
    spark: SparkSession, path: str, schema: StructType, *, max_files_per_trigger: int | None = None
) -> DataFrame:
    """Change files below ``path``, each read once per checkpoint, oldest first."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def once_per_entry(changes: DataFrame, *, entry: str = "log_id", time: str = "changed_at", delay: str = "1 day") -> DataFrame:
    """Each log entry once, also if a file that holds it is delivered again in a later batch.

    The state store remembers the entries of the last ``delay`` of ``time``; a copy that comes
    later than that after its first is not recognised, but merging it again changes nothing
    unless the row has changed since.
    """
    if changes.schema[time].dataType == TimestampNTZType():  # watermarks are kept on instants
        changes = changes.withColumn(time, F.col(time).cast("timestamp"))
    return changes.withWatermark(time, delay).dropDuplicatesWithinWatermark([entry])


def run_merge_stream(
    changes: DataFrame,
    target: VersionedTable | CatalogTable | str,
    *,
    key: Sequence[str],
    order_by: Sequence[str],
    checkpoint: str,
    mode: str = "strict",
) -> StreamingQuery:
    """Merge everything that has arrived into a table (a path is that of a versioned one), then stop.

    ``changes`` has ``operation_type`` and the table's columns; others are left out. Each
    micro-batch is committed under its number, so a batch that is repeated after a failure is
    not applied twice. Starting over needs a new checkpoint folder. Batches are merged one
    after another: with ``upsert`` the result does not depend on where one ends.
    """
    root = target if isinstance(target, str) else target.root if isinstance(target, VersionedTable) else None

    def merge_batch(batch: DataFrame, number: int) -> None:
        table = target if root is None else VersionedTable(batch.sparkSession, root)
        batch_id = f"{checkpoint}#{number}"
        if table.has_batch(batch_id):
            return
        latest = staged(latest_per_key(batch, key, order_by))
        table.merge(latest, key, mode=mode, checked=True, batch_id=batch_id)

    query = (
        changes.writeStream.foreachBatch(merge_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
