"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to 8 bits: numbers that grow by orders of magnitude by their
logarithm, ids by their place between the least and the greatest, names by their place in
code point order among all names (NULL last). The index of the resulting cell on the
Hilbert curve orders the rows; consecutive rows are near each other in every dimension at
once, so a shard, a run of them, covers a small range of each and can be skipped by file
statistics. Runs are cut by the law ``rows``: the counts of any two shards differ by at
most one.

Ties on the curve go by id, then by content, so copies and repeated rows spread over as
many shards as they need. A NULL text has no bytes, a NULL id comes first, and an empty
table gives an empty result. Only the named columns take part.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches
from tidemark.operators.keys import with_surrogate_key

BITS = 8
TOP = (1 << BITS) - 1


def curve_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of cells ``(rows, dimensions)``, by undoing the curve's turns bit by bit."""
    x = [cells[:, k].astype(np.int64) for k in range(cells.shape[1])]
    for level in range(bits - 1, 0, -1):
        below = (1 << level) - 1
        for k in range(len(x)):
            turned = (x[k] >> level) & 1 == 1
            swap = np.where(turned, 0, (x[0] ^ x[k]) & below)
            x[0] = np.where(turned, x[0] ^ below, x[0] ^ swap)
            if k:
                x[k] = x[k] ^ swap
    for k in range(1, len(x)):
        x[k] = x[k] ^ x[k - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    index = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in x:
            index = (index << 1) | (((axis ^ turn) >> level) & 1)
    return index


def by_logarithm(column: Column) -> Column:
    return F.least(F.lit(TOP), F.floor(F.log2(F.coalesce(column, F.lit(0)) + 1) * 8)).cast("int")


def _by_range(rows: DataFrame, name: str) -> DataFrame:
    ends = rows.agg(F.min(name).alias("_least"), F.max(name).alias("_most"))
    cell = (F.col(name) - F.col("_least")) * F.lit(float(TOP)) / F.greatest(F.col("_most") - F.col("_least"), F.lit(1))
    return rows.crossJoin(F.broadcast(ends)).withColumn(f"_cell_{name}", F.coalesce(F.floor(cell).cast("int"), F.lit(0))).drop("_least", "_most")


def _by_name(rows: DataFrame, name: str) -> DataFrame:
    """One row per different name meets in a task to be numbered."""
    names = rows.groupBy(F.col(name).alias("_name")).agg(F.count(F.lit(1)).alias("_rows"))
    place, last = F.row_number().over(Window.orderBy(F.col("_name").asc_nulls_last())), F.count(F.lit(1)).over(Window.partitionBy())
    cells = names.select("_name", F.floor((place - 1) * F.lit(TOP) / F.greatest(last - 1, F.lit(1))).cast("int").alias(f"_cell_{name}"))
    return rows.join(cells, F.col(name).eqNullSafe(F.col("_name")), "left").drop("_name")


def ordered(rows: DataFrame, *, logarithms: Sequence[str] = (), ranges: Sequence[str] = (), names: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``curve``, their place on the curve over the named dimensions."""
    kept = rows.columns
    for name in names:
        rows = _by_name(rows, name)
    for name in ranges:
        rows = _by_range(rows, name)
    rows = rows.withColumns({f"_cell_{name}": by_logarithm(F.col(name)) for name in logarithms})
    cells = [f"_cell_{name}" for name in (*names, *logarithms, *ranges)]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grid = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[len(kept) :]], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(curve_index(grid))], [*kept, "curve"])

    return map_batches(rows.select(*kept, *cells), run, f"{schema}, curve bigint")


def cut(placed: DataFrame, shards: int, *, order_by: Sequence[str]) -> DataFrame:
    """``placed`` with ``shard`` (0 to ``shards`` - 1) and ``slot``: runs in the given order, counts at most one apart."""
    total = placed.count()
    base, extra = divmod(total, shards)
    numbered = with_surrogate_key(placed, "_place", order_by)
    at, wide = F.col("_place") - 1, F.lit(base + 1)
    within = at < extra * (base + 1)
    after = at - extra * (base + 1)
    narrow = F.lit(max(base, 1))
    return numbered.select(
        *placed.columns,
        F.when(within, F.floor(at / wide)).otherwise(extra + F.floor(after / narrow)).cast("int").alias("shard"),
        F.when(within, at % wide).otherwise(after % narrow).cast("bigint").alias("slot"),
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in their order, for readers that prune by file statistics."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
