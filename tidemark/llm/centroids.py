"""Clusters around centroids, from a matrix of exact dot products that is kept up to date.

Vectors and centroids are whole numbers, so the distance of a vector v to a centroid c is
|v|^2 - 2 v.c + |c|^2 without any rounding. The products v.c of all centroids are kept with
each vector, in a table that every round writes anew. A round sends out by how much each
component of each centroid has moved; components that stayed are left out, and only what
moved is multiplied with the vectors' components and added to the products. Then the
nearest centroid is the least of |c|^2 - 2 v.c. Sums of a cluster's vectors are taken by
Spark before its shuffle; what reaches the driver is one row per centroid.

Rounds end early once no centroid moves: all later ones would be the same.

Defined cases: vectors that are NULL, of another length, or hold NULL or non-finite
components take no part; neither does any other column. Repeated rows are vectors of their
own. A NULL id draws no seed before all others have; rows of one id are drawn in the order
of their components. Fewer vectors than centroids give as many centroids as vectors.
Components beyond ``LARGEST`` in size are an error, as distances would not fit in 64 bits.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches
from tidemark.operators.staging import release, scratch_folder

LARGEST = 1 << 27
_STATE = "vec_id bigint, v array<int>, norm bigint, dots array<bigint>, cluster int, distance bigint"
RESULT = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"


def usable(vector: Column) -> Column:
    """Not NULL, and every component is a finite number."""
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))


def scaled(rows: DataFrame, *, dimensions: int, scale: int) -> DataFrame:
    """``vec_id, v``: components as whole numbers floor(scale * x)."""
    vector = F.col("embedding").cast("array<double>")
    kept = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), vector.alias("v")).filter((F.size("v") == dimensions) & usable(F.col("v")))
    whole = F.transform("v", lambda x: F.floor(x * F.lit(float(scale))))
    small = F.forall("v", lambda x: F.abs(x) <= LARGEST)
    return kept.select("vec_id", whole.alias("v")).select("vec_id", F.when(small, F.col("v").cast("array<int>")).otherwise(F.raise_error(F.lit("component too large"))).alias("v"))


def seeds(vectors: DataFrame, centroids: int, salt: str) -> np.ndarray:
    """The vectors whose ids have the smallest digests, in the order of these: one row per centroid."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = vectors.select(digest.alias("digest"), "v").orderBy(F.col("digest").asc_nulls_last(), "v").limit(centroids).collect()  # one row per centroid
    return np.array([r["v"] for r in first], np.int64)


def moved(before: np.ndarray, after: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per centroid the components that differ, and by how much."""
    return [(np.flatnonzero(d), d[d != 0]) for d in after - before]


def _write(spark, rows: DataFrame) -> tuple[str, DataFrame]:
    folder = scratch_folder(spark)
    rows.write.option("compression", "zstd").parquet(folder)
    return folder, spark.read.schema(rows.schema).parquet(folder)


def _updated(state: DataFrame, moves: list[tuple[np.ndarray, np.ndarray]], centroids: np.ndarray) -> DataFrame:
    """Products after the centroids have moved, and the nearest centroid of each vector."""
    lengths, dimensions = (centroids**2).sum(axis=1), centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions).astype(np.int64)
            dots = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(centroids)).copy()
            for k, (places, by) in enumerate(moves):
                if len(places):
                    dots[:, k] += vectors[:, places] @ by
            rest = lengths[None, :] - 2 * dots
            nearest = rest.argmin(axis=1)  # the first of equal ones
            distance = batch.column(2).to_numpy(zero_copy_only=False) + rest[np.arange(len(rest)), nearest]
            offsets = pa.array(np.arange(len(dots) + 1, dtype=np.int32) * len(centroids))
            products = pa.ListArray.from_arrays(offsets, pa.array(dots.ravel()))
            columns = [*batch.columns[:3], products, pa.array(nearest.astype(np.int32)), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "v", "norm", "dots", "cluster", "distance"])

    return map_batches(state, run, _STATE)


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor of the mean of each cluster's vectors; a centroid without vectors stays."""
    sums = [F.sum(F.col("v")[j].cast("bigint")).alias(f"s{j}") for j in range(centroids.shape[1])]
    out = centroids.copy()
    for r in state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect():  # one row per centroid
        out[r["cluster"]] = [r[f"s{j}"] // r["n"] for j in range(centroids.shape[1])]
    return out


def cluster(rows: DataFrame, *, centroids: int = 8, rounds: int = 10, dimensions: int = 64, scale: int = 1024, salt: str = "3") -> DataFrame:
    """``RESULT`` of every usable row of ``rows(vec_id, embedding)`` after ``rounds`` rounds and one more assignment."""
    spark = rows.sparkSession
    vectors = scaled(rows, dimensions=dimensions, scale=scale)
    target = seeds(vectors, centroids, salt)
    if not len(target):
        return spark.createDataFrame([], RESULT)
    norm = F.aggregate("v", F.lit(0).cast("bigint"), lambda total, x: total + x.cast("bigint") * x.cast("bigint"))
    nothing = F.array_repeat(F.lit(0).cast("bigint"), len(target))
    state = vectors.select("vec_id", "v", norm.alias("norm"), nothing.alias("dots"), F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"))
    current, last = np.zeros_like(target), None
    for turn in range(rounds + 1):
        folder, state = _write(spark, _updated(state, moved(current, target), target))
        if last is not None:
            release(spark, [last])
        last, current = folder, target
        if turn < rounds:
            target = _means(state, current)
            if (target == current).all():
                break
    inertia = {r["cluster"]: r["inertia"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # one row per centroid
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in current.tolist()]
    of_cluster = F.array(*[F.lit(inertia.get(k, 0)).cast("bigint") for k in range(len(current))])
    digest = F.array(*[F.lit(d) for d in digests])
    return state.select(
        "vec_id",
        "cluster",
        "distance",
        of_cluster[F.col("cluster")].alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("bigint").alias("inertia"),
        digest[F.col("cluster")].alias("centroid_sha256"),
    )
