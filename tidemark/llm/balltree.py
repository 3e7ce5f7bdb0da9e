"""Exact top-k by inner product with ball trees, one per shard.

Vectors are laid out by the signs of their products with fixed directions and cut into
shards by range, so that a shard holds vectors that point alike and a vector of many copies
is split. A shard's task builds a ball tree over its vectors and streams the queries through
it in blocks. No vector in a node can have a higher inner product with a query than
``query . centre + |query| * radius``; nodes are taken by the highest bound of the queries
that still need them, and a query drops out of a node whose bound is below its k-th score so
far. A node whose bound equals the k-th score is still searched, so ties are settled by id.

The same bound, for a whole shard, decides which queries are sent there. Every query first
searches the shard of its highest bound; the shards whose bound reaches its k-th score follow
in waves by falling bound, ``GROWTH`` times as many in each, and between waves the k-th scores
of all shards so far are shared.

Components are turned into whole numbers by ``floor(256 * x)``; scores are exact as long as
they fit 63 bits. Vectors that are NULL or hold a NULL or non-finite component, and rows
without id, take no part. Shorter vectors count as filled up with zeros. Every row that is
asked for is answered, and every row but itself is a candidate: rows that share an id are
queries and candidates each for itself. Extra columns are left out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches
from tidemark.operators.staging import staged

LEAF, SHARD_BYTES, BLOCK = 64, 4 << 20, 1024  # bytes of a shard's vectors as doubles
ROOTS = 4096  # shards whose bounds one task holds at a time
GROWTH = 8  # how many times as many shards each wave reaches
DIRECTIONS = 24  # fixed directions by whose signs vectors are laid out
_NONE = -np.iinfo(np.int64).max


def _matrix(column: pa.Array, *, whole: bool = True) -> np.ndarray:
    """Vectors as rows of doubles of one width, made whole numbers unless they are to stay as they are."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    values = np.floor(256.0 * values) if whole else values
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = values
    return out


def _wider(matrix: np.ndarray, width: int) -> np.ndarray:
    return np.pad(matrix, ((0, 0), (0, width - matrix.shape[1]))) if width > matrix.shape[1] else matrix


def _products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles while every sum stays below 2^53, else in 64-bit integers."""
    most = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * max(queries.shape[1], 1)
    if most < 2**53:
        return (queries @ vectors.T).astype(np.int64)
    return queries.astype(np.int64) @ vectors.astype(np.int64).T


def _slack(norms: np.ndarray, most: float | np.ndarray, width: int) -> np.ndarray:
    """What rounding may take from a bound, generously."""
    return 1.0 + 1e-9 * norms * most * max(width, 1)


class BallTree:
    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.rows, self.ids, self.vectors = rows, ids, vectors
        self.nodes: list[tuple[int, int, np.ndarray, float, int]] = []  # begin, end, centre, radius, place of the children
        self._build()

    def _ball(self, members: np.ndarray) -> tuple[np.ndarray, float]:
        centre = self.vectors[members].mean(axis=0)
        return centre, float(np.sqrt(((self.vectors[members] - centre) ** 2).sum(axis=1).max()))

    def _build(self) -> None:
        place = np.arange(len(self.ids))
        self.nodes.append((0, len(place), *self._ball(place), 0))
        todo = [0]
        while todo:
            node = todo.pop()
            begin, end, centre, radius, _ = self.nodes[node]
            if end - begin <= LEAF:
                continue
            members = place[begin:end]
            away = self.vectors[members]
            far = away[((away - centre) ** 2).sum(axis=1).argmax()]
            other = away[((away - far) ** 2).sum(axis=1).argmax()]
            middle = (end - begin) // 2
            place[begin:end] = members[np.argpartition(away @ (other - far), middle)]
            child = len(self.nodes)
            self.nodes[node] = (begin, end, centre, radius, child)
            for lo, hi in ((begin, begin + middle), (begin + middle, end)):
                self.nodes.append((lo, hi, *self._ball(place[lo:hi]), 0))
            todo += [child, child + 1]
        self.vectors, self.ids, self.rows = self.vectors[place], self.ids[place], self.rows[place]

    def search(self, rows: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of each query's k best, down to its floor; unused places score ``_NONE``."""
        best = np.full((len(rows), k), _NONE)
        named = np.full((len(rows), k), np.iinfo(np.int64).max)
        norms = np.sqrt((queries**2).sum(axis=1))
        slack = _slack(norms, float(np.abs(self.vectors).max(initial=0)), queries.shape[1])

        def bound(node: int, asking: np.ndarray) -> np.ndarray:
            _, _, centre, radius, _ = self.nodes[node]
            return queries[asking] @ centre + norms[asking] * radius + slack[asking]

        everyone = np.arange(len(rows))
        first = bound(0, everyone)
        heap = [(-first.max(initial=0), 0, everyone, first)]
        while heap:
            _, node, asking, bounds = heapq.heappop(heap)
            still = bounds >= np.maximum(floors[asking], best[asking, -1])
            asking = asking[still]
            if not len(asking):
                continue
            begin, end, _, _, child = self.nodes[node]
            if child:
                for side in (child, child + 1):
                    bounds = bound(side, asking)
                    heapq.heappush(heap, (-bounds.max(), side, asking, bounds))
                continue
            scores = _products(queries[asking], self.vectors[begin:end])
            scores[rows[asking][:, None] == self.rows[None, begin:end]] = _NONE
            useful = scores.max(axis=1) >= np.maximum(floors[asking], best[asking, -1])
            asking, scores = asking[useful], scores[useful]
            both = np.concatenate([best[asking], scores], axis=1)
            names = np.concatenate([named[asking], np.broadcast_to(self.ids[begin:end], scores.shape)], axis=1)
            order = np.lexsort((names, -both), axis=1)[:, :k]
            best[asking], named[asking] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)
        return best, named


def _meet(held: DataFrame, asked: DataFrame, place: str, build, answer, schema: str) -> DataFrame:
    """``answer(build(what is held at a place), queries)`` for every portion of queries that was sent to that place.

    Both sides have the same columns, ``place`` first; what is held comes first within a place.
    """
    both = held.withColumn("kind", F.lit(0)).unionByName(asked.withColumn("kind", F.lit(1)))
    dealt = both.repartition(place).sortWithinPartitions(place, "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, parts, built = None, [], None
        for batch in batches:
            places, kinds = batch.column(place).to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(places) != 0) | (np.diff(kinds) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                for at in range(lo, hi, BLOCK):
                    piece = batch.slice(at, min(BLOCK, hi - at))
                    if places[at] != here:
                        here, parts, built = places[at], [], None
                    if kinds[at] == 0:
                        parts.append(piece)
                    elif parts:
                        built = build({c: pa.concat_arrays([p.column(c) for p in parts]) for c in piece.schema.names}) if built is None else built
                        yield answer(built, piece)

    return map_batches(dealt, run, schema)


def _search(rows: DataFrame, sent: DataFrame, k: int) -> DataFrame:
    """Candidates ``(query, vec_id, score)`` of every query in the shards of ``rows`` that it was sent to."""
    held = rows.select("shard", "row", "vec_id", "embedding", F.lit(None).cast("bigint").alias("floor"))
    asked = sent.select("shard", F.col("query").alias("row"), F.lit(None).cast("bigint").alias("vec_id"), "embedding", "floor")

    def build(stored: dict[str, pa.Array]) -> BallTree:
        return BallTree(stored["row"].to_numpy(), stored["vec_id"].to_numpy(), _matrix(stored["embedding"]))

    def answer(tree: BallTree, piece: pa.RecordBatch) -> pa.RecordBatch:
        width = tree.vectors.shape[1]
        queries = _wider(_matrix(piece.column("embedding")), width)[:, :width]  # what a shard has no component for adds nothing
        numbers, floors = piece.column("row").to_numpy(), piece.column("floor").fill_null(_NONE).to_numpy()
        best, named = tree.search(numbers, queries, floors, k)
        found = best > _NONE
        columns = [np.broadcast_to(numbers[:, None], best.shape)[found], named[found], best[found]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query", "vec_id", "score"])

    return _meet(held, asked, "shard", build, answer, "query bigint, vec_id bigint, score bigint")


def _laid_out(rows: DataFrame, shards: int) -> DataFrame:
    """``rows(row, vec_id, embedding)`` written in shards of vectors that point alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("embedding"))
            directions = np.random.default_rng(0).normal(size=(vectors.shape[1], DIRECTIONS))  # the same for any width
            code = ((vectors @ directions) > 0) @ (1 << np.arange(DIRECTIONS, dtype=np.int64)[::-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code, pa.int64())], [*batch.schema.names, "code"])

    coded = map_batches(rows, run, "row bigint, vec_id bigint, embedding array<double>, code bigint")
    dealt = coded.repartitionByRange(shards, "code", F.xxhash64("row")).withColumn("shard", F.spark_partition_id())
    return staged(dealt.drop("code"))


def _balls(rows: DataFrame) -> DataFrame:
    """Balls ``(shard, centre, radius, most)`` around all vectors of each shard, one for each portion of it that a task reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            cuts = np.flatnonzero(np.diff(shards)) + 1
            out = []
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                vectors = _matrix(batch.column("embedding").slice(lo, hi - lo)) if hi > lo else None
                if vectors is not None:
                    centre = vectors.mean(axis=0)
                    out.append((int(shards[lo]), centre, float(np.sqrt(((vectors - centre) ** 2).sum(axis=1).max())), float(np.abs(vectors).max(initial=0))))
            if out:
                types = (pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["shard", "centre", "radius", "most"])

    return map_batches(rows.select("shard", "embedding"), run, "shard int, centre array<double>, radius double, most double")


def _bounds(balls: DataFrame, queries: DataFrame, blocks: int, *, nearest: bool) -> DataFrame:
    """``(query, shard, bound)``: of each block of shards the one of the highest bound, or all that reach the floor but ``first``."""
    block = F.pmod("shard", F.lit(blocks)).alias("block")
    none = F.lit(None)
    held = balls.select(block, F.col("shard").cast("bigint").alias("row"), F.col("centre").alias("embedding"), "radius", "most", none.cast("bigint").alias("floor"), none.cast("int").alias("first"))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    floor, first = (none.cast("bigint"), none.cast("int")) if nearest else (F.col("floor"), F.col("first"))
    asked = queries.select(everywhere, F.col("query").alias("row"), "embedding", none.cast("double").alias("radius"), none.cast("double").alias("most"), floor.alias("floor"), first.alias("first"))

    def build(stored: dict[str, pa.Array]) -> tuple[np.ndarray, ...]:
        order = np.argsort(stored["row"].to_numpy(), kind="stable")
        shards = stored["row"].to_numpy()[order]
        begins = np.flatnonzero(np.concatenate([[True], np.diff(shards) != 0]))
        return shards[begins], begins, _matrix(stored["embedding"], whole=False)[order], stored["radius"].to_numpy()[order], stored["most"].to_numpy()[order]

    def answer(roots: tuple[np.ndarray, ...], piece: pa.RecordBatch) -> pa.RecordBatch:
        shards, begins, centres, radius, most = roots
        asking = _matrix(piece.column("embedding"))
        width = max(asking.shape[1], centres.shape[1])
        asking = _wider(asking, width)
        norms = np.sqrt((asking**2).sum(axis=1))[:, None]
        bound = np.maximum.reduceat(asking @ _wider(centres, width).T + norms * radius + _slack(norms, most, width), begins, axis=1)
        if nearest:
            at, to = np.arange(len(asking)), bound.argmax(axis=1)
        else:
            first = piece.column("first").fill_null(-1).to_numpy()
            at, to = np.nonzero((bound >= piece.column("floor").fill_null(_NONE).to_numpy()[:, None]) & (shards != first[:, None]))
        columns = [pa.array(piece.column("row").to_numpy()[at]), pa.array(shards[to], pa.int32()), pa.array(bound[at, to])]
        return pa.RecordBatch.from_arrays(columns, ["query", "shard", "bound"])

    return _meet(held, asked, "block", build, answer, "query bigint, shard int, bound double")


def _best(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _with_floors(queries: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """Queries with the k-th score found so far, NULL while there are fewer."""
    return queries.join(best.filter(F.col("rank") == k).select("query", F.col("score").alias("floor")), "query", "left")


def reached(balls: DataFrame, queries: DataFrame, blocks: int) -> DataFrame:
    """The shards after ``first`` whose bound reaches a query's floor, numbered by falling bound from 1."""
    falling = Window.partitionBy("query").orderBy(F.desc("bound"), "shard")
    return _bounds(balls, queries, blocks, nearest=False).withColumn("turn", F.row_number().over(falling))


def top_k(vectors: DataFrame, asked: Column, *, k: int = 5, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows of ``vectors(vec_id, embedding)`` that ``asked`` (a Column) selects."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").filter(sound)
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()).select("row", "vec_id", "embedding"))
    held = rows.agg(F.sum(8 * F.size("embedding"))).first()[0] or 0
    rows = _laid_out(rows, max(1, -(-held // shard_bytes)))
    queries = staged(rows.filter(asked).select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), "embedding"))
    balls = staged(_balls(rows))
    shards = balls.agg(F.count_distinct("shard")).first()[0]
    blocks = max(1, -(-shards // ROOTS))
    first = _bounds(balls, queries, blocks, nearest=True).groupBy("query").agg(F.max_by("shard", F.struct("bound", -F.col("shard"))).alias("first"))
    queries = staged(queries.join(first, "query"))
    sent = queries.select("query", "embedding", F.col("first").alias("shard"), F.lit(None).cast("bigint").alias("floor"))
    best = staged(_best(_search(rows, sent, k), k))
    if shards > 1:
        todo = staged(reached(balls, _with_floors(queries, best, k), blocks))
        last, done, upto = todo.agg(F.max("turn")).first()[0] or 0, 0, GROWTH - 1
        while done < last:
            wave = todo.filter((F.col("turn") > done) & (F.col("turn") <= upto)).select("query", "shard", "bound")
            sent = wave.join(_with_floors(queries.drop("first"), best, k), "query").filter("floor IS NULL OR bound >= floor")
            best = staged(_best(best.drop("rank").unionByName(_search(rows, sent, k)), k))
            done, upto = upto, upto * GROWTH
    return best.join(queries.select("query", "query_id"), "query").select("query_id", "rank", "vec_id", "score")
