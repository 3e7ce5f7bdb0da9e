"""One query per operator, each over its whole table with production parameters, and the SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import balltree, bpe, centroids, chat, curriculum, doubling, hilbert, langid, pii, quality, simhash, sketch, whitening
from tidemark.operators.staging import staged


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = staged(simhash.fingerprints(_table(spark, sf_dir, "documents"), shingle=3, bits=64))
    linked = simhash.near_duplicates(marked, "doc_id", bits=64, budgets=((64, 2),))
    return linked.select("doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint"), F.col("component").alias("component_id"))


def op2_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = curriculum.mix(staged(curriculum.sizes(_table(spark, sf_dir, "documents"))))
    placed = curriculum.positions(mixed)
    taken = F.aggregate("turns", F.lit(0).cast("bigint"), lambda total, turn: total + turn["words"])
    first = F.array_min(F.transform("turns", lambda turn: turn["position"]))
    ordered = placed.withColumns({"taken": taken, "first": first}).orderBy(F.col("first").asc_nulls_last(), "doc_id")
    return ordered.select("doc_id", "size", "source_size", "target", "taken")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.learn(docs.filter(~langid.held_out(F.col("doc_id"))))
    predicted = langid.predict(docs, model)
    return predicted.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_balltree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(pii.find(_table(spark, sf_dir, "documents")))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    hard = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    table = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.formatted(chat.as_log(table.unionByName(hard))))


def op7_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = _table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), "source", "lang"
    )
    placed = hilbert.ordered(staged(rows), logarithms=["size"], ranges=["doc_id"], names=["source", "lang"])
    sharded = hilbert.cut(staged(placed), 40, order_by=["curve", "doc_id"])
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprints(_table(spark, sf_dir, "documents"))


def op9_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubling.without_repeats(_table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.learn(docs, labels.filter(~quality.held_out(F.col("doc_id"))))
    scored = quality.predict(docs, model)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"), centroids=8, rounds=_ROUNDS, dimensions=64, scale=1024, salt="3")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), components=16)


_ROUNDS = 10
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_curriculum": op2_curriculum,
    "op3_langid": op3_langid,
    "op4_balltree": op4_balltree,
    "op5_pii": op5_pii,
    "op6_chat": op6_chat,
    "op7_hilbert": op7_hilbert,
    "op8_sketch": op8_sketch,
    "op9_doubling": op9_doubling,
    "op10_bpe": op10_bpe,
    "op11_quality": op11_quality,
    "op12_centroids": op12_centroids,
    "op13_whitening": op13_whitening,
}

# The sums of a source run over all its documents in the order of their draw, and the excess
# over the limits is shared in rounds written out as one level.
_MIX = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(COALESCE(LEN(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS draw
  FROM documents
), sources AS (
  SELECT source, CAST(SUM(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM sized GROUP BY source
), levels AS (
  SELECT o.source, o.source_size, o.weight,
    (SELECT 1.5::DOUBLE * SUM(a.source_size) - COALESCE(SUM(CASE WHEN 2.0::DOUBLE * a.source_size / a.weight < 2.0::DOUBLE * o.source_size / o.weight THEN 2.0::DOUBLE * a.source_size END), 0) FROM sources a)
    / (SELECT SUM(CASE WHEN 2.0::DOUBLE * a.source_size / a.weight < 2.0::DOUBLE * o.source_size / o.weight THEN 0 ELSE a.weight END) FROM sources a) AS level
  FROM sources o
), planned AS (
  SELECT s.source, s.source_size, LEAST(2.0::DOUBLE * s.source_size, s.weight * (
    SELECT arg_min(l.level, 2.0::DOUBLE * l.source_size / l.weight) FROM levels l WHERE l.level * l.weight <= 2.0::DOUBLE * l.source_size)) AS target
  FROM sources s
), begun AS (
  SELECT d.doc_id, d.size, p.source_size, p.target,
    CAST(COALESCE(SUM(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begun
  FROM sized d JOIN planned p ON d.source IS NOT DISTINCT FROM p.source
), parts AS (
  SELECT *, CAST(floor(target + 0.5::DOUBLE) AS BIGINT) AS words FROM begun
)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE (words // source_size) * size
    + GREATEST(0, LEAST(size, words % source_size - begun)) END AS taken
FROM parts
"""

_TOP = """
WITH whole AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.r AS asked, q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.r <> c.r
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY asked ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

_CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(COALESCE(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(COALESCE(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(20 + length(regexp_replace(role, '(\\|<turn>|</turn>|### |:)', '\\\1', 'g'))
    + length(regexp_replace(text, '(\\|<turn>|</turn>|### )', '\\\1', 'g'))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""


def _clusters(rounds: int) -> str:
    """Each round written out: plain distances to all centroids, then sums by component."""
    parts = [
        """kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS k, v FROM (
    SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS h, v FROM kept ORDER BY h NULLS LAST, v LIMIT 8)
)"""
    ]
    for t in range(rounds + 1):
        parts.append(
            f"""a{t} AS MATERIALIZED (
  SELECT r, min(struct_pack(d := CAST(list_sum(list_transform(list_zip(kept.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT), k := k)) AS best
  FROM kept, c{t} c GROUP BY r
)"""
        )
        if t < rounds:
            parts.append(
                f"""s{t} AS MATERIALIZED (
  SELECT best.k AS k, j, CAST(sum(v[j]) AS BIGINT) AS s, count(*) AS n
  FROM a{t} JOIN kept USING (r), generate_series(1, 64) AS places(j) GROUP BY best.k, j
), m{t} AS MATERIALIZED (
  SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM s{t} GROUP BY k
), c{t + 1} AS MATERIALIZED (
  SELECT c.k, COALESCE(m.v, c.v) AS v FROM c{t} c LEFT JOIN m{t} m ON c.k = m.k
)"""
            )
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(c.k AS INTEGER) AS cluster, best.d AS distance,
  CAST(sum(best.d) OVER (PARTITION BY c.k) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN c{rounds} c ON c.k = best.k"""


ORACLES: dict[str, str] = {"op2_curriculum": _MIX, "op4_balltree": _TOP, "op6_chat": _CHAT, "op12_centroids": _clusters(_ROUNDS)}
