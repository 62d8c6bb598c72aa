"""The dealt operators over the driver tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcloom.llm import byte_bpe, embed_dedup, fingerprints, jaccard_join, language, mixing, pii, quality, sharding, toxicity
from arcloom.llm.registry import query, table
from arcloom.session import cut_lineage


def remainder(modulus: int, id_column: str = "doc_id") -> Column:
    """crc32 of the id as text; rows are held out by it."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % modulus


@query("op2_feistel_shards")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 16, seed=20)


@query("op5_byte_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = byte_bpe.encode(docs, vocabulary, public_tokenizers.PATTERN, splits="n_split", decoded="decoded")
    return back.select("doc_id", byte_bpe.n_tokens("ids").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"), "n_split")


@query("op6_language_centroids")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(remainder(4) == 2, F.lit(False))
    model = language.fit(docs, remainder(4) != 2)
    found = language.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '/' || md5(coalesce(text, ''))) AS place
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w
  FROM d GROUP BY source),
r AS (
  SELECT *, row_number() OVER o AS nth, source_size * 2.0::DOUBLE / w AS reach,
         coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_size,
         sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w,
         sum(source_size) OVER () AS whole
  FROM s WINDOW o AS (ORDER BY source_size / w, source NULLS LAST)),
-- sources in the order in which they reach their limit: the first one that need not stop sets the level of all after it
f AS (
  SELECT (1.5::DOUBLE * CAST(whole AS DOUBLE) - 2.0::DOUBLE * CAST(full_size AS DOUBLE)) / rest_w AS level
  FROM r WHERE (1.5::DOUBLE * CAST(whole AS DOUBLE) - 2.0::DOUBLE * CAST(full_size AS DOUBLE)) / rest_w <= reach
  ORDER BY nth LIMIT 1),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, w * level) AS target FROM r, f),
p AS (
  SELECT doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) AS goal, place, source_rank,
         CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead
  FROM d JOIN (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_rank FROM t) t
    ON d.source IS NOT DISTINCT FROM t.source),
-- uses: of the words that the source's demand has reached by the end, each pass over the source is one turn
u AS (
  SELECT doc_id, place, source_rank, turn, (ahead + source_size * turn) / target AS share,
         least(size, greatest(goal - ahead - source_size * turn, 0)) AS words
  FROM p, (SELECT unnest([0, 1]) AS turn)),
-- the three weight schedules, flat, rising from 0.5 over 1 at the middle to 1.5, falling from 1.5 to 0.5, integrate to 1;
-- demand is inverted piece by piece: w0 x + slope x^2 / 2 = what the piece still needs
v AS (
  SELECT *, CASE source_rank % 3
    WHEN 0 THEN least(share, 1.0::DOUBLE)
    WHEN 1 THEN CASE WHEN least(share, 1.0::DOUBLE) <= 0.375 THEN 2 * least(share, 1.0::DOUBLE) / (0.5 + sqrt(0.25 + 2 * least(share, 1.0::DOUBLE)))
                     ELSE 0.5 + 2 * (least(share, 1.0::DOUBLE) - 0.375) / (1 + sqrt(1 + 2 * (least(share, 1.0::DOUBLE) - 0.375))) END
    ELSE 2 * least(share, 1.0::DOUBLE) / (1.5 + sqrt(greatest(2.25 - 2 * least(share, 1.0::DOUBLE), 0))) END AS position
  FROM u WHERE words > 0),
o AS (SELECT *, row_number() OVER (ORDER BY position, place, turn) - 1 AS nth FROM v),
q AS (
  SELECT doc_id, sum(words) AS taken, min(position) AS first_position, max(position) AS last_position, min(nth) AS first_rank
  FROM o GROUP BY doc_id)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, round(first_position, 9) AS first_position,
       round(last_position, 9) AS last_position, first_rank
FROM p LEFT JOIN q USING (doc_id)"""


@query("op8_curriculum_mix", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    # positions come from each source's inverted demand, taken words from its uses
    return mixing.plan(docs, (3, 1, 2)).select(
        "doc_id", "size", "source_size", "target", "taken", F.round("first_position", 9).alias("first_position"),
        F.round("last_position", 9).alias("last_position"), "first_rank")


@query("op3_quality_neighbours")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), remainder(3) != 1)
    found = quality.score(docs, model)
    return found.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"), "nearest")


@query("op4_toxic_lexicon")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder(3) != 1)
    found = toxicity.score(docs, model)
    return found.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "score",
                        (F.col("score") >= 0.7).cast("int").alias("predicted"), "hits")


@query("op9_order_minhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.compare_edited(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint",
                        "edited_fingerprint", "near_edited", "near_next")


@query("op10_weak_supervision_pii")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    # texts are searched once; learning and deciding read the spans
    spans = cut_lineage(pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "pii-spans")
    found = pii.detect(spans, pii.fit(spans))
    base = F.filter("spans", lambda s: s["base"])
    counts = [pii.count_base(F.col("spans"), kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.digest(base), 256).alias("base_sha256"),
                        pii.digest(F.col("spans")).alias("spans"))


@query("op7_int8_tiles")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.95)


@query("op1_jaccard_join")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(table(spark, sf_dir, "documents")).drop("component", "content")
