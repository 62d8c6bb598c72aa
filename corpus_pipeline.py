"""From raw documents to token ids: toxic texts out, one of each near-duplicate group, personal data masked, sources
mixed to their weights in training order, and encoded.

``STAGES`` lists the stages; ``run`` applies them to ``documents``, each result
written as Parquet and read again as the next one's input.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcloom.llm import byte_bpe, jaccard_join, mixing, pii, toxicity
from arcloom.llm.queries import remainder
from arcloom.llm.registry import query, table
from arcloom.session import cut_lineage, remove, scratch_path, scratch_scope, ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
TOXIC = 0.7
WEIGHTS = (3, 1, 2)


def _stage(step: Stage) -> Stage:
    @wraps(step)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return step(spark, docs, sf_dir)
    return run_step


def _recount(docs: DataFrame) -> DataFrame:
    """``n_chars`` of texts that have changed; NULL texts keep what they had."""
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text").cast("bigint"), F.col("n_chars")))


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``TOXIC``; the lexicon is learned from the labelled ones that are not held out."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder(3) != 1)
    scored = toxicity.score(docs, model, score="__toxicity", hits="__hits")
    return scored.filter(F.col("__toxicity") < TOXIC).drop("__toxicity", "__hits")


@_stage
def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    return jaccard_join.keep_one(docs)


@_stage
def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    spans = cut_lineage(pii.find(docs), "pii-spans")  # texts are searched once
    return _recount(pii.redact(pii.detect(spans, pii.fit(spans), spans="__spans"), spans="__spans"))


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order; the last use of a source may be cut short."""
    return _recount(mixing.schedule(docs, WEIGHTS))


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) of every document, and whether they decode to its text."""
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    back = byte_bpe.encode(docs.select("doc_id", "lang", "source", "text"), vocabulary, public_tokenizers.PATTERN, decoded="decoded")
    return back.select("doc_id", "lang", "source", byte_bpe.n_tokens("ids").alias("n_tokens"), "ids",
                       (F.coalesce(F.col("text"), F.lit("")).cast("binary") == F.col("decoded")).alias("exact"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_copy),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

# the learned stages cannot be said in SQL
ORACLE_SQL: str | None = None


@query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, step in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        with scratch_scope():  # what a stage writes on its way is not needed once its result is
            step(spark, docs, sf_dir).write.parquet(path)
        if before:  # nor is what it has read
            remove(before)
        docs, before = spark.read.parquet(path), path
    return docs
