"""Registry of the queries over the driver tables, and shared projections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcloom.schema import RECORD_COLUMNS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` computes the same from the same tables."""
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fill_records(df: DataFrame) -> DataFrame:
    """Give a projection all record columns, absent ones as NULL."""
    return df.select(*[
        (F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in RECORD_COLUMNS.items()
    ])


def k_of(props: str = "props") -> Column:
    return F.get_json_object(props, "$.k").cast("bigint")


def micros(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as archive records: one archive per source, the text as payload."""
    d = table(spark, sf_dir, "documents")
    return fill_records(d.select(
        F.col("source").alias("file_path"),
        F.substring("source", 4, 10).cast("int").alias("file_seq"),
        F.col("doc_id").alias("record_seq"),
        F.concat(F.lit("urn:doc:"), F.col("doc_id")).alias("record_id"),
        F.lit("response").alias("rec_type"),
        F.concat(F.lit("http://"), F.col("source"), F.lit(".example/"), F.col("doc_id")).alias("target_uri"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id")).alias("warc_date"),
        F.col("n_chars").alias("content_length"),
        F.md5("text").alias("payload_digest"),
        F.when(F.col("doc_id") > 0, F.concat(F.lit("urn:doc:"), F.col("doc_id") - 1)).alias("concurrent_to"),
    ))


# the same projection for the oracles
SQL_DOCS = """docs AS (
  SELECT source, CAST(substr(source, 4) AS BIGINT) AS file_seq, doc_id, n_chars, md5(text) AS digest,
         'urn:doc:' || doc_id AS record_id,
         'http://' || source || '.example/' || doc_id AS target_uri
  FROM documents),
firsts AS (
  SELECT *, row_number() OVER (PARTITION BY digest ORDER BY file_seq, doc_id) AS nth,
         first_value(record_id) OVER (PARTITION BY digest ORDER BY file_seq, doc_id) AS first_id,
         first_value(target_uri) OVER (PARTITION BY digest ORDER BY file_seq, doc_id) AS first_uri,
         first_value(doc_id) OVER (PARTITION BY digest ORDER BY file_seq, doc_id) AS first_doc
  FROM docs)"""
