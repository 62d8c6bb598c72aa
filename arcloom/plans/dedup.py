"""Merging archives: report, records, and what the merge leaves dangling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcloom.functions.text import iso_date
from arcloom.operators import dedup, records
from arcloom.operators.skew import ordered_scan
from arcloom.plans.base import SQL_DOCS, document_records, query


@query("dedup_report", f"""
WITH {SQL_DOCS},
t AS (SELECT count(*) FILTER (nth = 1) AS unique_records,
             CAST(coalesce(sum(n_chars) FILTER (nth = 1), 0) AS BIGINT) AS unique_bytes,
             count(*) FILTER (nth > 1) AS revisit_records,
             CAST(coalesce(sum(n_chars) FILTER (nth > 1), 0) AS BIGINT) AS revisit_bytes FROM firsts)
SELECT *, round(unique_records / nullif(unique_records + revisit_records, 0), 6) AS ratio_records,
       round(unique_bytes / nullif(unique_bytes + revisit_bytes, 0), 6) AS ratio_bytes FROM t""")
def dedup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup.dedup_report(document_records(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("ratio_records", "ratio_bytes")})


@query("dedup_records", f"""
WITH {SQL_DOCS}
SELECT file_seq, doc_id AS record_seq, target_uri, digest,
       CASE WHEN nth > 1 THEN 'revisit' ELSE 'response' END AS rec_type,
       CASE WHEN nth > 1 THEN first_id ELSE '' END AS refers_to,
       CASE WHEN nth > 1 THEN first_uri ELSE '' END AS refers_to_uri,
       CASE WHEN nth > 1 THEN strftime(TIMESTAMP '2024-01-01' + to_seconds(first_doc), '%Y-%m-%dT%H:%M:%SZ')
            ELSE '' END AS refers_to_date,
       CASE WHEN nth > 1 THEN 'length' ELSE '' END AS truncated
FROM firsts""")
def dedup_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = dedup.merge_archives(document_records(spark, sf_dir))
    text = lambda c: F.coalesce(c, F.lit("")).alias
    return merged.select(
        F.col("file_seq").cast("bigint").alias("file_seq"), "record_seq", "target_uri",
        F.col("payload_digest").alias("digest"), "rec_type",
        text("refers_to")("refers_to"), text("refers_to_uri")("refers_to_uri"),
        text(iso_date(F.col("refers_to_date")))("refers_to_date"), text("truncated")("truncated"),
    )


@query("dangling_refs", f"""
WITH {SQL_DOCS},
links AS (SELECT 'urn:doc:' || (doc_id - 1) AS target FROM firsts WHERE nth = 1 AND doc_id > 0)
SELECT 'concurrent_to' AS link, target, count(*) AS n_records FROM links
WHERE target NOT IN (SELECT record_id FROM firsts WHERE nth = 1) GROUP BY target""")
def dangling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = dedup.merge_archives(document_records(spark, sf_dir))
    return records.dangling_links(merged).select("link", "target", "n_records")


@query("revisit_chains", f"""
WITH {SQL_DOCS}
SELECT doc_id, first_doc FROM firsts WHERE nth > 1""")
def revisit_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each copy refers to the copy before it, as after merging one archive at a time; resolved to the first."""
    docs = document_records(spark, sf_dir)
    place = F.col("file_seq") * F.lit(1_000_000_000_000) + F.col("record_seq")
    chained = ordered_scan(docs.withColumn("place", place), ["payload_digest"], "place",
                           previous={"before": F.col("record_id")}, span=1_000_000_000_000)
    revisits = chained.withColumn("rec_type", F.when(F.col("before").isNull(), "response").otherwise("revisit"))
    number = lambda c: F.expr(f"cast(substring({c}, 9) as bigint)")
    return records.resolve_revisits(revisits.withColumn("refers_to", F.col("before"))).select(
        number("record_id").alias("doc_id"), number("resolved_id").alias("first_doc"))


@query("repeated_ids", f"""
WITH {SQL_DOCS}
SELECT c.copy * 1000 + file_seq AS file_seq, doc_id, CAST(n_chars AS BIGINT) AS request_size, 'urn:doc:' ||
       CAST(CASE WHEN nth > 1 THEN first_doc ELSE doc_id END AS BIGINT) AS resolved_id
FROM firsts, (SELECT unnest([0, 1]) AS copy) c""")
def repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive merged with itself: every id twice, each response still with one request and each revisit with one record."""
    docs = document_records(spark, sf_dir)
    once = docs.withColumn("http_start_line", F.col("content_length").cast("string")).withColumn(
        "concurrent_to", F.concat(F.lit("rq"), "record_id"))
    requests = once.withColumn("rec_type", F.lit("request")).withColumn("record_id", F.col("concurrent_to"))
    place = F.col("file_seq") * F.lit(1_000_000_000_000) + F.col("record_seq")
    chained = ordered_scan(docs.withColumn("place", place), ["payload_digest"], "place",
                           previous={"before": F.col("record_id")}, span=1_000_000_000_000)
    revisits = chained.filter("before IS NOT NULL").withColumn("rec_type", F.lit("revisit")).withColumn("refers_to", F.col("before"))

    def twice(df: DataFrame) -> DataFrame:
        return df.unionByName(df.withColumn("file_seq", F.col("file_seq") + 1000))

    paired = records.pair_responses(twice(once.unionByName(requests)))
    resolved = records.resolve_revisits(twice(revisits.select(*docs.columns))).distinct()
    return paired.join(resolved, "record_id", "left").select(
        F.col("file_seq").cast("bigint").alias("file_seq"), F.col("record_seq").alias("doc_id"),
        F.col("request_line").cast("bigint").alias("request_size"), F.coalesce("resolved_id", "record_id").alias("resolved_id"))
