"""Archive files, errata, screenshots and snapshots over documents, events and pages."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcloom import fixed_values as V
from arcloom.functions import headers as H
from arcloom.functions import text as X
from arcloom.functions import urls
from arcloom.operators import crawl_log, dedup, errata, log_batches, records, screenshots, sinks, snapshot
from arcloom.plans.base import fill_records, query, table
from arcloom.schema import ORDER, RECORD_COLUMNS
from arcloom.session import cut_lineage, scratch_path
from arcloom.sources.files import open_output
from arcloom.operators.skew import numbered
from arcloom.sources.warc import member_index, read_warc, register, write_warc

PACKAGE, FIX_TOOL = "grabber", "grabber-errata"
VERSIONS = ("0.9", "1.0", "1.0.0", "1.1", "1.0.1", "0.10.2")


def info_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as ``warcinfo`` records of fifty archives: foreign text, fix marks, versions."""
    d = table(spark, sf_dir, "documents")
    doc = F.col("doc_id")
    version = F.element_at(F.array(*[F.lit(v) for v in VERSIONS]), (doc % 6 + 1).cast("int"))
    own = F.array(F.struct(F.lit("helper").alias("projectName"), F.lit("9").alias("version")),
                  F.struct(F.lit(PACKAGE).alias("projectName"), version.alias("version")))
    body = (
        F.when(doc % 7 == 0, F.col("text"))
        .when(doc % 11 == 0, F.to_json(F.struct(
            F.lit(FIX_TOOL).alias("tool"),
            F.struct(F.array(F.lit(V.ERRATA_CONTENT_TYPE)).alias("errata")).alias("parameters"))))
        .when(doc % 13 == 0, F.lit('{"tool": "other"}'))
        .otherwise(F.to_json(F.struct(F.lit("grabber-single").alias("tool"), F.struct(own.alias("self")).alias("software"))))
    )
    return fill_records(d.select(
        F.concat(F.lit("file"), doc % 50).alias("file_path"), (doc % 50).cast("int").alias("file_seq"),
        doc.alias("record_seq"), F.lit("warcinfo").alias("rec_type"), F.encode(body, "UTF-8").alias("payload")))


SQL_ERRATA = f"""w AS (
  SELECT doc_id, doc_id % 50 AS file_seq, doc_id % 7 <> 0 AND doc_id % 11 = 0 AS fixes,
         CASE WHEN doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0 THEN doc_id % 6 END AS v FROM documents),
f AS (SELECT file_seq, min(doc_id) AS at FROM w WHERE fixes GROUP BY file_seq),
hits AS (
  SELECT file_seq, doc_id AS record_seq, '{V.ERRATA_PRE_RELEASE}' AS uuid, false AS fixable FROM w WHERE v IN (0, 5)
  UNION ALL
  SELECT w.file_seq, doc_id, '{V.ERRATA_CONTENT_TYPE}', true FROM w LEFT JOIN f USING (file_seq)
  WHERE v IN (1, 2) AND (f.at IS NULL OR f.at > doc_id))"""


@query("errata_check", f"WITH {SQL_ERRATA} SELECT * FROM hits")
def errata_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = errata.check(info_records(spark, sf_dir), errata.builtin_errata(PACKAGE), FIX_TOOL)
    return found.select("file_seq", "record_seq", "uuid", "fixable")


@query("errata_any", f"""
WITH {SQL_ERRATA}, n AS (SELECT file_seq, count(*) AS n FROM hits GROUP BY file_seq)
SELECT DISTINCT w.file_seq, coalesce(n, 0) AS n_errata, n IS NOT NULL AS has_errata FROM w LEFT JOIN n USING (file_seq)""")
def errata_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errata.has_errata(info_records(spark, sf_dir), errata.builtin_errata(PACKAGE), FIX_TOOL).drop("file_path")


def typed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, doc = table(spark, sf_dir, "documents"), F.col("doc_id")
    kind = F.when(doc % 3 == 0, "application/json; encoding=utf-8").otherwise("text/html; charset=utf-8")
    return records.render_headers(fill_records(d.select(
        F.col("source").alias("file_path"), F.lit(0).alias("file_seq"), doc.alias("record_seq"),
        F.lit("metadata").alias("rec_type"), kind.alias("content_type"), F.encode("text", "UTF-8").alias("payload"))))


@query("errata_fix", """
SELECT doc_id AS record_seq, ct AS content_type, ct AS header, strlen(text) AS content_length FROM (
  SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'application/json; charset=utf-8' ELSE 'text/html; charset=utf-8' END AS ct FROM documents)""")
def errata_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    erratum = errata.erratum_by_id(errata.builtin_errata(PACKAGE), V.ERRATA_CONTENT_TYPE)
    return errata.fixed_records(typed_documents(spark, sf_dir), erratum).select(
        "record_seq", "content_type", H.value_of(F.col("headers"), "content-type").alias("header"), "content_length")


@query("errata_fix_totals", "SELECT count(*) FILTER (doc_id % 3 = 0) AS fixed, count(*) AS processed FROM documents")
def errata_fix_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    erratum = errata.erratum_by_id(errata.builtin_errata(PACKAGE), V.ERRATA_CONTENT_TYPE)
    return errata.fix_totals(typed_documents(spark, sf_dir), erratum)


# --- screenshots --------------------------------------------------------------------


def image_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, doc = table(spark, sf_dir, "documents"), F.col("doc_id")
    items = d.select(
        F.col("source").alias("file_path"), F.substring("source", 4, 9).cast("int").alias("file_seq"),
        doc.alias("record_seq"), F.timestamp_seconds(F.lit(1704067200)).alias("warc_date"),
        F.concat(F.lit("http://p.example/"), doc).alias("url"),
        F.when(doc % 3 != 0, doc * 16384).alias("yoff"), F.encode("text", "UTF-8").alias("data"))
    pictures = records.screenshot_records(items)
    html = F.when(F.col("record_seq") % 2 == 1, "text/html").otherwise(F.col("content_type"))
    return pictures.withColumn("content_type", html)


SQL_IMAGES = """i AS (
  SELECT CAST(substr(source, 4) AS BIGINT) AS file_seq, doc_id AS record_seq, 'http://p.example/' || doc_id AS url, doc_id * 16384 AS yoff,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n
  FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 2 = 0)"""


@query("screenshot_manifest", f"""
WITH {SQL_IMAGES} SELECT file_seq, record_seq, printf('shot-%05d.png', n) AS file, url, yoff FROM i""")
def screenshot_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screenshots.manifest(image_records(spark, sf_dir), "shot-").select(
        F.col("file_seq").cast("bigint").alias("file_seq"), "record_seq", "file", "url",
        F.col("yoff").cast("bigint").alias("yoff"))


@query("screenshot_first", f"""
WITH {SQL_IMAGES} SELECT file_seq, record_seq, 'shot' AS file, url, yoff FROM i WHERE n = 0""")
def screenshot_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screenshots.manifest(image_records(spark, sf_dir), "shot", one=True).select(
        F.col("file_seq").cast("bigint").alias("file_seq"), "record_seq", "file", "url",
        F.col("yoff").cast("bigint").alias("yoff"))


# --- archive files --------------------------------------------------------------------


def full_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with HTTP headers, one capture start per source, and scripts, as one record stream."""
    d, doc = table(spark, sf_dir, "documents"), F.col("doc_id")
    place = (F.col("source").alias("file_path"), F.substring("source", 4, 9).cast("int").alias("file_seq"))
    when = F.timestamp_seconds(F.lit(1704067200) + doc)
    payload = F.encode("text", "UTF-8")
    pages = records.as_records(
        d.select(*place, "doc_id", "lang", "text"),
        file_path=F.col("file_path"), file_seq=F.col("file_seq"), record_seq=doc * 2,
        record_id=X.urn_uuid(F.lit("doc"), doc.cast("string")), rec_type=F.lit("response"),
        target_uri=F.concat(F.lit("http://d.example/"), doc), warc_date=when,
        content_type=F.lit("application/http; msgtype=response"), payload_digest=X.base32_sha1(payload),
        request_id=F.concat(F.lit("rq"), doc), http_start_line=F.lit("HTTP/1.1 200 OK"),
        http_headers=F.array(H.header("Content-Language", F.col("lang")), H.header("X-Doc", doc.cast("string"))),
        payload=payload)
    starts = d.groupBy("source").agg(F.count(F.lit(1)).alias("n")).select(
        *place, F.lit(-1).alias("record_seq"), F.timestamp_seconds(F.lit(1704067200)).alias("warc_date"),
        F.to_json(F.struct(F.lit("grabber-single").alias("tool"), F.col("n").alias("pages"))).alias("payload"))
    scripts = d.filter("doc_id % 10 = 0").select(
        *place, (doc * 2 + 1).alias("record_seq"), when.alias("warc_date"),
        F.concat(F.lit("/s/"), doc, F.lit(".js")).alias("path"), F.concat(F.lit("// "), F.col("lang")).alias("data"))
    return records.build_records({"warcinfo": starts, "script": scripts}).unionByName(pages)


@query("warc_roundtrip", """
SELECT doc_id, md5(text) AS text_md5, strlen(text) AS n_bytes, lang, 'http://d.example/' || doc_id AS target_uri,
       strftime(TIMESTAMP '2024-01-01' + to_seconds(doc_id), '%Y-%m-%dT%H:%M:%SZ') AS warc_date, 'rq' || doc_id AS request_id
FROM documents""")
def warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records written as archives and read back in slices; the documents among them."""
    path = scratch_path(spark, "archives")
    write_warc(full_records(spark, sf_dir), path)
    back = read_warc(spark, path, rec_types=["response"], slice_bytes=1 << 22)
    return back.select(
        H.value_of(F.col("http_headers"), "x-doc").cast("bigint").alias("doc_id"), F.md5("payload").alias("text_md5"),
        F.octet_length("payload").cast("bigint").alias("n_bytes"),
        H.value_of(F.col("http_headers"), "content-language").alias("lang"), "target_uri",
        X.iso_date(F.col("warc_date")).alias("warc_date"), "request_id")


def _foreign_member(doc_id: int, text: str) -> bytes:
    """A record as other writers have it: a long gzip header, and every third a head that fills the record to its end."""
    head = f"HTTP/1.1 200 OK\r\nX-Doc: {doc_id}\r\nX-Size: {len(text)}"
    block = head.encode() if doc_id % 3 == 0 else f"{head}\r\n\r\n{text}".encode()
    record = (f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:doc:{doc_id}>\r\n"
              f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = deflate.compress(record) + deflate.flush()
    extra = bytes(600 + doc_id % 4000)
    return (b"\x1f\x8b\x08\x04\0\0\0\0\0\x03" + struct.pack("<H", len(extra)) + extra + packed
            + struct.pack("<II", zlib.crc32(record), len(record)))


@query("warc_foreign", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN md5('') ELSE md5(text) END AS text_md5, CAST(length(text) AS BIGINT) AS n_chars
FROM documents""")
def warc_foreign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in archives of another writer, read back in slices smaller than many a record."""
    folder = scratch_path(spark, "foreign")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        name = f"{folder}/{context.partitionId():05d}-{context.taskAttemptId()}.warc.gz"
        out = None
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                out = out or open_output(name)
                out.write(_foreign_member(doc_id, text))
        if out is not None:
            out.close()
            yield pd.DataFrame({"name": [name]})

    written = cut_lineage(table(spark, sf_dir, "documents").select("doc_id", "text").mapInPandas(write, "name STRING"), "foreign-names")
    names = sorted(r.name for r in written.collect())  # one per task
    back = read_warc(spark, names, slice_bytes=1 << 17)
    return back.select(
        H.value_of(F.col("http_headers"), "x-doc").cast("bigint").alias("doc_id"), F.md5("payload").alias("text_md5"),
        H.value_of(F.col("http_headers"), "x-size").cast("bigint").alias("n_chars"))


@query("merge_roundtrip", """
WITH d AS (
  SELECT *, CAST(substr(source, 4) AS BIGINT) AS file_seq, 'http://d.example/' || doc_id AS uri FROM documents),
p AS (
  SELECT file_seq, doc_id * 2 AS record_seq, 'response' AS rec_type, uri, text AS payload,
         row_number() OVER w AS nth, first_value(uri) OVER w AS first_uri
  FROM d WINDOW w AS (PARTITION BY text ORDER BY file_seq, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  UNION ALL
  SELECT file_seq, doc_id * 2 + 1, 'resource', 'file:///s/' || doc_id || '.js', '// ' || lang, row_number() OVER w,
         first_value('file:///s/' || doc_id || '.js') OVER w
  FROM d WHERE doc_id % 10 = 0 WINDOW w AS (PARTITION BY lang ORDER BY file_seq, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  UNION ALL
  SELECT file_seq, -1, 'warcinfo', NULL, '{"tool":"grabber-single","pages":' || count(*) || '}', 1, NULL FROM d GROUP BY file_seq
  UNION ALL
  SELECT -1, 0, 'warcinfo', NULL, '{"software": {}, "tool": "merge", "parameters": {"inputs": 2}}', 1, NULL)
SELECT CAST(row_number() OVER (ORDER BY file_seq, record_seq) - 1 AS BIGINT) AS position, CASE WHEN nth > 1 THEN 'revisit' ELSE rec_type END AS rec_type,
       coalesce(uri, '') AS target_uri, md5(CASE WHEN nth > 1 THEN '' ELSE payload END) AS payload_md5,
       CASE WHEN nth > 1 THEN first_uri ELSE '' END AS refers_to_uri
FROM p""")
def merge_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two archives written, merged by member index, and read back: every record at its place."""
    one, two, merged = (scratch_path(spark, f"merge-{n}") for n in ("one", "two", "out"))
    docs = full_records(spark, sf_dir)
    middle = 10  # sources below go to the first archive, the others to the second
    write_warc(docs.filter(F.col("file_seq") < middle), one)
    write_warc(docs.filter(F.col("file_seq") >= middle), two)
    lead = dedup.provenance_record(spark, "merge", '{"inputs": 2}', when="2024-01-01 00:00:00")
    dedup.merge_into(member_index(spark, [one, two], slice_bytes=1 << 20), merged, lead)
    back = cut_lineage(read_warc(spark, merged, slice_bytes=1 << 20).select(
        *ORDER, "rec_type", "target_uri", F.md5(F.coalesce("payload", F.lit(b""))).alias("payload_md5"), "refers_to_uri"), "merge-back")
    inside = numbered(back, ["file_seq"], "record_seq", "nth", start=0)
    # one row per file
    sizes = back.groupBy("file_seq").agg(F.count(F.lit(1)).alias("n"))
    bases = sizes.alias("a").join(sizes.alias("b"), F.col("b.file_seq") < F.col("a.file_seq"), "left").groupBy(
        F.col("a.file_seq").alias("file_seq")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("base"))
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return inside.join(bases, "file_seq").select(
        (F.col("base") + F.col("nth")).alias("position"), "rec_type", text("target_uri"), "payload_md5", text("refers_to_uri"))


@query("archive_per_page", """
SELECT split_part(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), ':', 1) || '-' || page_id AS archive, page_id, md5(html) AS html_md5,
       1 AS records, 2 AS copies FROM pages""")
def archive_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page in an archive named by host and number, appended to once, and each archive read by itself."""
    path = scratch_path(spark, "pages")
    doc, html = F.col("page_id"), F.encode("html", "UTF-8")
    pages = table(spark, sf_dir, "pages")
    found = records.as_records(
        pages, keep=["page_id", "url"], file_path=F.lit("pages"), file_seq=F.lit(0), record_seq=doc, record_id=X.urn_uuid(F.lit("page"), doc.cast("string")),
        rec_type=F.lit("resource"), target_uri=F.col("url"), warc_date=F.timestamp_seconds(F.lit(1704067200)), content_type=F.lit("text/html"),
        payload_digest=X.base32_sha1(html), payload=html)
    named = found.withColumn("archive", sinks.output_name("{host}-{seqnum}", F.split_part(urls.host(F.col("url")), F.lit(":"), F.lit(1)), F.lit(""), doc)).drop("page_id", "url")
    write_warc(named, path)
    write_warc(named, path, mode="append")
    back = read_warc(spark, path)
    archive = F.regexp_extract("file_path", r"/_job-[0-9a-f]+/([^/]+)/", 1)
    each = back.select(archive.alias("archive"), "file_path", F.regexp_extract("archive", r"-([0-9]+)$", 1).cast("bigint").alias("page_id"),
                       F.md5("payload").alias("html_md5"))
    files_of = each.groupBy("archive", "page_id", "html_md5", "file_path").agg(F.count(F.lit(1)).alias("records"))
    return files_of.groupBy("archive", "page_id", "html_md5").agg(F.max("records").alias("records"), F.count(F.lit(1)).alias("copies"))


@query("asof_warcinfo_archive", """
SELECT doc_id, count(*) OVER (PARTITION BY source) AS pages FROM documents""")
def asof_warcinfo_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document of real archives with what the ``warcinfo`` before it says about its capture."""
    path = scratch_path(spark, "archives")
    register(spark)
    # one source is never cut over two files, so the record that starts its capture is in the same one
    full_records(spark, sf_dir).select(*RECORD_COLUMNS).repartitionByRange("file_seq").sortWithinPartitions(*ORDER).write.format(
        "warc").mode("append").save(path)
    back = read_warc(spark, path, payload=False, slice_bytes=1 << 20)
    linked = records.asof_warcinfo(back).filter("rec_type = 'response'")
    infos = read_warc(spark, path, rec_types=["warcinfo"]).select(
        F.col("record_id").alias("warcinfo_id"), F.get_json_object(F.decode("payload", "UTF-8"), "$.pages").cast("bigint").alias("pages"))
    docs = back.select(*ORDER, H.value_of(F.col("http_headers"), "x-doc").cast("bigint").alias("doc_id"))
    return linked.join(infos, "warcinfo_id").join(docs, list(ORDER)).select("doc_id", "pages")


@query("warc_inventory", """
SELECT 'response' AS rec_type, '' AS sub_type, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS payload_bytes FROM documents
UNION ALL SELECT 'resource', 'script', count(*), CAST(sum(strlen(lang) + 3) AS BIGINT) FROM documents WHERE doc_id % 10 = 0
UNION ALL SELECT 'warcinfo', '', count(*) + 1, CAST(sum(strlen('{"tool":"grabber-single","pages":' || n || '}')) + strlen('{"software": {}, "tool": "merge", "parameters": {"inputs": []}}') AS BIGINT)
FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)""")
def warc_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provenance record first, then all records, written, read and counted by type."""
    path = scratch_path(spark, "archives")
    lead = dedup.provenance_record(spark, "merge", '{"inputs": []}', when="2024-01-01 00:00:00")
    write_warc(lead.unionByName(full_records(spark, sf_dir)), path)
    return read_warc(spark, path).groupBy("rec_type", F.coalesce("sub_type", F.lit("")).alias("sub_type")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("payload")).alias("payload_bytes"))


def page_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One short log line per event, in ten files."""
    e = table(spark, sf_dir, "events")
    line = F.to_json(F.struct(F.col("event_id").alias("seq"), F.col("event_type").alias("msg")))
    return e.select((F.col("user_id") % 10).cast("int").alias("file_seq"), F.col("event_id").alias("seq"), line.alias("line"),
                    F.concat(F.lit("f"), F.col("user_id") % 10).alias("file_path"))


SQL_LINES = """l AS (SELECT user_id % 10 AS file_seq, event_id AS seq, event_type,
  strlen('{"seq":' || event_id || ',"msg":"' || event_type || '"}') + 1 AS size,
  row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS n FROM events)"""


SQL_LOG_BATCHES = f"""
WITH RECURSIVE {SQL_LINES},
cut(file_seq, n, seq, batch, held) AS (
  SELECT file_seq, n, seq, 0, size FROM l WHERE n = 1
  UNION ALL
  SELECT l.file_seq, l.n, l.seq, CASE WHEN held > 3000 THEN batch + 1 ELSE batch END, CASE WHEN held > 3000 THEN 0 ELSE held END + l.size
  FROM cut JOIN l ON l.file_seq = cut.file_seq AND l.n = cut.n + 1)
SELECT file_seq, batch, max(seq) AS last_seq, count(*) AS n_lines, CAST(max(held) AS BIGINT) AS n_bytes FROM cut GROUP BY file_seq, batch"""


def shown_batches(b: DataFrame) -> DataFrame:
    return b.select(F.col("file_seq").cast("int").alias("file_seq"), F.col("batch").cast("bigint").alias("batch"), F.col("record_seq").alias("last_seq"),
                    (F.size(F.split("body", "\n")) - 1).alias("n_lines"), F.octet_length("body").alias("n_bytes"))


@query("log_batches", SQL_LOG_BATCHES)
def log_batches_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown_batches(log_batches.log_batches(page_log(spark, sf_dir), limit=3000))


@query("log_batches_native", f"""
WITH {SQL_LINES}, r AS (SELECT *, sum(size) OVER (PARTITION BY file_seq ORDER BY seq) - size AS before FROM l)
SELECT file_seq, CAST(before // 3000 AS BIGINT) AS batch, count(*) AS n_lines FROM r GROUP BY ALL""")
def log_batches_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = log_batches.log_batches(page_log(spark, sf_dir), limit=3000, exact=False)
    return b.select("file_seq", "batch", (F.size(F.split("body", "\n")) - 1).alias("n_lines"))


@query("archived_log", "SELECT event_id AS seq, event_type AS msg FROM events")
def archived_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines batched into records, archived, and read out of the archives again."""
    path = scratch_path(spark, "log-archives")
    batches = log_batches.log_batches(page_log(spark, sf_dir), limit=20_000)
    write_warc(records.log_records(batches.withColumn("warc_date", F.timestamp_seconds(F.lit(1704067200)))), path)
    lines = crawl_log.log_lines_of_records(read_warc(spark, path, rec_types=["metadata"]))
    return crawl_log.parse(lines).select(crawl_log.field("seq", "bigint").alias("seq"), "msg")


# --- snapshots ------------------------------------------------------------------------


@query("static_snapshot_native", r"""
SELECT page_id, md5(regexp_replace(html, '(?is)<(script|noscript)\b[^>]*>.*?</(script|noscript)\s*>', '', 'g')) AS html_md5 FROM pages""")
def static_snapshot_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(snapshot.static_html_native(F.col("html"))).alias("html_md5"))


@query("static_snapshot", r"""
SELECT page_id, split_part(url, '#', 1) AS url,
  md5(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|noscript)\b[^>]*>.*?</(script|noscript)\s*>', '', 'g'),
    '&(amp;?)?', '&amp;', 'g'), '&amp;copy;', '©'), '&amp;middot;', '·'), '&amp;quot;', '"'), '<[^>]*>', '', 'g')) AS text_md5,
  len(regexp_extract_all(html, '(?i)<a\s')) AS n_links
FROM pages""")
def static_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages through the tag walker; the oracle sees the text between the tags and the links."""
    made = snapshot.static_snapshots(snapshot.html_documents(table(spark, sf_dir, "pages")))
    html = F.decode("document", "UTF-8")
    return made.select("page_id", "url", F.md5(F.regexp_replace(html, "<[^>]*>", "")).alias("text_md5"),
                       F.size(F.regexp_extract_all(html, F.lit(r"(?i)(<a)\s"))).alias("n_links"))


def dom_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as DOM trees: a script, a paragraph with the title, and three frames (one a repeat, one blank)."""
    p = table(spark, sf_dir, "pages")
    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    text = lambda v: F.struct(F.lit("#text").alias("nodeName"), v.alias("nodeValue"))
    document = lambda url, *children: F.struct(
        F.lit("#document").alias("nodeName"), url.alias("documentURL"), url.alias("baseURL"), F.array(*children).alias("children"))
    inner = lambda url: document(url, F.struct(
        F.lit("BODY").alias("nodeName"), F.array(F.lit("onload"), F.lit("x()"), F.lit("id"), F.lit("a b")).alias("attributes"),
        F.array(F.struct(F.lit("NOSCRIPT").alias("nodeName"), F.array(F.struct(F.lit("IMG").alias("nodeName"))).alias("children"))).alias("children")))

    def node(name: str, attributes=None, children=None, frame=None):
        # the children of all nodes share one type, as array elements must
        return F.struct(
            F.lit(name).alias("nodeName"),
            (F.lit(None).cast("array<string>") if attributes is None else F.array(*[F.lit(a) for a in attributes])).alias("attributes"),
            (F.lit(None).cast("array<struct<nodeName:string,nodeValue:string>>") if children is None else F.array(*children)).alias("children"),
            (F.lit(None).cast(F_INNER) if frame is None else inner(frame)).alias("contentDocument"))

    own = F.concat(F.lit("http://frame.example/"), F.col("page_id"), F.lit("#f"))
    root = document(F.col("url"), F.struct(
        F.lit("HTML").alias("nodeName"), F.array(F.lit("lang"), F.lit("en"), F.lit("onclick"), F.lit("go()")).alias("attributes"),
        F.array(node("SCRIPT", children=[text(F.lit("1 < 2"))]), node("P", children=[text(title)]),
                node("IFRAME", ["src", "/f?a=1"], frame=own), node("IFRAME", frame=F.col("url")),
                node("IFRAME", frame=F.lit("about:blank")), node("BR", ["class", ""])).alias("children")))
    return p.select("page_id", F.to_json(root).alias("dom"))


F_INNER = ("struct<nodeName:string,documentURL:string,baseURL:string,children:array<struct<nodeName:string,"
           "attributes:array<string>,children:array<struct<nodeName:string,children:array<struct<nodeName:string>>>>>>>")


@query("dom_snapshot", r"""
WITH t AS (SELECT page_id, url, replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&', '&amp;'), '>', '&gt;') AS title FROM pages)
SELECT page_id, 0 AS doc_seq, split_part(url, '#', 1) AS url, 1 AS duplicates,
  '<HTML lang=en><P>' || title || '</P><IFRAME src="/f?a=1"></IFRAME><IFRAME></IFRAME><IFRAME></IFRAME><BR class=""></HTML>' AS html FROM t
UNION ALL SELECT page_id, 1, 'http://frame.example/' || page_id, 1, '<BODY id="a b"></BODY>' FROM t""")
def dom_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split into documents, keep web ones, first per URL, stripped and written as HTML."""
    made = snapshot.static_snapshots(snapshot.dom_documents(dom_pages(spark, sf_dir)))
    return made.select("page_id", "doc_seq", "url", "duplicates", F.decode("document", "UTF-8").alias("html"))


@query("dom_nodes", r"""
WITH c AS (
  SELECT page_id, unnest(['a', 'li', 'p', 'h1', 'br', 'script', 'nav']) AS name, unnest([
    len(regexp_extract_all(html, '<a[\s>]')), len(regexp_extract_all(html, '<li[\s>]')), len(regexp_extract_all(html, '<p[\s>]')),
    len(regexp_extract_all(html, '<h1[\s>]')), len(regexp_extract_all(html, '<br[\s>]')), len(regexp_extract_all(html, '<script[\s>]')),
    len(regexp_extract_all(html, '<nav[\s>]'))]) AS n FROM pages)
SELECT * FROM c WHERE n > 0""")
def dom_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements per page and tag, from the node table."""
    found = snapshot.nodes(snapshot.html_documents(table(spark, sf_dir, "pages")))
    return (
        found.filter(F.col("name").isin("a", "li", "p", "h1", "br", "script", "nav"))
        .groupBy("page_id", "name").agg(F.count(F.lit(1)).alias("n")))
