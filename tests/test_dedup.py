import pytest
from pyspark.sql import functions as F

from arcloom.functions import text as X
from arcloom.operators import dedup, records, skew
from arcloom.operators.skew import hot_keys
from arcloom.plans.base import fill_records

SCHEMA = "file_seq INT, record_seq BIGINT, rec_type STRING, target_uri STRING, body STRING, no_digest BOOLEAN"


def archive(spark, rows):
    df = spark.createDataFrame([(*r, False) if len(r) == 5 else r for r in rows], SCHEMA)
    payload = F.encode("body", "UTF-8")
    return records.render_headers(fill_records(df.select(
        "file_seq", "record_seq", "rec_type", "target_uri",
        F.concat_ws("-", F.lit("id"), "file_seq", "record_seq").alias("record_id"),
        F.timestamp_seconds(F.lit(1500000000) + F.col("record_seq")).alias("warc_date"),
        F.when(~F.col("no_digest"), X.base32_sha1(payload)).alias("payload_digest"),
        F.lit("HTTP/1.1 200 OK").alias("http_start_line"),
        F.array(F.struct(F.lit("N").alias("name"), F.col("record_seq").cast("string").alias("value"))).alias("http_headers"),
        F.lit("rq").alias("request_id"), F.lit("other").alias("concurrent_to"),
        payload.alias("payload"))))


def merged(spark, rows, **options):
    lead = dedup.provenance_record(spark, "merge", "{}", when="2024-01-01 00:00:00")
    out = dedup.merge_archives(archive(spark, rows), lead, **options).orderBy("file_seq", "record_seq").collect()
    assert out[0].rec_type == "warcinfo" and (out[0].file_seq, out[0].record_seq) == (-1, 0)
    return out[1:]


PAIR = [(0, 0, "request", "/", "foobar"), (0, 1, "response", "/", "data")]


def test_unmodified(spark):
    rows = archive(spark, PAIR).orderBy("record_seq").collect()
    assert merged(spark, PAIR) == rows


def test_different_payloads_stay(spark):
    rows = PAIR + [(0, 2, "request", "/", "foobar"), (0, 3, "response", "/", "data1")]
    assert [r.rec_type for r in merged(spark, rows)] == ["request", "response"] * 2


@pytest.mark.parametrize("uri", ["/", "/one"])
def test_second_copy_becomes_a_revisit(spark, uri):
    out = merged(spark, PAIR + [(1, 2, "request", uri, "foobar"), (1, 3, "response", uri, "data")])
    assert [r.rec_type for r in out] == ["request", "response", "request", "revisit"]
    first, again = out[1], out[3]
    assert again.target_uri == uri
    assert again.payload_digest == first.payload_digest
    assert (again.refers_to, again.refers_to_uri, again.refers_to_date) == (first.record_id, "/", first.warc_date)
    assert again.truncated == "length" and again.payload is None
    assert [(h.name, h.value) for h in again.http_headers] == [("N", "3")]
    assert again.http_start_line == "HTTP/1.1 200 OK"
    # nothing else of the duplicate is handed on
    assert again.request_id is None and again.concurrent_to is None and again.record_id != "id-1-3"
    names = [h.name for h in again.headers]
    assert "WARC-Profile" in names and "WARC-Refers-To" in names


def test_carried_columns(spark):
    out = merged(spark, PAIR + [(1, 3, "response", "/", "data")], carry=["request_id"])
    assert out[-1].rec_type == "revisit" and out[-1].request_id == "rq" and out[-1].concurrent_to is None


def test_records_without_digest_are_never_duplicates_unless_computed(spark):
    rows = [(0, i, "resource", "/", "same", True) for i in range(3)]
    assert [r.rec_type for r in merged(spark, rows)] == ["resource"] * 3
    assert [r.rec_type for r in merged(spark, rows, on_missing_digest="compute")] == ["resource", "revisit", "revisit"]
    with pytest.raises(ValueError):
        merged(spark, rows, on_missing_digest="guess")


def test_first_is_first_in_file_order_and_types_mix(spark):
    rows = [(1, 0, "resource", "/b", "x"), (0, 9, "response", "/a", "x"), (0, 3, "metadata", "/m", "x")]
    out = merged(spark, rows)
    assert [(r.file_seq, r.rec_type) for r in out] == [(0, "metadata"), (0, "response"), (1, "revisit")]


def test_report_counts(spark):
    rows = PAIR + [(0, 2, "response", "/", "data"), (0, 3, "resource", "/x", "d", True), (0, 4, "metadata", "/", "data")]
    df = archive(spark, rows)
    length = {r.record_seq: r.content_length for r in df.collect()}
    r = dedup.dedup_report(df).first()
    # every record counts, bytes only those of payload records
    assert (r.unique_records, r.revisit_records) == (4, 1)
    assert (r.unique_bytes, r.revisit_bytes) == (length[1] + length[3], length[2])
    assert r.ratio_records == pytest.approx(0.8)


def test_report_of_nothing_has_no_ratio(spark):
    r = dedup.dedup_report(archive(spark, [])).first()
    assert (r.unique_records, r.revisit_records, r.ratio_records, r.ratio_bytes) == (0, 0, None, None)


def test_hot_payload(spark, monkeypatch):
    monkeypatch.setattr(skew, "hot_keys", lambda df, keys: hot_keys(df, keys, min_rows=10, sample=1.0))
    rows = [(i % 3, i, "response", f"/{i}", "" if i % 2 else f"b{i}") for i in range(200)]
    out = dedup.merge_archives(archive(spark, rows))
    assert out.count() == 200
    assert out.filter("rec_type = 'revisit'").count() == 99
    assert out.filter("rec_type = 'revisit'").select("refers_to").distinct().count() == 1


def test_links_to_replaced_records_dangle(spark):
    rows = [(0, 1, "response", "/", "d"), (0, 2, "response", "/", "d"), (0, 3, "metadata", "/", "m")]
    df = archive(spark, rows).withColumn("concurrent_to", F.when(F.col("record_seq") == 3, F.lit("id-0-2")))
    assert records.dangling_links(df).count() == 0
    bad = records.dangling_links(dedup.merge_archives(df)).collect()
    assert [(b.link, b.target, b.n_records) for b in bad] == [("concurrent_to", "id-0-2", 1)]
