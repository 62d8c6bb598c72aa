"""Links to earlier records on a stream against the batch operators."""

import random

from pyspark.sql import functions as F

from arcloom.operators import records
from arcloom.plans.streams import rocksdb
from arcloom.session import scratch_path
from arcloom.streaming import feed, links, sinks

SCHEMA = "file_seq BIGINT, record_seq BIGINT, record_id STRING, rec_type STRING, target_uri STRING, doc BOOLEAN"


def run(spark, rows, borders, make, schema, read):
    base = scratch_path(spark, "t-links")
    spark.createDataFrame([], schema).write.parquet(f"{base}/in")
    source = spark.readStream.schema(schema).parquet(f"{base}/in")
    for lo, hi in zip([0, *borders], [*borders, len(rows)]):
        spark.createDataFrame(rows[lo:hi], schema).repartition(3).write.mode("append").parquet(f"{base}/in")
        with rocksdb(spark):
            sinks.run_available(make(source), lambda df, i: sinks.write_batch(df, f"{base}/out", i), f"{base}/checkpoint")
    return sinks.read_batches(spark, f"{base}/out", read + ", batch_id INT")


def test_links_do_not_depend_on_micro_batches(spark):
    rnd = random.Random(6)
    rows = []
    for n in range(200):
        kind = rnd.choice(["warcinfo", "response", "response", "conversion"])
        rows.append((rnd.randrange(2), n, f"r{n}", kind, rnd.choice(["u", "v", None]), kind == "response" and rnd.random() < 0.4))
    whole = spark.createDataFrame(rows, SCHEMA)
    wants = F.col("rec_type") == "conversion"
    found = run(spark, rows, [50, 51, 140], lambda s: links.asof_document_stream(s, F.col("doc"), wants), SCHEMA,
                "file_seq BIGINT, target_uri STRING, record_seq BIGINT, record_id STRING, refers_to STRING")
    want = records.asof_document(whole, F.col("doc"), wants)
    key = ["file_seq", "record_seq", "record_id", "refers_to"]
    assert sorted(map(str, found.select(*key).collect())) == sorted(map(str, want.select(*key).collect()))
    found = run(spark, rows, [90], links.asof_warcinfo_stream, SCHEMA,
                "file_seq BIGINT, record_seq BIGINT, record_id STRING, warcinfo_id STRING")
    key = ["file_seq", "record_seq", "warcinfo_id"]
    assert sorted(map(str, found.select(*key).collect())) == sorted(map(str, records.asof_warcinfo(whole).select(*key).collect()))


def test_urls_seen_are_state_and_no_output_is_read_again(spark):
    rows = [(None, "known"), ("a", "x"), ("a", "y"), ("b", "x"), ("b", "z"), ("c", "known"), ("c", "y"), ("d", "x")]
    schema = "src_url STRING, dst_url STRING"
    plans = []

    def make(source):
        found = feed.first_sightings(source)
        plans.append(found._jdf.queryExecution().analyzed().toString())
        return found

    found = run(spark, rows, [1, 3, 6], make, schema, feed.VISITED_SCHEMA).collect()
    assert {(r.url, r.parent_url) for r in found} == {("x", "a"), ("y", "a"), ("z", "b")} and len(found) == 3
    assert all("Deduplicate" in p and "Join" not in p and "/out" not in p for p in plans)
