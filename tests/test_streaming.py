"""Streams of several files, so of several micro-batches, against their batch twins."""

import json

import pytest
from pyspark.sql import functions as F

from arcloom import fixed_values as V
from arcloom.operators import crawl_log, idle as batch_idle, jobs
from arcloom.plans import captures as C
from arcloom.plans import logs as L
from arcloom.session import scratch_path
from arcloom.streaming import captures, feed, idle, sinks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def event_files(spark):
    """The event table in four files, in order."""
    path = scratch_path(spark, "t-events")
    e = spark.read.parquet(f"{SF}/events.parquet")
    step = e.count() // 4 + 1
    for i in range(4):
        e.filter((F.col("event_id") >= i * step) & (F.col("event_id") < (i + 1) * step)).coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, path):
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_captures(spark, event_files):
    from arcloom.operators import capture

    base = scratch_path(spark, "t-sc")
    worker = captures.CaptureAssembler(f"{base}/out", f"{base}/state")
    sinks.run_available(C.raw_events(stream(spark, event_files)), worker, f"{base}/cp")
    out = sinks.read_batches(spark, f"{base}/out", captures.EPISODE_SCHEMA + ", batch_id INT")
    assert out.select("batch_id").distinct().count() == 4
    want = capture.assemble(C.raw_events(spark.read.parquet(event_files))).filter("outcome <> 'open'").drop("episode")
    cols = ["page_id", "request_id", "start_seq", "emit_seq", "url", "outcome", "request", "response"]
    assert out.select(cols).exceptAll(want.select(cols)).count() == 0
    assert want.select(cols).exceptAll(out.select(cols)).count() == 0
    totals = captures.running_totals(
        spark.readStream.schema(captures.EPISODE_SCHEMA + ", batch_id INT").option("maxFilesPerTrigger", 1).parquet(f"{base}/out"), "page_id")
    sinks.run_available(totals, lambda df, i: sinks.write_batch(df, f"{base}/totals", i), f"{base}/cp2", "update")
    rows = sinks.read_batches(spark, f"{base}/totals", "page_id BIGINT, requests BIGINT, finished BIGINT, failed BIGINT, bytes_rcv BIGINT, batch_id INT")
    got = sinks.newest_per_key(rows, ["page_id"])
    assert got.exceptAll(capture.page_totals(want, "page_id")).count() == 0 and got.count() == 10


def test_jobs(spark, event_files):
    base = scratch_path(spark, "t-sj")
    events = jobs.job_events(crawl_log.parse(L.log_lines(stream(spark, event_files))))
    sinks.run_available(L.shown_state(jobs.state_merge(events)), lambda df, i: sinks.write_batch(df, f"{base}/out", i), f"{base}/cp", "update")
    want = L.shown_state(jobs.state_merge(L.job_events(spark, SF)))
    ddl = ", ".join(f"{n} {t}" for n, t in want.dtypes)
    got = sinks.newest_per_key(sinks.read_batches(spark, f"{base}/out", ddl + ", batch_id INT"), ["job"])
    assert got.select(want.columns).exceptAll(want).count() == 0 and got.count() == want.count()


def test_feed_tail_and_replay(spark, event_files):
    base = scratch_path(spark, "t-sf")
    worker = feed.FeedWriter(f"{base}/out", f"{base}/tail", n=100)
    sinks.run_available(L.log_lines(stream(spark, event_files)), worker, f"{base}/cp")
    wanted = sorted(r.seq for r in crawl_log.feed(L.parsed(spark, SF)).select("seq").collect())
    out = sinks.read_batches(spark, f"{base}/out", feed.FEED_SCHEMA + ", batch_id INT")
    assert sorted(r.seq for r in out.select("seq").collect()) == wanted
    assert out.filter(F.rlike("line", F.lit('"(cmdline|command)":'))).count() == 0
    history, live = feed.replay(spark, worker, 1)
    seen = [r.seq for r in history.collect()]
    assert len(seen) == 100
    sinks.run_available(live, lambda df, i: sinks.write_batch(df, f"{base}/live", i), f"{base}/cp-live")
    later = sorted(r.seq for r in sinks.read_batches(spark, f"{base}/live", feed.FEED_SCHEMA).collect())
    assert seen == [s for s in wanted if s <= seen[-1]][-100:]
    assert later == [s for s in wanted if s > seen[-1]]


def test_link_discovery(spark):
    base = scratch_path(spark, "t-sl")
    worker = feed.LinkDiscovery(f"{base}/visited")
    batches = [[("p1", "a"), ("p0", "a"), ("p1", "b")], [("p2", "b"), ("p2", "c")], [], [("p3", "a"), ("p3", "d")]]
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "src_url STRING, dst_url STRING")
        worker(df, i)
        worker(df, i)
    got = sinks.read_batches(spark, f"{base}/visited", feed.VISITED_SCHEMA + ", batch_id INT").collect()
    assert {(r.url, r.parent_url, r.batch_id) for r in got} == {("a", "p0", 0), ("b", "p1", 0), ("c", "p2", 1), ("d", "p3", 3)}


def test_links_with_bounded_state(spark):
    path = scratch_path(spark, "t-within")
    spark.createDataFrame([("p", "a", 1), ("p", "a", 2), ("p", "b", 3)], "src_url STRING, dst_url STRING, t INT").select(
        "src_url", "dst_url", F.timestamp_seconds("t").alias("ts")).write.parquet(path)
    s = spark.readStream.schema("src_url STRING, dst_url STRING, ts TIMESTAMP").parquet(path)
    sinks.run_available(feed.new_links_within(s, "ts", "1 hour"), lambda df, i: sinks.write_batch(df, path + "-out", i), path + "-cp")
    assert sorted(r.dst_url for r in sinks.read_batches(spark, path + "-out", "dst_url STRING").collect()) == ["a", "b"]


def test_idle_detection(spark, event_files):
    e = stream(spark, event_files)
    frames = C.frames(e.select("*")).withColumn("us", F.unix_micros("ts"))
    base = scratch_path(spark, "t-si")
    for k, v in idle.ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        sinks.run_available(idle.stop_stream(frames, 6 * 3600, 5 * 86400), lambda df, i: sinks.write_batch(df, f"{base}/out", i), f"{base}/cp")
    finally:
        for k in idle.ROCKSDB:
            spark.conf.unset(k)
    got = {(r.page_id, r.reason, r.after_us) for r in sinks.read_batches(spark, f"{base}/out", idle.STOP_SCHEMA).collect()}
    want = batch_idle.stop_times(C.frames(spark.read.parquet(event_files)), 6 * 3600, 5 * 86400)
    assert got == {(r.page_id, r.reason, r.after_us) for r in want.collect()}


def test_streamed_redaction_keeps_other_lines_as_they_are(spark):
    base = scratch_path(spark, "t-plain")
    worker = feed.FeedWriter(f"{base}/out", f"{base}/tail", n=1)
    line = json.dumps({"uuid": V.MSG_EXIT, "b": 1,  "a": "  x"})
    worker(spark.createDataFrame([(0, line), (1, "{bad")], "seq BIGINT, line STRING"), 0)
    assert [r.line for r in sinks.read_batches(spark, f"{base}/out", feed.FEED_SCHEMA).collect()] == [line]
