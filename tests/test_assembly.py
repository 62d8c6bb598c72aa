"""Stateful assembly of captures against a plain fold, whatever the order and the batches events come in."""

import json
import random
from functools import partial

from pyspark.sql import functions as F

from arcloom.fixed_values import EV_FAILED, EV_FINISHED, EV_REQUEST, EV_RESPONSE
from arcloom.operators import capture
from arcloom.plans.streams import rocksdb
from arcloom.session import scratch_path
from arcloom.sources.events import RAW_SCHEMA
from arcloom.streaming import assembly, sinks

BASE_US = 1_700_000_000_000_000


def event(page, request, seq, kind, us):
    web = {"url": f"http://h/{request}", "status": 200, "headers": {"A": "b"}, "statusText": "OK"}
    body = {"requestId": request, "timestamp": us / 1e6, "wallTime": us / 1e6}
    method = {"start": EV_REQUEST, "again": EV_REQUEST, "off": EV_REQUEST, "response": EV_RESPONSE, "end": EV_FINISHED, "fail": EV_FAILED}[kind]
    if method == EV_REQUEST:
        body["request"] = {"url": "data:x" if kind == "off" else web["url"], "method": "GET", "headers": {"N": str(seq)}}
        if kind == "again":
            body["redirectResponse"] = web
    elif kind == "response":
        body["response"] = dict(web, **({"requestHeaders": {"Sent": str(seq)}} if seq % 2 else {}))
    elif kind == "end":
        body["encodedDataLength"] = seq
    return (page, seq, method, us, json.dumps(body))


def random_events(rnd, n, requests=4):
    return [event(rnd.randrange(2), f"r{rnd.randrange(requests)}", i, rnd.choice(["start", "again", "off", "response", "response", "end", "fail"]),
                  BASE_US + i * 1_000_000) for i in range(n)]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "page_id BIGINT, seq BIGINT, method STRING, us BIGINT, params STRING")
    return df.select("page_id", "seq", "method", F.timestamp_micros("us").alias("ts"), "params").select(
        *[c.split()[0] for c in RAW_SCHEMA.split(", ")])


def run_stream(spark, arrivals, delay, timeout):
    """(episodes, late events) of events that come in the given batches."""
    base = scratch_path(spark, "t-assembly")
    frame(spark, arrivals[0]).filter("false").write.parquet(f"{base}/in")
    source = spark.readStream.schema(RAW_SCHEMA).parquet(f"{base}/in")
    late = 0
    for rows in arrivals:
        frame(spark, rows).write.mode("append").parquet(f"{base}/in")
        with rocksdb(spark):
            q = sinks.run_available(assembly.closed_requests(source, delay, timeout),
                                    lambda df, i: sinks.write_batch(df, f"{base}/out", i), f"{base}/checkpoint")
        late += assembly.late_events(q)
    return assembly.episodes(sinks.read_batches(spark, f"{base}/out", assembly.CLOSED_SCHEMA + ", batch_id INT")), late


COLUMNS = ["page_id", "request_id", "start_seq", "emit_seq", "outcome", "url", "request.headers", "response.status", "response.bytes_received"]


def shown(df):
    return sorted((str(tuple(r)) for r in df.select(*COLUMNS).collect()))


def test_order_and_batches_do_not_matter(spark):
    """Nothing is late: what comes out equals the batch assembly, but for what has not ended."""
    rnd = random.Random(5)
    rows = random_events(rnd, 160)
    last = event(9, "z", 1000, "off", BASE_US + 10_000_000_000)  # moves the watermark behind everything
    shuffled = rows[:]
    for i in range(0, len(shuffled), 20):  # out of order by up to twenty seconds
        part = shuffled[i:i + 20]
        rnd.shuffle(part)
        shuffled[i:i + 20] = part
    found, late = run_stream(spark, [shuffled[:70], shuffled[70:110], shuffled[110:], [last]], "30 seconds", 100_000)
    want = capture.assemble(frame(spark, rows)).filter("outcome <> 'open'")
    assert late == 0 and shown(found) == shown(want)


def test_items_that_nothing_ends_expire_and_late_events_are_counted(spark):
    second = lambda n: BASE_US + n * 1_000_000
    arrivals = [
        [event(1, "a", 1, "start", second(0)), event(1, "b", 2, "start", second(1)), event(1, "a", 3, "response", second(5)),
         event(1, "c", 4, "start", second(100))],
        # the watermark is at 90 s: these two are late, and c's end is not
        [event(1, "a", 5, "end", second(6)), event(1, "b", 6, "end", second(50)), event(1, "c", 7, "end", second(95)), event(2, "d", 8, "start", second(130))],
        [event(2, "d", 9, "response", second(131)), event(2, "e", 10, "off", second(10_000))],
    ]
    found, late = run_stream(spark, arrivals, "10 seconds", 20)
    rows = {r.request_id: (r.start_seq, r.emit_seq, r.outcome) for r in found.collect()}
    # c's end happened before its start
    assert rows == {"a": (1, None, "expired"), "b": (2, None, "expired"), "c": (4, None, "expired"), "d": (8, None, "expired")}
    assert late == 2


def test_an_end_after_the_timeout_closes_nothing(spark):
    second = lambda n: BASE_US + n * 1_000_000
    rows = [event(1, "a", 1, "start", second(0)), event(1, "a", 2, "end", second(21)), event(1, "a", 3, "start", second(30)),
            event(1, "a", 4, "response", second(31)), event(1, "a", 5, "response", second(32)), event(1, "a", 6, "end", second(50)),
            event(1, "a", 7, "start", second(60)), event(1, "a", 8, "again", second(61)), event(1, "a", 9, "fail", second(62)),
            event(1, "z", 10, "off", second(1000))]
    found, late = run_stream(spark, [rows], "1 seconds", 20)
    assert late == 0
    assert sorted((r.start_seq, r.emit_seq, r.outcome) for r in found.collect()) == [
        (1, None, "expired"), (3, 6, "finished"), (7, 8, "redirect"), (8, 9, "failed")]
    done = {r.start_seq: r for r in found.collect()}
    assert done[3].response.bytes_received == 6
    assert [h.value for h in done[3].request.headers] == ["5"]  # the newest headers that were really sent


def test_requests_that_share_a_bucket_stay_apart(spark, monkeypatch):
    """All requests in one state, in three arrivals, out of order within the delay."""
    monkeypatch.setattr(assembly, "closed_requests", partial(assembly.closed_requests, buckets=1))
    rnd = random.Random(11)
    rows = random_events(rnd, 120, requests=12)
    last = event(9, "z", 1000, "off", BASE_US + 10_000_000_000)
    shuffled = [r for i in range(0, len(rows), 20) for r in rnd.sample(rows[i:i + 20], len(rows[i:i + 20]))]
    found, late = run_stream(spark, [shuffled[:50], shuffled[50:], [last]], "30 seconds", 100_000)
    want = capture.assemble(frame(spark, rows)).filter("outcome <> 'open'")
    assert late == 0 and shown(found) == shown(want)
