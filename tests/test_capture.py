import base64
import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arcloom.fixed_values import EV_FAILED, EV_FINISHED, EV_REQUEST, EV_RESPONSE
from arcloom.operators import capture, records
from arcloom.session import scratch_path
from arcloom.sources.events import RAW_SCHEMA, root_navigations
from arcloom.streaming.captures import EPISODE_SCHEMA, CaptureAssembler
from arcloom.streaming.sinks import read_batches


def start(url="http://h/x", redirect=None, clock=1.0, wall=100.0, **request):
    return EV_REQUEST, {"type": "Script", "timestamp": clock, "wallTime": wall, "initiator": {"type": "parser"},
                        "request": {"url": url, "method": "GET", "headers": {"A": "1"}, **request},
                        **({"redirectResponse": redirect} if redirect else {})}


def answer(url="http://h/x", status=200, clock=2.5, **more):
    r = {"url": url, "status": status, "statusText": "OK", "headers": {"H": "1\n2"}, "mimeType": "text/html", **more}
    return EV_RESPONSE, {"timestamp": clock, "type": "Document", "response": r}


def done(size=7):
    return EV_FINISHED, {"encodedDataLength": size}


FAIL = (EV_FAILED, {})
MOVED = {"url": "http://h/x", "status": 301, "statusText": "Moved", "headers": {"Location": "/y"}, "mimeType": ""}


def raw(spark, events, request_id="r"):
    rows = []
    for i, e in enumerate(events):
        rid, (method, params) = e if isinstance(e[0], str) and len(e) == 2 and isinstance(e[1], tuple) else (request_id, e)
        rows.append((1, i, method, None, json.dumps({"requestId": rid, **params})))
    return spark.createDataFrame(rows, RAW_SCHEMA).withColumn("ts", F.timestamp_seconds(F.lit(100) + F.col("seq")))


def outcomes(df):
    return [(r.start_seq, r.outcome) for r in df.orderBy("start_seq").collect()]


def test_sequences(spark):
    cases = [
        ([start(), answer(), done()], ["finished"]),
        ([start(), FAIL], ["failed"]),
        ([start(), answer(), FAIL], ["failed"]),
        ([start(), done()], ["no_response"]),
        ([start()], ["open"]),
        ([start(), start(redirect=MOVED), answer(), done()], ["redirect", "finished"]),
        ([start(), start(), answer(), done()], ["superseded", "finished"]),
        ([done(), answer(), FAIL], []),
        ([start(), answer(), done(), answer(), done(), FAIL], ["finished"]),
        ([start("data:,x"), answer(), done()], []),
        ([start(), start("data:,x"), answer(), done()], ["finished"]),
        ([start(), answer("blob:x"), done()], ["no_response"]),
        ([start(redirect=MOVED), answer(), done()], ["finished"]),
        ([start(), FAIL, start(redirect=MOVED), done()], ["failed", "no_response"]),
        ([start(), ("other", start()), answer(), ("other", FAIL), done()], ["finished", "failed"]),
    ]
    for events, want in cases:
        for span in (2, 1 << 20):
            assert [o for _, o in outcomes(capture.assemble(raw(spark, events), span))] == want, events


def test_captured_values(spark):
    events = [start(hasPostData=True, postData="ä"), answer(status=500), answer(requestHeaders={"S": "t"}, remoteIPAddress="1.2.3.4"),
              done(42)]
    c = capture.assemble(raw(spark, events)).first()
    assert c.resource_type == "Document" and c.remote_ip == "1.2.3.4"
    assert [(h.name, h.value) for h in c.request.headers] == [("S", "t")]
    assert bytes(c.request.body) == "ä".encode() and c.request.has_post_data
    assert c.response.status == 200 and c.response.bytes_received == 42
    assert [(h.name, h.value) for h in c.response.headers] == [("H", "1"), ("H", "2")]
    # the clock is relative, the first event anchors it
    assert (c.response.ts - c.request.ts).total_seconds() == 1.5


def test_redirect_has_no_body_no_bytes_and_the_time_of_its_request(spark):
    events = [start(), answer(), start("http://h/y", redirect=MOVED, clock=9.0, wall=108.0), FAIL]
    r, f = capture.assemble(raw(spark, events)).orderBy("start_seq").collect()
    assert (r.outcome, r.response.status, r.response.bytes_received, r.response.body) == ("redirect", 301, 0, None)
    assert r.response.ts == r.request.ts
    assert f.response is None
    t = capture.page_totals(capture.assemble(raw(spark, events))).first()
    assert (t.requests, t.finished, t.failed, t.bytes_rcv) == (2, 1, 1, 0)


event = st.one_of(
    st.builds(lambda u, r: start(u, redirect=MOVED if r else None), st.sampled_from(["http://h/x", "data:,x"]), st.booleans()),
    st.builds(answer, st.sampled_from(["http://h/x", "blob:x"]), st.sampled_from([200, 404])),
    st.builds(done, st.integers(0, 9)), st.just(FAIL))


def sequential(events):
    """The rules as a plain loop over one page."""
    open_, closed = {}, []

    def close(rid, outcome, status=None, size=0):
        closed.append((open_.pop(rid)[0], outcome, status, size))

    for seq, (rid, (method, p)) in enumerate(events):
        if method == EV_REQUEST:
            if not p["request"]["url"].startswith("http"):
                continue
            if rid in open_:
                close(rid, "redirect", 301) if "redirectResponse" in p else close(rid, "superseded")
            open_[rid] = [seq, None]
        elif rid not in open_:
            continue
        elif method == EV_RESPONSE:
            if p["response"]["url"].startswith("http"):
                open_[rid][1] = p["response"]["status"]
        elif method == EV_FAILED:
            close(rid, "failed")
        else:
            status = open_[rid][1]
            close(rid, "finished", status, p["encodedDataLength"]) if status else close(rid, "no_response")
    return set(closed)


def shown(df):
    rows = df.filter("outcome <> 'open'").collect()
    return {(r.start_seq, r.outcome, r.response and r.response.status, r.response.bytes_received if r.response else 0)
            for r in rows}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b"]), event), min_size=4, max_size=30), st.integers(1, 29))
def test_batch_and_stream_are_the_sequential_rules(spark, events, cut):
    want = sequential(events)
    df = raw(spark, events)
    assert shown(capture.assemble(df, span=4)) == want
    base = scratch_path(spark, "t-capture")
    worker = CaptureAssembler(f"{base}/out", f"{base}/state", span=4)
    for batch_id, part in enumerate((df.filter(F.col("seq") < cut), df.filter(F.col("seq") >= cut))):
        worker(part, batch_id)
        worker(part, batch_id)  # repeated after a failure
    out = read_batches(spark, f"{base}/out", EPISODE_SCHEMA + ", batch_id INT")
    assert shown(out) == want and out.count() == len(want)


def test_stream_expires_old_requests(spark):
    base = scratch_path(spark, "t-expire")
    worker = CaptureAssembler(f"{base}/out", f"{base}/state", expire_seconds=50)
    df = raw(spark, [start(), ("b", start(wall=140.0)), answer(), done()])
    late = df.filter("seq >= 2").withColumn("ts", F.timestamp_seconds(F.lit(170)))
    worker(df.filter("seq < 2"), 0)
    worker(late.filter("false").unionByName(df.filter("seq = 0").limit(0)).unionByName(
        raw(spark, [("c", start(wall=170.0))]).withColumn("seq", F.lit(9).cast("bigint")).withColumn("ts", F.timestamp_seconds(F.lit(170)))), 1)
    worker(late, 2)
    out = read_batches(spark, f"{base}/out", EPISODE_SCHEMA + ", batch_id INT")
    assert [(r.request_id, r.outcome, r.batch_id) for r in out.collect()] == [("r", "expired", 1)]


def test_bodies_and_records(spark):
    events = [("t", start()), ("t", answer()), ("t", done()), ("b", start()), ("b", answer(mimeType="image/png")), ("b", done()),
              ("n", start("http://h/p?q#f", hasPostData=True)), ("n", FAIL)]
    c = capture.emitted(capture.assemble(raw(spark, events)))
    bodies = spark.createDataFrame(
        [(1, "t", 2, "äöü", False), (1, "b", 5, base64.b64encode(b"\x89PNG").decode(), True)],
        "page_id BIGINT, request_id STRING, emit_seq BIGINT, body STRING, base64 BOOLEAN")
    recs = {(r.request_id, r.rec_type): r for r in records.capture_records(capture.attach_bodies(c, bodies)).collect()}
    assert set(recs) == {("t", "request"), ("t", "response"), ("b", "request"), ("b", "response"), ("n", "request")}
    t = recs["t", "response"]
    assert bytes(t.payload) == "äöü".encode() and t.truncated is None
    assert {h.name: h.value for h in t.http_headers}["Content-Type"] == "text/html; charset=utf-8"
    assert t.concurrent_to == recs["t", "request"].record_id
    assert {h.name: h.value for h in recs["b", "response"].http_headers}["Content-Type"] == "image/png"
    lost = recs["n", "request"]
    assert lost.truncated == "unspecified" and lost.http_start_line == "GET /p?q HTTP/1.1"
    both = records.request_records(c).unionByName(records.response_records(c))
    assert both.exceptAll(records.capture_records(c)).count() == 0
    assert records.capture_records(c).count() == 5


def test_equality_ignores_ids_times_and_bytes(spark):
    events = [("a", start()), ("a", answer()), ("a", done(1)),
              ("b", start(clock=5.0, wall=500.0)), ("b", answer(clock=9.0)), ("b", done(99)),
              ("c", start()), ("c", answer(status=404)), ("c", done(1))]
    groups = capture.equal_groups(capture.emitted(capture.assemble(raw(spark, events))))
    assert sorted((g.start_seq, g.n_equal) for g in groups.collect()) == [(0, 2), (6, 1)]


def test_crawl_diff(spark):
    def crawl(*urls):
        return capture.emitted(capture.assemble(raw(spark, [
            (u + str(s), e) for u, s in urls for e in (start("http://h/" + u), answer(status=s), done())])))
    diff = capture.crawl_diff(crawl(("a", 200), ("b", 200), ("c", 200)), crawl(("b", 200), ("c", 404), ("d", 200)))
    assert {r.url[-1]: r.change for r in diff.collect()} == {"a": "removed", "b": "same", "c": "changed", "d": "added"}


def test_root_navigations(spark):
    rows = [(1, 0, "Page.frameNavigated", None, '{"frame": {"id": "F", "url": "http://a/", "mimeType": "text/html"}}'),
            (1, 1, "Page.frameNavigated", None, '{"frame": {"id": "G", "parentId": "F", "url": "http://b/", "mimeType": "x"}}'),
            (1, 2, "Page.frameStartedLoading", None, '{"frameId": "F"}')]
    roots = spark.createDataFrame([(1, "F")], "page_id BIGINT, root_frame STRING")
    out = root_navigations(spark.createDataFrame(rows, RAW_SCHEMA), roots).collect()
    assert [(r.seq, r.url, r.mime_type) for r in out] == [(0, "http://a/", "text/html")]
