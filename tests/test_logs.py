import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arcloom import fixed_values as V
from arcloom.operators import crawl_log as L
from arcloom.operators import jobs as J
from arcloom.operators.log_batches import log_batches


def parsed(spark, *entries):
    rows = [(i, e if isinstance(e, str) else json.dumps(e)) for i, e in enumerate(entries)]
    return L.parse(spark.createDataFrame(rows, "seq BIGINT, line STRING"))


def test_tolerant_scan(spark):
    p = parsed(spark, {"uuid": "u", "level": 2, "msg": ["a", 1], "date": "2020-01-02T03:04:05.000006+00:00"}, "{broken", "", "[1]", "12",
               {"level": 1})
    assert [r.seq for r in L.entries(p).orderBy("seq").collect()] == [0, 5]
    assert [r.seq for r in L.corrupt(p).orderBy("seq").collect()] == [1, 2, 3, 4]
    first = p.filter("seq = 0").first()
    assert (first.level, first.uuid, first.msg, first.date.microsecond) == (2, "u", '["a",1]', 6)
    assert p.filter("seq = 5").first().uuid is None


def test_levels_and_routes(spark):
    p = L.entries(parsed(spark, {"level": 0, "uuid": "a"}, {"level": 3, "uuid": V.FEED_IGNORED_MESSAGES[0]}, {"level": 2}))
    assert [r.seq for r in p.filter(L.at_least(2)).orderBy("seq").collect()] == [1, 2]
    assert [r.seq for r in L.without_messages(p).orderBy("seq").collect()] == [0, 2]
    assert [r.seq for r in L.only_messages(p, ["a"]).collect()] == [0]


def test_bound_values_do_not_override(spark):
    df = spark.createDataFrame([("x", None), (None, "y")], "a STRING, b STRING")
    out = L.transform_chain(df, lambda d: L.bind(d, a=F.lit("A"), c=F.lit(1)), lambda d: L.unbind(d, "b"))
    assert [tuple(r) for r in out.collect()] == [("x", 1), ("A", 1)]


def test_redaction(spark):
    queue = {"uuid": V.MSG_QUEUED, "cmdline": ["s"], "job": "j", "nested": {"b": 1, "a": [1, {"x": None}]}}
    fetch = {"uuid": V.MSG_FORWARDED, "data": {"uuid": V.MSG_FETCH, "command": ["s"], "url": "u"}}
    other = {"uuid": V.MSG_FORWARDED, "data": {"uuid": V.MSG_STATS, "command": "kept"}, "cmdline": "kept"}
    bare = {"uuid": V.MSG_QUEUED}
    got = [json.loads(r.line) for r in L.feed(parsed(spark, queue, fetch, other, bare, "bad")).orderBy("seq").collect()]
    assert got == [{k: v for k, v in queue.items() if k != "cmdline"},
                   {"uuid": V.MSG_FORWARDED, "data": {"uuid": V.MSG_FETCH, "url": "u"}}, other, bare]


def test_tail_and_urls(spark):
    fetches = [{"job": f"j{i % 2}", "uuid": V.MSG_FORWARDED, "data": {"uuid": V.MSG_FETCH, "url": f"u{i}"}} for i in range(10)]
    p = parsed(spark, *fetches)
    assert [r.seq for r in L.tail(p, n=3).collect()] == [9, 8, 7]
    assert {(r.job, r.url) for r in L.fetched_urls(p, n=2).collect()} == {("j1", "u9"), ("j1", "u7"), ("j0", "u8"), ("j0", "u6")}


def test_extracted_links(spark):
    p = parsed(spark, {"uuid": V.MSG_LINKS, "links": ["a", "b"]}, {"uuid": "x", "links": ["c"]}, {"uuid": V.MSG_LINKS})
    assert [(r.seq, r.link) for r in L.extracted_links(p, "seq").collect()] == [(0, "a"), (0, "b")]


def test_page_and_cumulative_stats_are_not_mixed(spark):
    page = {"uuid": V.MSG_STATS, "context": L.PAGE_CONTEXT, "job": "j", "requests": 2, "bytesRcv": 10}
    total = {"uuid": V.MSG_STATS, "context": L.CRAWL_CONTEXT, "job": "j", "requests": 99, "crashed": 1}
    p = parsed(spark, page, total, page, {**total, "requests": 100}, {"uuid": V.MSG_EXIT, "status": 3, "job": "j"},
               {"uuid": V.MSG_EXIT, "status": 0, "job": "j"}, {"uuid": V.MSG_SCHEME_IGNORED, "job": "j"})
    t = L.crawl_totals(p, "job").first()
    assert (t.requests, t.finished, t.bytes_rcv, t.crashed, t.ignored) == (4, 0, 20, 1, 1)
    n = L.latest_totals(p, "job").first()
    assert (n.requests, n.crashed, n.ignored) == (100, 1, 0)
    assert {(r.status, r.meaning, r.n_pages) for r in L.exit_codes(p).collect()} == {(0, "ok", 1), (3, "navigate error", 1)}


def lines(spark, sizes, file_seq=0):
    rows = [("f", file_seq, i, "x" * (n - 1)) for i, n in enumerate(sizes)]
    return spark.createDataFrame(rows, "file_path STRING, file_seq INT, seq BIGINT, line STRING")


def cuts(df, **kw):
    return [len(r.body) for r in log_batches(df, **kw).orderBy("file_seq", "batch").collect()]


def sequential_cuts(sizes, limit):
    out, held = [], 0
    for n in sizes:
        held += n
        if held > limit:
            out, held = out + [held], 0
    return out + [held] if held else out


def test_a_batch_ends_with_the_line_that_exceeds_the_limit(spark):
    df = lines(spark, [4, 4, 3, 9, 10, 1, 1])
    assert cuts(df, limit=10) == [11, 19, 2] == sequential_cuts([4, 4, 3, 9, 10, 1, 1], 10)
    assert cuts(df, limit=0) == [4, 4, 3, 9, 10, 1, 1]
    assert cuts(df.unionByName(lines(spark, [5, 6], 1)), limit=10) == [11, 19, 2, 11]
    assert sum(cuts(df, limit=10, exact=False)) == 32


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=40), st.integers(0, 30), st.sampled_from([1, 2, 3, 7, 100]))
def test_cuts_do_not_depend_on_segments(spark, sizes, limit, span):
    assert cuts(lines(spark, sizes), limit=limit, span=span) == sequential_cuts(sizes, limit)


def forwarded(job, message, **data):
    return {"uuid": V.MSG_FORWARDED, "job": job, "data": {"uuid": message, **data}}


def state(spark, fold, *entries, **kw):
    return {r.job: r for r in fold(J.job_events(parsed(spark, *entries)), **kw).collect()}


def test_job_states(spark):
    entries = [
        {"uuid": V.MSG_QUEUED, "job": "a", "url": "http://a/", "user": "nick"}, {"uuid": V.MSG_STARTED, "job": "a"},
        forwarded("a", V.MSG_STATS, requests=5, crashed=2), forwarded("a", V.MSG_RECURSION, pending=1, have=2, running=1),
        forwarded("a", V.MSG_STATS, requests=7), {"uuid": V.MSG_ABORTED, "job": "b"}, {"uuid": V.MSG_FINISHED, "job": "b"},
        {"uuid": "other", "job": "c"}, {"uuid": V.MSG_FINISHED},
    ]
    latest, merge = state(spark, J.state_latest, *entries), state(spark, J.state_merge, *entries)
    assert set(latest) == {"a", "b", "c"}
    a = latest["a"]
    assert (a.status, a.url, a.user, a.requests, a.crashed, a.have, a.running) == ("running", "http://a/", "nick", 7, 0, 2, 1)
    assert merge["a"].crashed == 2 and merge["a"].requests == 7
    assert (latest["b"].status, latest["b"].url, latest["b"].user) == ("aborted", "unknown", "<unknown>")
    assert state(spark, J.state_latest, *entries, abort_is_final=False)["b"].status == "finished"
    assert latest["c"].status == "undefined"
    report = {r.job: r.report for r in J.report_line(J.state_merge(J.job_events(parsed(spark, *entries)))).collect()}
    assert report["a"] == "Job a is running: pages done 2, waiting 1, crashed 2; requests 7, failed 0; 0.0 B from http://a/"
    shown = {r.shown_status: r.n_jobs for r in J.fleet(J.state_merge(J.job_events(parsed(spark, *entries)))).collect()}
    assert shown == {"running": 1, "finished": 1, "undefined": 1}


def test_unknown_job_gets_placeholders(spark):
    known = spark.createDataFrame([("a", "http://a/", "n")], "job STRING, url STRING, user STRING")
    messages = spark.createDataFrame([(0, "a"), (1, "b"), (2, None)], "seq BIGINT, job STRING")
    got = {r.seq: (r.job_url, r.job_user) for r in J.with_job(messages, known).collect()}
    assert got == {0: ("http://a/", "n"), 1: ("unknown", "<unknown>"), 2: ("unknown", "<unknown>")}
