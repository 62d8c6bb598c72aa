"""The streaming operators, run over the driver tables until all input is consumed.

Each is checked against the SQL of its batch twin.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcloom.functions import headers as H
from arcloom.operators import crawl_log, jobs, outlinks, records
from arcloom.plans import archives as A
from arcloom.plans import captures as C
from arcloom.plans import logs as L
from arcloom.plans import urls as U
from arcloom.plans.base import micros, query, table
from arcloom.session import scratch_path
from arcloom.sources.files import locate
from arcloom.sources.warc import read_warc, stream_warc
from arcloom.streaming import assembly, batches, captures, feed, idle, links, sinks


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a file stream, be it one file or a folder of files."""
    schema = table(spark, sf_dir, name).schema
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(schema)
    system, p = locate(path)
    if system.get_file_info(p).type == fs.FileType.File:
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return reader.option("maxFilesPerTrigger", 64).parquet(path)


def closed_episodes(spark: SparkSession, sf_dir: str) -> str:
    base = scratch_path(spark, "stream-captures")
    worker = captures.CaptureAssembler(f"{base}/out", f"{base}/state")
    sinks.run_available(C.raw_events(stream_table(spark, sf_dir, "events")), worker, f"{base}/checkpoint")
    return f"{base}/out"


@query("stream_captures", f"""
WITH {C.SQL_CAPTURES}
SELECT page_id, request_id, start_seq, emit_seq, outcome, status, bytes_received, response_us, rq_headers
FROM caps WHERE outcome <> 'open'""")
def stream_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sinks.read_batches(spark, closed_episodes(spark, sf_dir), captures.EPISODE_SCHEMA + ", batch_id INT")
    rs = F.col("response")
    return out.select(
        "page_id", "request_id", "start_seq", "emit_seq", "outcome", F.coalesce(rs["status"], F.lit(0)).alias("status"),
        F.coalesce(rs["bytes_received"], F.lit(0)).alias("bytes_received"),
        F.coalesce(F.unix_micros(rs["ts"]), F.lit(0)).alias("response_us"),
        C.joined_headers(F.col("request.headers")).alias("rq_headers"))


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB."""
    before = {k: spark.conf.get(k, None) for k in idle.ROCKSDB}
    for k, v in idle.ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


ARRIVALS = 4


def arriving(spark: SparkSession, df: DataFrame, folder: str) -> DataFrame:
    """A stream over a folder that is still empty."""
    df.filter("false").write.parquet(folder)
    return spark.readStream.schema(df.schema).parquet(folder)


def in_arrivals(df: DataFrame, order: str, folder: str, take, delayed: str = "0", columns: list[str] | None = None) -> None:
    """Let a table come in over time: ``ARRIVALS`` parts in the order of ``order``, ``take()`` after each.

    ``delayed`` says by how many parts a row comes later than it should;
    ``columns`` are those that come, all without it.
    """
    low, high = df.agg(F.min(order), F.max(order)).first()
    part = F.expr(f"least(({order} - {low}) * {ARRIVALS} div {max(high - low, 1)} + {delayed}, {ARRIVALS - 1})")
    for i in range(ARRIVALS):
        df.filter(part == i).select(columns or df.columns).write.mode("append").parquet(folder)
        take()


@query("stream_captures_arrivals", f"""
WITH {C.SQL_CAPTURES}
SELECT page_id, request_id, start_seq, emit_seq, outcome, status, bytes_received FROM caps WHERE outcome <> 'open'""")
def stream_captures_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures whose events come in several micro-batches, with open requests carried between them."""
    base = scratch_path(spark, "stream-arrivals")
    worker = captures.CaptureAssembler(f"{base}/out", f"{base}/state")
    events = table(spark, sf_dir, "events")
    source = arriving(spark, events, f"{base}/in")
    in_arrivals(events, "event_id", f"{base}/in",
                lambda: sinks.run_available(C.raw_events(source), worker, f"{base}/checkpoint"))
    out = sinks.read_batches(spark, f"{base}/out", captures.EPISODE_SCHEMA + ", batch_id INT")
    rs = F.col("response")
    return out.select("page_id", "request_id", "start_seq", "emit_seq", "outcome", F.coalesce(rs["status"], F.lit(0)).alias("status"),
                      F.coalesce(rs["bytes_received"], F.lit(0)).alias("bytes_received"))


DELAYED = "CASE WHEN event_id % 7 = 3 THEN 1 WHEN event_id % 11 = 5 THEN 2 ELSE 0 END"
SQL_LATE = f"""low AS (SELECT min(event_id) AS low, max(event_id) AS high, (max(epoch_us(ts)) - min(epoch_us(ts))) // 8000 AS delay_ms FROM events),
arrived AS (
  SELECT event_id, epoch_us(ts) AS us, least((event_id - low) * {ARRIVALS} // greatest(high - low, 1) + {DELAYED}, {ARRIVALS - 1}) AS part, delay_ms
  FROM events, low),
marks AS (
  SELECT part, max(max(us) // 1000 - max(delay_ms)) OVER (ORDER BY part) * 1000 AS mark FROM arrived GROUP BY part),
-- an event is late if the watermark of the parts before it has passed it
judged AS (SELECT a.event_id, coalesce(a.us <= m.mark, false) AS late FROM arrived a LEFT JOIN marks m ON m.part = a.part - 1)"""


@query("stream_captures_late", f"""
WITH {C.SQL_CAPTURES.partition("e2 AS")[0]} {SQL_LATE},
n AS (SELECT count(*) AS n_late FROM e1 JOIN judged ON event_id = seq WHERE late),
final AS (SELECT max(mark) AS mark, (SELECT delay_ms FROM low) * 250 AS timeout_us FROM marks),
-- what the last watermark has passed, in the order of event time
t AS (
  SELECT e1.*, sum(CAST(is_start AS INT)) OVER (PARTITION BY page_id, request_id ORDER BY us, seq) AS ep
  FROM e1 JOIN judged ON event_id = seq, final WHERE NOT late AND us <= mark),
s AS (
  SELECT *, lead(seq) OVER r AS next_seq, lead(event_type) OVER r AS next_type, lead(us) OVER r AS next_us
  FROM t WHERE is_start WINDOW r AS (PARTITION BY page_id, request_id ORDER BY us, seq)),
x AS (
  SELECT t.page_id, t.request_id, t.ep, arg_min(t.seq, (t.us, t.seq)) AS end_seq, arg_min(t.event_type, (t.us, t.seq)) AS end_type,
         arg_min(t.k, (t.us, t.seq)) AS end_k, min((t.us, t.seq)) AS end_at
  FROM t JOIN s USING (page_id, request_id, ep), final WHERE t.is_end AND t.us <= s.us + timeout_us GROUP BY ALL),
p AS (
  SELECT t.page_id, t.request_id, t.ep, arg_max(t.k, (t.us, t.seq)) AS rk
  FROM t JOIN s USING (page_id, request_id, ep) LEFT JOIN x USING (page_id, request_id, ep), final
  WHERE t.event_type = 'click' AND t.us <= s.us + timeout_us AND (end_at IS NULL OR (t.us, t.seq) < end_at) GROUP BY ALL),
o AS (
  SELECT s.page_id, s.request_id, s.seq AS start_seq, x.end_seq, s.next_seq, p.rk, x.end_k,
         CASE WHEN end_type = 'error' THEN 'failed' WHEN end_type = 'purchase' THEN CASE WHEN rk IS NOT NULL THEN 'finished' ELSE 'no_response' END
              WHEN next_us <= s.us + timeout_us THEN CASE WHEN next_type = 'signup' THEN 'redirect' ELSE 'superseded' END
              WHEN s.us + timeout_us <= mark THEN 'expired' ELSE 'open' END AS outcome
  FROM s LEFT JOIN x USING (page_id, request_id, ep) LEFT JOIN p USING (page_id, request_id, ep), final)
SELECT page_id, request_id, start_seq, CASE WHEN outcome = 'expired' THEN -1 ELSE coalesce(end_seq, next_seq) END AS emit_seq, outcome,
       CASE WHEN outcome = 'redirect' THEN 301 WHEN outcome = 'finished' THEN CASE WHEN rk % 3 = 0 THEN 404 ELSE 200 END ELSE 0 END AS status,
       CASE WHEN outcome = 'finished' THEN end_k * 1000 ELSE 0 END AS bytes_received, n_late
FROM o, n WHERE outcome <> 'open'""")
def stream_captures_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in four arrivals, some of them one or two parts late: those the watermark has passed are left out and counted."""
    base = scratch_path(spark, "stream-late")
    events = table(spark, sf_dir, "events")
    first, last = events.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    delay_ms = (last - first) // 8000
    source = C.raw_events(arriving(spark, events, f"{base}/in"))
    late = []

    def take() -> None:
        # a query's plan belongs to its run
        closed = assembly.closed_requests(source, f"{delay_ms} milliseconds", delay_ms / 4e3)
        with rocksdb(spark):
            late.append(assembly.late_events(sinks.run_available(
                closed, lambda df, i: sinks.write_batch(df, f"{base}/out", i), f"{base}/checkpoint")))

    in_arrivals(events, "event_id", f"{base}/in", take, DELAYED)
    found = assembly.episodes(sinks.read_batches(spark, f"{base}/out", assembly.CLOSED_SCHEMA + ", batch_id INT"))
    rs = F.col("response")
    return found.select("page_id", "request_id", "start_seq", F.coalesce("emit_seq", F.lit(-1)).alias("emit_seq"), "outcome",
                        F.coalesce(rs["status"], F.lit(0)).alias("status"), F.coalesce(rs["bytes_received"], F.lit(0)).alias("bytes_received"),
                        F.lit(sum(late)).alias("n_late"))


@query("stream_replay_live", f"""
WITH {L.SQL_LOG}, b AS (SELECT min(event_id) AS low, max(event_id) AS high FROM events),
f AS (SELECT seq, least((seq - low) * {ARRIVALS} // greatest(high - low, 1), {ARRIVALS - 1}) AS part FROM m, b WHERE NOT is_noise)
SELECT seq FROM f WHERE part > 1
UNION ALL (SELECT seq FROM f WHERE part <= 1 ORDER BY seq DESC LIMIT 1000)""")
def stream_replay_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a subscriber sees who joins after the second arrival: the tail of that time, then all later lines."""
    base = scratch_path(spark, "stream-replay")
    worker = feed.FeedWriter(f"{base}/out", f"{base}/tail")
    events = table(spark, sf_dir, "events")
    source = L.log_lines(arriving(spark, events, f"{base}/in"))
    ends = []

    def take() -> None:
        ends.append(sinks.run_available(source, worker, f"{base}/checkpoint").lastProgress["batchId"])

    in_arrivals(events, "event_id", f"{base}/in", take)
    history, live = feed.replay(spark, worker, ends[1])
    sinks.run_available(live, lambda df, i: sinks.write_batch(df, f"{base}/live", i), f"{base}/live-checkpoint")
    later = sinks.read_batches(spark, f"{base}/live", feed.FEED_SCHEMA + ", batch_id INT")
    return history.select("seq").unionByName(later.select("seq"))


@query("stream_links_arrivals", rf"""
WITH {U.SQL_HREFS},
l AS (SELECT regexp_extract(url, '^(https?://[^/?#]+)', 1) || link AS url, split_part(url, '#', 1) AS parent FROM hrefs)
SELECT DISTINCT url FROM l""")
def stream_links_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that are new when their page arrives, each reported once over all micro-batches."""
    base = scratch_path(spark, "stream-links")
    pages = table(spark, sf_dir, "pages")
    source = outlinks.link_edges_native(arriving(spark, pages, f"{base}/in"))
    edges = source.select(F.substring_index("url", "#", 1).alias("src_url"), "dst_url")
    worker = feed.LinkDiscovery(f"{base}/visited")
    in_arrivals(pages, "page_id", f"{base}/in", lambda: sinks.run_available(edges, worker, f"{base}/checkpoint"))
    return sinks.read_batches(spark, f"{base}/visited", feed.VISITED_SCHEMA + ", batch_id INT").select("url")


@query("stream_links_seen", rf"""
WITH {U.SQL_HREFS},
l AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || link AS url, split_part(url, '#', 1) AS parent FROM hrefs),
known AS (SELECT DISTINCT url FROM l WHERE page_id % 5 = 0)
SELECT DISTINCT url, true AS parent_has_it FROM l WHERE url NOT IN (SELECT url FROM known)""")
def stream_links_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New links over four arrivals, those of every fifth page being known beforehand; the URLs seen are keyed state."""
    base = scratch_path(spark, "stream-seen")
    pages = table(spark, sf_dir, "pages")
    all_edges = outlinks.link_edges_native(pages).select(
        "page_id", F.substring_index("url", "#", 1).alias("src_url"), "dst_url")
    known = all_edges.filter(F.col("page_id") % 5 == 0).select(F.lit(None).cast("string").alias("src_url"), "dst_url")
    edges = all_edges.select("src_url", "dst_url")
    source = arriving(spark, edges, f"{base}/in")

    def take() -> None:
        with rocksdb(spark):
            sinks.run_available(feed.first_sightings(source), lambda df, i: sinks.write_batch(df, f"{base}/out", i), f"{base}/checkpoint")

    known.write.mode("append").parquet(f"{base}/in")
    take()
    in_arrivals(all_edges, "page_id", f"{base}/in", take, columns=["src_url", "dst_url"])
    found = sinks.read_batches(spark, f"{base}/out", feed.VISITED_SCHEMA + ", batch_id INT")
    pairs = edges.distinct().select(F.col("dst_url").alias("url"), F.col("src_url").alias("parent_url"), F.lit(True).alias("parent_has_it"))
    return found.join(pairs, ["url", "parent_url"], "left").select("url", F.coalesce("parent_has_it", F.lit(False)).alias("parent_has_it"))


@query("stream_asof", C.SQL_ASOF_DOCUMENT)
def stream_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversions linked with the newest document before them while records arrive, the document maybe long before."""
    base = scratch_path(spark, "stream-asof")
    items = C.event_records(spark, sf_dir)
    source = arriving(spark, items, f"{base}/in")

    def take() -> None:
        found = links.asof_document_stream(source, F.col("is_document"), F.col("rec_type") == "conversion")
        with rocksdb(spark):
            sinks.run_available(found, lambda df, i: sinks.write_batch(df, f"{base}/out", i), f"{base}/checkpoint")

    in_arrivals(items, "record_seq", f"{base}/in", take)
    schema = "file_seq BIGINT, target_uri STRING, record_seq BIGINT, record_id STRING, refers_to STRING, batch_id INT"
    return sinks.read_batches(spark, f"{base}/out", schema).select(
        "record_seq", F.coalesce("refers_to", F.lit("none")).alias("refers_to"))


def forget_commit(checkpoint: str) -> None:
    """Lose the last batch's entry of a stream's commit log, as a driver does that dies before writing it."""
    system, root = locate(f"{checkpoint}/commits")
    entries = {int(name): f.path for f in system.get_file_info(fs.FileSelector(root))
               if (name := f.path.rpartition("/")[2]).isdigit()}
    newest = entries[max(entries)]
    folder, _, name = newest.rpartition("/")
    for path in (newest, f"{folder}/.{name}.crc"):
        if system.get_file_info(path).type == fs.FileType.File:
            system.delete_file(path)


def event_items(events: DataFrame) -> dict[str, DataFrame]:
    """Events as five types of capture items."""
    doc = F.col("event_id")
    rows = events.select("event_type", "props", "event_id", F.concat(F.lit("u"), F.col("user_id")).alias("file_path"),
                         F.col("user_id").alias("file_seq"), doc.alias("record_seq"), F.col("ts").cast("timestamp").alias("warc_date"))
    body = F.concat(doc.cast("string"), F.lit(":"), F.col("props"))
    url = F.concat(F.lit("http://e.example/"), doc)
    made = {
        "view": ("script", {"path": F.concat(F.lit("/"), doc), "data": body}),
        "click": ("dom-snapshot", {"url": url, "document": F.encode(body, "UTF-8"), "viewport": F.lit("1x2")}),
        "purchase": ("screenshot", {"url": url, "yoff": doc, "data": F.encode(body, "UTF-8")}),
        "signup": ("warcinfo", {"payload": body}),
        "error": ("log", {"body": body}),
    }
    return {item: rows.filter(F.col("event_type") == kind).withColumns(columns) for kind, (item, columns) in made.items()}


@query("stream_archive", """
SELECT CASE event_type WHEN 'view' THEN 'resource' WHEN 'signup' THEN 'warcinfo' WHEN 'error' THEN 'metadata' ELSE 'conversion' END AS rec_type,
       CASE event_type WHEN 'view' THEN 'script' WHEN 'click' THEN 'dom-snapshot' WHEN 'purchase' THEN 'screenshot'
                       WHEN 'error' THEN 'log' ELSE '' END AS sub_type,
       CASE event_type WHEN 'view' THEN 'file:///' || event_id WHEN 'click' THEN 'http://e.example/' || event_id
                       WHEN 'purchase' THEN 'http://e.example/' || event_id ELSE '' END AS target_uri,
       CASE event_type WHEN 'purchase' THEN event_id ELSE -1 END AS yoff, md5(event_id || ':' || props) AS payload_md5
FROM events""")
def stream_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of five types written into one archive while they arrive, the third batch twice; each record is there once."""
    base = scratch_path(spark, "stream-archive")
    events = table(spark, sf_dir, "events")
    source = records.build_records(event_items(arriving(spark, events, f"{base}/in")))
    arrived = []

    def run() -> None:
        q = stream_warc(source, f"{base}/archive", f"{base}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        if q.exception() is not None:
            raise q.exception()

    def take() -> None:
        run()
        arrived.append(True)
        if len(arrived) == 3:
            forget_commit(f"{base}/checkpoint")  # the next run does this batch again

    in_arrivals(events, "event_id", f"{base}/in", take)
    yoff = H.value_of(F.col("headers"), records.HeaderNames().y_offset.lower()).cast("bigint")
    return read_warc(spark, f"{base}/archive").select(
        "rec_type", F.coalesce("sub_type", F.lit("")).alias("sub_type"), F.coalesce("target_uri", F.lit("")).alias("target_uri"),
        F.coalesce(yoff, F.lit(-1)).alias("yoff"), F.md5("payload").alias("payload_md5"))


@query("stream_log_batches", A.SQL_LOG_BATCHES)
def stream_log_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines of ten files in four arrivals, batched by bytes across them; cuts are those of the whole log."""
    base = scratch_path(spark, "stream-log-batches")
    worker = batches.LogBatcher(f"{base}/out", f"{base}/state", limit=3000)
    lines = A.page_log(spark, sf_dir)
    source = arriving(spark, lines, f"{base}/in")
    ends = []

    def take() -> None:
        ends.append(sinks.run_available(source, worker, f"{base}/checkpoint").lastProgress["batchId"])

    in_arrivals(lines, "seq", f"{base}/in", take)
    return A.shown_batches(worker.batches(spark, ends[-1]))


@query("stream_stats", f"""
WITH {C.SQL_CAPTURES}
SELECT page_id, count(*) AS requests, count(*) FILTER (outcome <> 'failed') AS finished,
       count(*) FILTER (outcome = 'failed') AS failed, CAST(sum(bytes_received) AS BIGINT) AS bytes_rcv
FROM emitted GROUP BY page_id""")
def stream_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals over the capture stream's output."""
    source = closed_episodes(spark, sf_dir)
    base = scratch_path(spark, "stream-stats")
    episodes = spark.readStream.schema(captures.EPISODE_SCHEMA + ", batch_id INT").parquet(source)
    totals = captures.running_totals(episodes, "page_id")
    sinks.run_available(totals, lambda df, i: sinks.write_batch(df, f"{base}/out", i), f"{base}/checkpoint", "update")
    rows = sinks.read_batches(spark, f"{base}/out",
                              "page_id BIGINT, requests BIGINT, finished BIGINT, failed BIGINT, bytes_rcv BIGINT, batch_id INT")
    return sinks.newest_per_key(rows, ["page_id"])


@query("stream_jobs", f"WITH {L.SQL_LATEST} SELECT * FROM state")
def stream_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_path(spark, "stream-jobs")
    lines = L.log_lines(stream_table(spark, sf_dir, "events"))
    state = L.shown_state(jobs.state_latest(jobs.job_events(crawl_log.parse(lines))))
    sinks.run_available(state, lambda df, i: sinks.write_batch(df, f"{base}/out", i), f"{base}/checkpoint", "update")
    columns = ", ".join(
        f"{c} {'STRING' if c in ('job', 'status', 'url', 'user') else 'BIGINT'}" for c in state.columns)
    return sinks.newest_per_key(sinks.read_batches(spark, f"{base}/out", columns + ", batch_id INT"), ["job"])


@query("stream_feed", f"WITH {L.SQL_LOG} SELECT seq, event_type AS msg, false AS secret FROM m WHERE NOT is_noise")
def stream_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_path(spark, "stream-feed")
    worker = feed.FeedWriter(f"{base}/out", f"{base}/tail")
    sinks.run_available(L.log_lines(stream_table(spark, sf_dir, "events")), worker, f"{base}/checkpoint")
    out = sinks.read_batches(spark, f"{base}/out", feed.FEED_SCHEMA + ", batch_id INT")
    return out.select("seq", F.get_json_object("line", "$.msg").alias("msg"),
                      F.rlike("line", F.lit('"(cmdline|command)":')).alias("secret"))


@query("stream_feed_tail", f"WITH {L.SQL_LOG} SELECT seq FROM m WHERE NOT is_noise ORDER BY seq DESC LIMIT 1000")
def stream_feed_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a late subscriber is shown first; the limit is the feature."""
    base = scratch_path(spark, "stream-feed")
    worker = feed.FeedWriter(f"{base}/out", f"{base}/tail")
    q = sinks.run_available(L.log_lines(stream_table(spark, sf_dir, "events")), worker, f"{base}/checkpoint")
    history, _ = feed.replay(spark, worker, q.lastProgress["batchId"])
    return history.select("seq")


@query("stream_new_links", rf"""
WITH {U.SQL_HREFS},
l AS (SELECT regexp_extract(url, '^(https?://[^/?#]+)', 1) || link AS url, split_part(url, '#', 1) AS parent FROM hrefs)
SELECT url, min(parent) AS parent_url FROM l GROUP BY url""")
def stream_new_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_path(spark, "stream-links")
    pages = stream_table(spark, sf_dir, "pages")
    edges = outlinks.link_edges_native(pages).select(F.substring_index("url", "#", 1).alias("src_url"), "dst_url")
    sinks.run_available(edges, feed.LinkDiscovery(f"{base}/visited"), f"{base}/checkpoint")
    return sinks.read_batches(spark, f"{base}/visited", feed.VISITED_SCHEMA + ", batch_id INT").select("url", "parent_url")


@query("stream_idle", f"""
WITH {C.SQL_IDLE},
i AS (SELECT page_id, min(from_us) + 14400000000 AS stop FROM all_spans
      WHERE until_us IS NULL OR until_us - from_us >= 14400000000 GROUP BY page_id)
SELECT page_id, CASE WHEN stop <= start_us + 864000000000 THEN 'idle' ELSE 'timeout' END AS reason,
       least(coalesce(stop, start_us + 864000000000), start_us + 864000000000) - start_us AS after_us
FROM pages_ LEFT JOIN i USING (page_id)""")
def stream_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages stop when idle for four hours, at the latest after ten days."""
    base = scratch_path(spark, "stream-idle")
    events = stream_table(spark, sf_dir, "events")
    frames = events.filter(F.col("event_type").isin("view", "purchase")).select(
        (F.col("user_id") % 50).alias("page_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"),
        micros().alias("us"), F.col("user_id").alias("frame_id"),
        F.when(F.col("event_type") == "view", "started").otherwise("stopped").alias("kind"))
    stops = idle.stop_stream(frames, 4 * 3600, 10 * 86400)
    with rocksdb(spark):
        sinks.run_available(stops, lambda df, i: sinks.write_batch(df, f"{base}/out", i), f"{base}/checkpoint")
    return sinks.read_batches(spark, f"{base}/out", idle.STOP_SCHEMA + ", batch_id INT").select("page_id", "reason", "after_us")
