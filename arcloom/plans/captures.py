"""Captures, page idleness and capture records over the event table.

The event table is read as a browser's event log: users are requests, every
ten users share a page, and the event type tells the browser event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcloom.fixed_values import EV_FAILED, EV_FINISHED, EV_REQUEST, EV_RESPONSE
from arcloom.functions import headers as H
from arcloom.operators import capture, idle, records
from arcloom.plans.base import k_of, micros, query, table
from arcloom.sources.events import keep_root

EPOCH_US = 1704067200000000


def raw_events(events: DataFrame) -> DataFrame:
    """The event table as capture events; works on batch and stream alike."""
    e = events.select(
        F.col("event_id").alias("seq"), (F.col("user_id") % 10).alias("page_id"), "user_id", "event_type",
        k_of().alias("k"), micros().alias("us"),
    )
    k, user, kind = F.col("k"), F.col("user_id"), F.col("event_type")
    url = F.concat(F.when(k % 2 == 0, "https").otherwise("http"), F.lit("://h"), user % 7, F.lit(".example/r"),
                   user, F.lit("?k="), k % 5)
    rel, wall = (F.col("us") - EPOCH_US) / F.lit(1e6), F.col("us") / F.lit(1e6)
    strings = lambda **kv: F.create_map(*[x for n, v in kv.items() for x in (F.lit(n.replace("_", "-")), v)])
    request = F.struct(
        F.when(k % 10 == 0, F.concat(F.lit("data:,"), user)).otherwise(url).alias("url"),
        F.when(k % 6 == 1, "POST").otherwise("GET").alias("method"),
        strings(Accept=F.lit("*/*"), X_N=F.when(k % 3 == 0, "a\nb").otherwise("c")).alias("headers"),
        (k % 6 == 1).alias("hasPostData"),
        F.when(k % 12 == 1, F.concat(F.lit("a=ü"), k)).alias("postData"),
    )
    response = F.struct(
        F.when(k % 25 == 0, F.lit("blob:x")).otherwise(url).alias("url"),
        F.when(k % 3 == 0, 404).otherwise(200).alias("status"),
        F.lit("").alias("statusText"),
        strings(Content_Type=F.lit("text/plain"), Content_Encoding=F.lit("gzip"),
                Set_Cookie=F.lit("a=1\nb=2")).alias("headers"),
        F.when(k % 5 == 0, strings(Accept=F.lit("text/html"))).alias("requestHeaders"),
        F.lit("text/html").alias("mimeType"),
        F.concat(F.lit("10.0.0."), user).alias("remoteIPAddress"),
        F.lit("h2").alias("protocol"),
    )
    redirect = F.struct(
        url.alias("url"), F.lit(301).alias("status"), F.lit("Moved").alias("statusText"),
        strings(Location=F.lit("/x")).alias("headers"), F.lit("").alias("mimeType"),
        F.concat(F.lit("10.1.0."), user).alias("remoteIPAddress"), F.lit("http/1.1").alias("protocol"),
    )
    is_start = kind.isin("view", "signup")
    params = F.struct(
        user.cast("string").alias("requestId"),
        F.when(is_start, F.when(k % 4 == 0, "Document").otherwise("Script"))
        .when((kind == "click") & (k % 4 == 1), "Document").alias("type"),
        rel.alias("timestamp"),
        F.when(is_start, wall).alias("wallTime"),
        F.when(is_start, F.lit("parser")).alias("initiator"),
        F.when(is_start, request).alias("request"),
        F.when(kind == "click", response).alias("response"),
        F.when(kind == "signup", redirect).alias("redirectResponse"),
        F.when(kind == "purchase", k * 1000).alias("encodedDataLength"),
    )
    method = (F.when(is_start, EV_REQUEST).when(kind == "click", EV_RESPONSE)
              .when(kind == "purchase", EV_FINISHED).otherwise(EV_FAILED))
    return e.select("page_id", "seq", method.alias("method"), F.timestamp_micros("us").alias("ts"),
                    F.to_json(params).alias("params"))


def bodies(events: DataFrame) -> DataFrame:
    """Fetched bodies of finished loads; a third is missing, half of the rest is binary."""
    k = k_of()
    binary = k % 2 == 0
    text = F.concat(F.lit("bödy"), k)
    return events.filter((F.col("event_type") == "purchase") & (k % 3 != 0)).select(
        (F.col("user_id") % 10).alias("page_id"), F.col("user_id").cast("string").alias("request_id"),
        F.col("event_id").alias("emit_seq"),
        F.when(binary, F.base64(F.encode(text, "UTF-8"))).otherwise(text).alias("body"), binary.alias("base64"))


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.assemble(raw_events(table(spark, sf_dir, "events")))


SQL_CAPTURES = f"""ev AS (
  SELECT event_id AS seq, user_id % 10 AS page_id, user_id, CAST(user_id AS VARCHAR) AS request_id, event_type,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, epoch_us(ts) AS us FROM events),
e1 AS (
  SELECT *, event_type IN ('view', 'signup') AS is_start, event_type IN ('purchase', 'error') AS is_end,
    CASE WHEN k % 2 = 0 THEN 'https' ELSE 'http' END || '://h' || (user_id % 7) || '.example/r' || user_id || '?k=' || (k % 5) AS u
  FROM ev WHERE NOT (event_type IN ('view', 'signup') AND k % 10 = 0) AND NOT (event_type = 'click' AND k % 25 = 0)),
e2 AS (SELECT *, sum(CAST(is_start AS INT)) OVER (PARTITION BY page_id, request_id ORDER BY seq) AS ep FROM e1),
e3 AS (SELECT *, min(CASE WHEN is_end THEN seq END) OVER (PARTITION BY page_id, request_id, ep) AS end_seq
       FROM e2 WHERE ep > 0),
starts AS (SELECT *, lead(seq) OVER r AS next_seq, lead(event_type) OVER r AS next_type
           FROM e3 WHERE is_start WINDOW r AS (PARTITION BY page_id, request_id ORDER BY seq)),
resp AS (SELECT page_id, request_id, ep, arg_max(k, seq) AS rk, arg_max(us, seq) AS rus,
                max(CASE WHEN k % 5 = 0 THEN seq END) AS sent_seq
         FROM e3 WHERE event_type = 'click' AND (end_seq IS NULL OR seq < end_seq) GROUP BY ALL),
ends AS (SELECT seq, event_type AS end_type, k AS end_k FROM e3 WHERE is_end),
c0 AS (
  SELECT s.page_id, s.request_id, s.user_id, s.ep AS episode, s.seq AS start_seq, s.u AS url, s.k, s.us, r.rk, r.rus,
         r.sent_seq, s.end_seq, e.end_k, s.next_seq,
         CASE WHEN e.end_type = 'error' THEN 'failed'
              WHEN e.end_type = 'purchase' THEN CASE WHEN r.rk IS NOT NULL THEN 'finished' ELSE 'no_response' END
              WHEN s.next_seq IS NULL THEN 'open' WHEN s.next_type = 'signup' THEN 'redirect' ELSE 'superseded' END AS outcome
  FROM starts s LEFT JOIN resp r USING (page_id, request_id, ep) LEFT JOIN ends e ON e.seq = s.end_seq),
caps AS (
  SELECT *, coalesce(end_seq, next_seq) AS emit_seq,
    CASE WHEN rk % 4 = 1 THEN 'Document' WHEN k % 4 = 0 THEN 'Document' ELSE 'Script' END AS resource_type,
    CASE WHEN outcome = 'redirect' THEN '10.1.0.' || user_id WHEN rk IS NOT NULL THEN '10.0.0.' || user_id ELSE '' END AS remote_ip,
    CASE WHEN outcome = 'redirect' THEN 'http/1.1' WHEN rk IS NOT NULL THEN 'h2' ELSE '' END AS protocol,
    CASE WHEN outcome = 'redirect' THEN 301 WHEN outcome = 'finished' THEN CASE WHEN rk % 3 = 0 THEN 404 ELSE 200 END ELSE 0 END AS status,
    CASE WHEN outcome = 'finished' THEN end_k * 1000 ELSE 0 END AS bytes_received,
    us AS request_us,
    CASE WHEN outcome = 'redirect' THEN us WHEN outcome = 'finished' THEN
      CAST(round((us / 1e6 + ((rus - {EPOCH_US}) / 1e6 - (us - {EPOCH_US}) / 1e6)) * 1e6) AS BIGINT) ELSE 0 END AS response_us,
    CASE WHEN k % 6 = 1 THEN 'POST' ELSE 'GET' END AS method,
    CASE WHEN sent_seq IS NOT NULL THEN 'Accept: text/html|'
         WHEN k % 3 = 0 THEN 'Accept: */*|X-N: a|X-N: b|' ELSE 'Accept: */*|X-N: c|' END AS rq_headers,
    CASE WHEN k % 12 = 1 THEN 'a=ü' || k ELSE '' END AS rq_body
  FROM c0),
emitted AS (SELECT * FROM caps WHERE outcome IN ('finished', 'redirect', 'failed'))"""


def joined_headers(headers: Column) -> Column:
    return F.array_join(F.transform(headers, lambda h: F.concat(h["name"], F.lit(": "), h["value"], F.lit("|"))), "")


@query("captures", f"""
WITH {SQL_CAPTURES}
SELECT page_id, request_id, CAST(episode AS BIGINT) AS episode, start_seq, coalesce(emit_seq, -1) AS emit_seq, url, outcome,
       resource_type, remote_ip, protocol, status, bytes_received, request_us, response_us, method,
       rq_headers, rq_body FROM caps""")
def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = episodes(spark, sf_dir)
    rq, rs = F.col("request"), F.col("response")
    return c.select(
        "page_id", "request_id", "episode", "start_seq", F.coalesce("emit_seq", F.lit(-1)).alias("emit_seq"),
        "url", "outcome", "resource_type", F.coalesce("remote_ip", F.lit("")).alias("remote_ip"),
        F.coalesce("protocol", F.lit("")).alias("protocol"),
        F.coalesce(rs["status"], F.lit(0)).alias("status"),
        F.coalesce(rs["bytes_received"], F.lit(0)).alias("bytes_received"),
        F.unix_micros(rq["ts"]).alias("request_us"),
        F.coalesce(F.unix_micros(rs["ts"]), F.lit(0)).alias("response_us"),
        rq["method"].alias("method"), joined_headers(rq["headers"]).alias("rq_headers"),
        F.coalesce(F.decode(rq["body"], "UTF-8"), F.lit("")).alias("rq_body"),
    )


@query("capture_stats", f"""
WITH {SQL_CAPTURES}
SELECT page_id, count(*) AS requests, count(*) FILTER (outcome <> 'failed') AS finished,
       count(*) FILTER (outcome = 'failed') AS failed, CAST(sum(bytes_received) AS BIGINT) AS bytes_rcv
FROM emitted GROUP BY page_id""")
def capture_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.page_totals(episodes(spark, sf_dir))


SQL_CONTENT = """url, remote_ip, protocol, resource_type, method, rq_headers, rq_body, status, outcome = 'failed'"""


@query("capture_equal", f"""
WITH {SQL_CAPTURES},
g AS (SELECT min(struct_pack(p := page_id, s := start_seq)) AS f, count(*) AS n_equal FROM emitted GROUP BY {SQL_CONTENT})
SELECT f.p AS page_id, f.s AS start_seq, n_equal FROM g""")
def capture_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.equal_groups(capture.emitted(episodes(spark, sf_dir))).drop("fingerprint")


@query("crawl_diff", f"""
WITH {SQL_CAPTURES},
d AS (SELECT url, start_seq % 2 AS crawl, start_seq, concat_ws('~', {SQL_CONTENT}) AS c FROM emitted),
b AS (SELECT url, arg_max(c, start_seq) AS c FROM d WHERE crawl = 0 GROUP BY url),
a AS (SELECT url, arg_max(c, start_seq) AS c FROM d WHERE crawl = 1 GROUP BY url)
SELECT url, CASE WHEN b.c IS NULL THEN 'added' WHEN a.c IS NULL THEN 'removed'
                 WHEN a.c = b.c THEN 'same' ELSE 'changed' END AS change
FROM b FULL JOIN a USING (url)""")
def crawl_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = capture.emitted(episodes(spark, sf_dir))
    return capture.crawl_diff(c.filter("start_seq % 2 = 0"), c.filter("start_seq % 2 = 1"))


# --- records of captures ----------------------------------------------------------


def archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.attach_bodies(capture.emitted(episodes(spark, sf_dir)), bodies(table(spark, sf_dir, "events")))


SQL_REQUEST_LINE = "method || ' /r' || user_id || '?k=' || (k % 5) || ' HTTP/1.1'"


@query("request_records", f"""
WITH {SQL_CAPTURES}
SELECT page_id AS file_seq, emit_seq * 2 AS record_seq, url AS target_uri,
       strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%SZ') AS warc_date,
       {SQL_REQUEST_LINE} AS start_line, rq_headers AS http_headers, request_id,
       CASE WHEN k % 6 = 1 AND k % 12 <> 1 THEN 'unspecified' ELSE '' END AS truncated,
       strlen({SQL_REQUEST_LINE}) + 2 + strlen(replace(rq_headers, '|', '::')) + 2 + strlen(rq_body) AS content_length
FROM emitted""")
def request_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.request_records(episodes(spark, sf_dir)).select(
        F.col("file_seq").cast("bigint").alias("file_seq"), "record_seq", "target_uri",
        F.date_format("warc_date", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("warc_date"),
        F.col("http_start_line").alias("start_line"), joined_headers(F.col("http_headers")).alias("http_headers"),
        "request_id", F.coalesce("truncated", F.lit("")).alias("truncated"), "content_length")


@query("response_records", f"""
WITH {SQL_CAPTURES},
r AS (SELECT *, outcome = 'finished' AND end_k % 3 <> 0 AS has_body, end_k % 2 <> 0 AS is_text,
             strlen('bödy' || end_k) AS body_len FROM emitted WHERE outcome <> 'failed')
SELECT page_id AS file_seq, emit_seq * 2 + 1 AS record_seq, remote_ip AS ip,
       CASE WHEN outcome = 'redirect' THEN 'HTTP/1.1 301 Moved' WHEN status = 404 THEN 'HTTP/1.1 404 Not Found'
            ELSE 'HTTP/1.1 200 OK' END AS start_line,
       CASE WHEN outcome = 'redirect' THEN 'Location: /x|'
            WHEN has_body THEN 'Content-Type: text/html' || CASE WHEN is_text THEN '; charset=utf-8' ELSE '' END
                 || '|Set-Cookie: a=1|Set-Cookie: b=2|Content-Length: ' || body_len || '|'
            ELSE 'Content-Type: text/html|Set-Cookie: a=1|Set-Cookie: b=2|' END AS http_headers,
       CASE WHEN has_body THEN '' ELSE 'unspecified' END AS truncated,
       CASE WHEN has_body THEN md5('bödy' || end_k) ELSE md5('') END AS body_md5,
       {SQL_REQUEST_LINE} AS request_line
FROM r""")
def response_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response records, each with the line of the request record it is tied to."""
    built = records.capture_records(archived(spark, sf_dir))
    return records.pair_responses(built).select(
        F.col("file_seq").cast("bigint").alias("file_seq"), "record_seq", F.coalesce("ip", F.lit("")).alias("ip"),
        F.col("http_start_line").alias("start_line"), joined_headers(F.col("http_headers")).alias("http_headers"),
        F.coalesce("truncated", F.lit("")).alias("truncated"), F.md5("payload").alias("body_md5"), "request_line")


@query("records_log_join", f"""
WITH {SQL_CAPTURES},
per AS (SELECT page_id, request_id, count(*) AS n_requests, count(*) FILTER (outcome <> 'failed') AS n_responses,
               min(emit_seq) * 2 AS first_request FROM emitted GROUP BY ALL)
SELECT e.seq, coalesce(n_requests, 0) AS n_requests, coalesce(n_responses, 0) AS n_responses,
       coalesce(first_request, -1) AS first_request
FROM ev e LEFT JOIN per USING (page_id, request_id)""")
def records_log_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event, taken as a log entry, with the records of its request."""
    built = records.capture_records(episodes(spark, sf_dir))
    # the record's place stands for its id, which the oracle cannot know
    placed = built.withColumn("record_id", F.col("record_seq").cast("string"))
    log = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 10).cast("int").alias("file_seq"), F.col("user_id").cast("string").alias("request_id"),
        F.col("event_id").alias("seq"))
    return capture.correlate_log(log, placed).select(
        "seq", F.coalesce("n_requests", F.lit(0)).alias("n_requests"),
        F.coalesce("n_responses", F.lit(0)).alias("n_responses"),
        F.coalesce(F.col("request_record").cast("bigint"), F.lit(-1)).alias("first_request"))


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as bare records of ten archives: captures start, documents load, conversions follow."""
    e, k = table(spark, sf_dir, "events"), k_of()
    kind = F.col("event_type")
    return e.select(
        (F.col("user_id") % 10).cast("int").alias("file_seq"), F.col("event_id").alias("record_seq"),
        F.concat(F.lit("r"), F.col("event_id")).alias("record_id"),
        F.when(kind == "signup", "warcinfo").when(kind == "purchase", "conversion").otherwise("response").alias("rec_type"),
        F.concat(F.lit("u"), F.col("user_id") % 50).alias("target_uri"),
        ((kind == "click") & (k % 2 == 0)).alias("is_document"))


@query("asof_warcinfo", """
SELECT event_id AS record_seq,
       coalesce(last_value(CASE WHEN event_type = 'signup' THEN 'r' || event_id END IGNORE NULLS) OVER (
         PARTITION BY user_id % 10 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS warcinfo_id
FROM events""")
def asof_warcinfo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.asof_warcinfo(event_records(spark, sf_dir)).select(
        "record_seq", F.coalesce("warcinfo_id", F.lit("")).alias("warcinfo_id"))


SQL_ASOF_DOCUMENT = """
WITH w AS (
  SELECT event_id AS record_seq, event_type,
         last_value(CASE WHEN event_type = 'click' AND CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0
                    THEN 'r' || event_id END IGNORE NULLS) OVER (
           PARTITION BY user_id % 10, user_id % 50 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS d
  FROM events)
SELECT record_seq, coalesce(d, 'none') AS refers_to FROM w WHERE event_type = 'purchase'"""


@query("asof_document", SQL_ASOF_DOCUMENT)
def asof_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = event_records(spark, sf_dir)
    found = records.asof_document(items, F.col("is_document"), F.col("rec_type") == "conversion")
    return found.select("record_seq", F.coalesce("refers_to", F.lit("none")).alias("refers_to"))


@query("header_unfold", """
WITH v AS (
  SELECT event_id, unnest(['single', 'x' || event_id, 'y' || user_id]) AS value,
         unnest(['Accept', 'Set-Cookie', 'Set-Cookie']) AS name, unnest([0, 1, 2]) AS pos FROM events)
SELECT * FROM v""")
def header_unfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = F.create_map(
        F.lit("Accept"), F.lit("single"), F.lit("Set-Cookie"),
        F.concat(F.lit("x"), F.col("event_id"), F.lit("\ny"), F.col("user_id")))
    return table(spark, sf_dir, "events").select("event_id", F.posexplode(H.unfold(folded)).alias("pos", "h")).select(
        "event_id", "pos", "h.name", "h.value")


@query("header_rewrite", """
WITH e AS (SELECT event_id, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id,
  CASE WHEN k % 4 = 0 THEN 'content-TYPE: text/plain|' WHEN k % 2 = 0 THEN 'content-TYPE: text/html; charset=utf-8|'
       ELSE 'content-TYPE: text/html|' END || 'X-U: ' || user_id || '|' ||
  CASE WHEN k % 3 = 0 THEN '' ELSE 'Content-Length: ' || strlen(event_type) || '|' END AS headers
FROM e""")
def header_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = k_of()
    given = F.array(
        H.header("content-TYPE", F.lit("text/plain")), H.header("Transfer-Encoding", F.lit("chunked")),
        H.header("X-U", F.col("user_id").cast("string")), H.header("content-encoding", F.lit("br")))
    body = F.when(k % 3 != 0, F.encode("event_type", "UTF-8"))
    out = H.response_headers(given, F.when(k % 4 != 0, "text/html"), body, k % 2 == 0)
    return table(spark, sf_dir, "events").select("event_id", joined_headers(out).alias("headers"))


# --- idleness -----------------------------------------------------------------------


def frames(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event_type").isin("view", "purchase")).select(
        (F.col("user_id") % 50).alias("page_id"), F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("frame_id"),
        F.when(F.col("event_type") == "view", "started").otherwise("stopped").alias("kind"))


SQL_IDLE = """f AS (
  SELECT user_id % 50 AS page_id, event_id AS seq, epoch_us(ts) AS us, user_id AS frame_id,
         CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS s FROM events WHERE event_type IN ('view', 'purchase')),
d AS (SELECT *, s - coalesce(lag(s) OVER (PARTITION BY page_id, frame_id ORDER BY seq), 0) AS delta FROM f),
c AS (SELECT *, sum(delta) OVER (PARTITION BY page_id ORDER BY seq) AS loading,
             lead(us) OVER (PARTITION BY page_id ORDER BY seq) AS next_us FROM d WHERE delta <> 0),
spans AS (SELECT page_id, us AS from_us, next_us AS until_us FROM c WHERE loading = 0),
pages_ AS (SELECT page_id, min(us) AS start_us FROM f GROUP BY page_id),
first_load AS (SELECT page_id, min(us) AS until_us FROM d WHERE delta = 1 GROUP BY page_id),
all_spans AS (SELECT * FROM spans UNION ALL
              SELECT p.page_id, start_us, until_us FROM pages_ p LEFT JOIN first_load USING (page_id))"""


@query("frame_idle", f"""
WITH {SQL_IDLE}
SELECT page_id, from_us AS idle_from_us, coalesce(until_us, -1) AS idle_until_us FROM spans""")
def frame_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = idle.idle_intervals(frames(table(spark, sf_dir, "events")))
    return spans.select("page_id", F.unix_micros("idle_from").alias("idle_from_us"),
                        F.coalesce(F.unix_micros("idle_until"), F.lit(-1)).alias("idle_until_us"))


@query("stop_reason", f"""
WITH {SQL_IDLE},
i AS (SELECT page_id, min(from_us) + 14400000000 AS stop FROM all_spans
      WHERE until_us IS NULL OR until_us - from_us >= 14400000000 GROUP BY page_id)
SELECT page_id, CASE WHEN stop <= start_us + 864000000000 THEN 'idle' ELSE 'timeout' END AS reason,
       least(coalesce(stop, start_us + 864000000000), start_us + 864000000000) - start_us AS after_us
FROM pages_ LEFT JOIN i USING (page_id)""")
def stop_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Idle for four hours or, at the latest, after ten days."""
    stops = idle.stop_times(frames(table(spark, sf_dir, "events")), 4 * 3600, 10 * 86400)
    return stops.select("page_id", "reason", "after_us")


@query("unmatched_stops", f"""
WITH {SQL_IDLE}
SELECT page_id, count(*) FILTER (s = 0 AND delta = 0) AS unmatched FROM d GROUP BY page_id""")
def unmatched_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idle.unmatched_stops(frames(table(spark, sf_dir, "events")))


@query("root_navigations", """
SELECT event_id AS seq, user_id % 10 AS page_id, user_id AS frame_id FROM events
WHERE event_type = 'view' AND user_id = user_id % 10""")
def root_navigations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as navigations; each page's root frame is its user with the least id."""
    e = table(spark, sf_dir, "events")
    moves = e.filter("event_type = 'view'").select(
        F.col("event_id").alias("seq"), (F.col("user_id") % 10).alias("page_id"), F.col("user_id").alias("frame_id"))
    roots = e.select((F.col("user_id") % 10).alias("page_id")).distinct().withColumn("root_frame", F.col("page_id"))
    return keep_root(moves, roots)


@query("activity_sessions", """
WITH g AS (SELECT user_id, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events),
s AS (SELECT *, sum(CASE WHEN prev IS NULL OR us - prev > 21600000000 THEN 1 ELSE 0 END)
                OVER (PARTITION BY user_id ORDER BY us) AS n FROM g)
SELECT user_id, min(us) AS start_us, max(us) + 21600000000 AS end_us, count(*) AS n_events FROM s GROUP BY user_id, n""")
def activity_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return idle.activity_sessions(e, "user_id", "ts", 6 * 3600).select(
        "user_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "n_events")
