"""Crawl logs and job states over the event table.

Events are read as the lines of a bot's log: twenty jobs, five kinds of
messages, levels from the value in ``props``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcloom import fixed_values as V
from arcloom.operators import crawl_log, jobs, sinks
from arcloom.plans.base import k_of, micros, query, table
from arcloom.session import scratch_path

NOISE = V.FEED_IGNORED_MESSAGES[0]


def log_lines(events: DataFrame) -> DataFrame:
    """``(seq, line)``: each event as one JSON line; works on batch and stream alike.

    signup = queued, view = started, purchase = finished or (every 7th) fetch
    forwarded, error = aborted or (every 3rd) connection noise, click =
    forwarded stats, or recursion progress for odd values.
    """
    e = events.select(F.col("event_id").alias("seq"), "user_id", "event_type", k_of().alias("k"), micros().alias("us"))
    k, kind = F.col("k"), F.col("event_type")
    fetches = (kind == "purchase") & (k % 7 == 0)
    uuid = (
        F.when(kind == "signup", V.MSG_QUEUED).when(kind == "view", V.MSG_STARTED)
        .when(kind == "click", V.MSG_FORWARDED).when(fetches, V.MSG_FORWARDED)
        .when(kind == "purchase", V.MSG_FINISHED).when(k % 3 == 0, NOISE).otherwise(V.MSG_ABORTED)
    )
    url = F.concat(F.lit("http://s.example/"), F.col("user_id"))
    data = F.when(fetches, F.to_json(F.struct(
        F.array(F.lit("grab"), url).alias("command"), url.alias("url"), F.lit(V.MSG_FETCH).alias("uuid"),
    ))).when((kind == "click") & (k % 2 == 0), F.to_json(F.struct(
        (k * 1000).alias("bytesRcv"), F.when(k % 4 == 0, k % 5).alias("crashed"), (k % 9).alias("failed"),
        k.alias("requests"), F.lit(V.MSG_STATS).alias("uuid"),
    ))).when(kind == "click", F.to_json(F.struct(
        (k * 2).alias("have"), k.alias("pending"), F.lit(1).alias("running"), F.lit(V.MSG_RECURSION).alias("uuid"),
    )))
    line = F.to_json(F.struct(
        F.when(kind == "signup", F.array(F.lit("crawl"), url)).alias("cmdline"),
        F.parse_json(data).alias("data"),
        F.concat(F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00")).alias("date"),
        F.concat(F.lit("job"), F.col("user_id") % 20).alias("job"),
        (k % 4).alias("level"),
        kind.alias("msg"),
        F.when(kind == "signup", url).alias("url"),
        F.when(kind == "signup", F.concat(F.lit("nick"), F.col("user_id") % 7)).alias("user"),
        uuid.alias("uuid"),
    ))
    return e.select("seq", line.alias("line"))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl_log.parse(log_lines(table(spark, sf_dir, "events")))


SQL_LOG = f"""log AS (
  SELECT event_id AS seq, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, epoch_us(ts) AS us,
         'job' || (user_id % 20) AS job, 'http://s.example/' || user_id AS url FROM events),
m AS (SELECT *, k % 4 AS level, event_type = 'purchase' AND k % 7 = 0 AS is_fetch,
             event_type = 'click' AND k % 2 = 0 AS is_stats, event_type = 'click' AND k % 2 = 1 AS is_rec,
             event_type = 'error' AND k % 3 = 0 AS is_noise,
             CASE WHEN event_type = 'signup' THEN 'pending' WHEN event_type = 'view' THEN 'running'
                  WHEN event_type = 'purchase' AND k % 7 <> 0 THEN 'finished'
                  WHEN event_type = 'error' AND k % 3 <> 0 THEN 'aborted' END AS status FROM log)"""


@query("log_level", f"WITH {SQL_LOG} SELECT seq, level, job FROM m WHERE level >= 2")
def log_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir).filter(crawl_log.at_least(V.LEVEL_WARNING)).select("seq", "level", "job")


@query("log_deny", f"WITH {SQL_LOG} SELECT seq, event_type AS msg FROM m WHERE NOT is_noise")
def log_deny(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl_log.without_messages(crawl_log.entries(parsed(spark, sf_dir))).select("seq", "msg")


SQL_REDACTED = f"""CASE
  WHEN event_type = 'signup' THEN '{{"date":"' || d || '","job":"' || job || '","level":' || level ||
       ',"msg":"signup","url":"' || url || '","user":"nick' || (user_id % 7) || '","uuid":"{V.MSG_QUEUED}"}}'
  WHEN is_fetch THEN '{{"data":{{"url":"' || url || '","uuid":"{V.MSG_FETCH}"}},"date":"' || d || '","job":"' || job ||
       '","level":' || level || ',"msg":"purchase","uuid":"{V.MSG_FORWARDED}"}}'
  ELSE '' END"""


@query("log_redact", f"""
WITH {SQL_LOG}, dated AS (SELECT *, strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.%f+00:00') AS d FROM m)
SELECT seq, {SQL_REDACTED} AS line FROM dated WHERE event_type = 'signup' OR is_fetch""")
def log_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that carry something secret, after it was taken out."""
    p = crawl_log.entries(parsed(spark, sf_dir))
    secret = (F.col("uuid") == V.MSG_QUEUED) | (crawl_log.field("data.uuid") == V.MSG_FETCH)
    return p.filter(secret).select("seq", crawl_log.redacted().alias("line"))


@query("log_tail", f"WITH {SQL_LOG} SELECT seq, job FROM m WHERE NOT is_noise ORDER BY seq DESC LIMIT 1000")
def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 1000 lines of the feed; the limit is the feature."""
    return crawl_log.tail(crawl_log.feed(parsed(spark, sf_dir))).select("seq", "job")


@query("log_urls_topk", f"""
WITH {SQL_LOG}, r AS (SELECT job, seq, url, row_number() OVER (PARTITION BY job ORDER BY seq DESC) AS nth FROM m WHERE is_fetch)
SELECT * FROM r WHERE nth <= 5""")
def log_urls_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl_log.fetched_urls(parsed(spark, sf_dir), n=5)


@query("log_context", f"WITH {SQL_LOG} SELECT seq, CASE WHEN event_type = 'signup' THEN url ELSE 'http://seed.example/' END AS url, 'feed' AS context FROM m")
def log_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bound context fills what an entry does not say itself; ``tmp`` is unbound again."""
    p = crawl_log.entries(parsed(spark, sf_dir)).withColumn("url", crawl_log.field("url"))
    bound = crawl_log.bind(p, url=F.lit("http://seed.example/"), context=F.lit("feed"), tmp=F.lit(1))
    return crawl_log.unbind(bound, "tmp").select("seq", "url", "context")


@query("console_levels", """
SELECT event_id, CASE event_type WHEN 'error' THEN 3 WHEN 'view' THEN 2 WHEN 'click' THEN 0 ELSE 1 END AS level FROM events""")
def console_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arcloom.functions.text import console_level

    kind = F.col("event_type")
    name = F.when(kind == "error", "error").when(kind == "view", "warning").when(kind == "click", "verbose").otherwise(kind)
    return table(spark, sf_dir, "events").select("event_id", console_level(name).alias("level"))


# --- jobs ---------------------------------------------------------------------------

STATE_COLUMNS = ("requests", "failed", "bytesRcv", "crashed", "pending", "have", "running")


def shown_state(state: DataFrame) -> DataFrame:
    stamp = lambda c: F.coalesce(F.unix_micros(c), F.lit(-1)).alias(c)
    return state.select("job", "status", "url", "user", stamp("queued_at"), stamp("started_at"),
                        stamp("finished_at"), stamp("aborted_at"), *STATE_COLUMNS)


SQL_LIFE = """job,
  CASE WHEN count(*) FILTER (status = 'aborted') > 0 THEN 'aborted'
       ELSE coalesce(arg_max(status, seq) FILTER (status IS NOT NULL), 'undefined') END AS status,
  coalesce(arg_max(url, seq) FILTER (status = 'pending'), 'unknown') AS url,
  coalesce(arg_max('nick' || (user_id % 7), seq) FILTER (status = 'pending'), '<unknown>') AS "user",
  coalesce(min(us) FILTER (status = 'pending'), -1) AS queued_at, coalesce(min(us) FILTER (status = 'running'), -1) AS started_at,
  coalesce(min(us) FILTER (status = 'finished'), -1) AS finished_at, coalesce(min(us) FILTER (status = 'aborted'), -1) AS aborted_at"""
SQL_RECURSION = """coalesce(arg_max(k, seq) FILTER (is_rec), 0) AS pending, coalesce(arg_max(k * 2, seq) FILTER (is_rec), 0) AS have,
  coalesce(max(1) FILTER (is_rec), 0) AS running"""
SQL_LATEST = f"""{SQL_LOG}, state AS (SELECT {SQL_LIFE},
  coalesce(arg_max(k, seq) FILTER (is_stats), 0) AS requests, coalesce(arg_max(k % 9, seq) FILTER (is_stats), 0) AS failed,
  coalesce(arg_max(k * 1000, seq) FILTER (is_stats), 0) AS bytesRcv,
  coalesce(arg_max(CASE WHEN k % 4 = 0 THEN k % 5 ELSE 0 END, seq) FILTER (is_stats), 0) AS crashed,
  {SQL_RECURSION} FROM m GROUP BY job)"""
SQL_NEWEST_LIFE = SQL_LIFE.replace("""CASE WHEN count(*) FILTER (status = 'aborted') > 0 THEN 'aborted'
       ELSE coalesce(""", "coalesce(").replace("'undefined') END AS status", "'undefined') AS status")
SQL_MERGE = f"""{SQL_LOG}, state AS (SELECT {SQL_NEWEST_LIFE},
  coalesce(arg_max(k, seq) FILTER (is_stats), 0) AS requests, coalesce(arg_max(k % 9, seq) FILTER (is_stats), 0) AS failed,
  coalesce(arg_max(k * 1000, seq) FILTER (is_stats), 0) AS bytesRcv,
  coalesce(arg_max(k % 5, seq) FILTER (is_stats AND k % 4 = 0), 0) AS crashed,
  {SQL_RECURSION} FROM m GROUP BY job)"""


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.job_events(parsed(spark, sf_dir))


@query("job_state_latest", f"WITH {SQL_LATEST} SELECT * FROM state")
def job_state_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown_state(jobs.state_latest(job_events(spark, sf_dir)))


@query("job_state_merge", f"WITH {SQL_MERGE} SELECT * FROM state")
def job_state_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown_state(jobs.state_merge(job_events(spark, sf_dir), abort_is_final=False))


@query("job_report", f"""
WITH {SQL_LATEST}
SELECT job, 'Job ' || job || ' is ' || status || ': pages done ' || have || ', waiting ' || pending || ', crashed ' || crashed ||
  '; requests ' || requests || ', failed ' || failed || '; ' ||
  CASE WHEN bytesRcv < 1024 THEN printf('%.1f B', bytesRcv * 1.0) ELSE printf('%.1f KiB', bytesRcv / 1024) END || ' from ' || url AS report
FROM state""")
def job_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.report_line(jobs.state_latest(job_events(spark, sf_dir)))


@query("fleet_status", f"""
WITH {SQL_MERGE}
SELECT CASE WHEN status IN ('finished', 'aborted') THEN 'finished' ELSE status END AS shown_status,
       count(*) AS n_jobs, CAST(sum(bytesRcv) AS BIGINT) AS bytes_rcv FROM state GROUP BY 1""")
def fleet_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.fleet(jobs.state_merge(job_events(spark, sf_dir), abort_is_final=False))


@query("job_messages", f"""
WITH {SQL_LOG}, q AS (SELECT job, arg_max(url, seq) AS job_url FROM m WHERE event_type = 'signup' AND user_id % 20 < 15 GROUP BY job)
SELECT seq, coalesce(job_url, 'unknown') AS job_url FROM m LEFT JOIN q USING (job)""")
def job_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with their job; five jobs were queued before this log began and are unknown."""
    p = crawl_log.entries(parsed(spark, sf_dir))
    late = ~F.col("job").isin(*[f"job{i}" for i in range(15, 20)])
    known = jobs.state_latest(jobs.job_events(p.filter((F.col("uuid") == V.MSG_QUEUED) & late)))
    return jobs.with_job(p.select("seq", "job"), known).select("seq", "job_url")


# --- totals -------------------------------------------------------------------------


def crawl_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a crawler's own log: page stats, cumulative stats, exits and ignored URLs."""
    e = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), "user_id", "event_type", k_of().alias("k"))
    k, kind = F.col("k"), F.col("event_type")
    uuid = (F.when(kind.isin("view", "click"), V.MSG_STATS).when(kind == "purchase", V.MSG_EXIT)
            .when(kind == "error", V.MSG_SCHEME_IGNORED).otherwise(V.MSG_RECURSION))
    stats = kind.isin("view", "click")
    line = F.to_json(F.struct(
        F.concat(F.lit("crawl"), F.col("user_id") % 5).alias("job"), uuid.alias("uuid"),
        F.when(kind == "view", crawl_log.PAGE_CONTEXT).when(kind == "click", crawl_log.CRAWL_CONTEXT).alias("context"),
        F.when(stats, k).alias("requests"), F.when(stats, k - k % 3).alias("finished"),
        F.when(stats & (k % 2 == 0), k % 3).alias("failed"), F.when(stats, k * 10).alias("bytesRcv"),
        F.when(kind == "click", k % 4).alias("crashed"), F.when(kind == "purchase", k % 4).alias("status"),
    ))
    return crawl_log.parse(e.select("seq", line.alias("line")))


SQL_CRAWL = """c AS (SELECT event_id AS seq, 'crawl' || (user_id % 5) AS job, event_type,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""


@query("crawl_totals", f"""
WITH {SQL_CRAWL}
SELECT job, CAST(sum(k) FILTER (event_type = 'view') AS BIGINT) AS requests,
       CAST(sum(k - k % 3) FILTER (event_type = 'view') AS BIGINT) AS finished,
       CAST(sum(CASE WHEN k % 2 = 0 THEN k % 3 ELSE 0 END) FILTER (event_type = 'view') AS BIGINT) AS failed,
       CAST(sum(k * 10) FILTER (event_type = 'view') AS BIGINT) AS bytes_rcv,
       count(*) FILTER (event_type = 'purchase' AND k % 4 <> 0) AS crashed,
       count(*) FILTER (event_type = 'error') AS ignored FROM c GROUP BY job""")
def crawl_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl_log.crawl_totals(crawl_lines(spark, sf_dir), "job")


@query("crawl_totals_latest", f"""
WITH {SQL_CRAWL}
SELECT job, arg_max(k, seq) AS requests, arg_max(k - k % 3, seq) AS finished,
       arg_max(CASE WHEN k % 2 = 0 THEN k % 3 ELSE 0 END, seq) AS failed, arg_max(k * 10, seq) AS bytes_rcv,
       arg_max(k % 4, seq) AS crashed, 0 AS ignored FROM c WHERE event_type = 'click' GROUP BY job""")
def crawl_totals_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl_log.latest_totals(crawl_lines(spark, sf_dir), "job")


@query("exit_codes", f"""
WITH {SQL_CRAWL}
SELECT job, k % 4 AS status, (['ok', 'fail', 'browser crash', 'navigate error'])[CAST(k % 4 + 1 AS INT)] AS meaning, count(*) AS n_pages
FROM c WHERE event_type = 'purchase' GROUP BY ALL""")
def exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl_log.exit_codes(crawl_lines(spark, sf_dir), "job")


# --- sinks --------------------------------------------------------------------------


@query("json_lines_roundtrip", """
SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
       event_id % 5 = 0 AS cut FROM events""")
def json_lines_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as JSON lines, every fifth also as a broken line, and read tolerantly.

    Each entry tells whether its broken twin turned up in the side output.
    """
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    path = scratch_path(spark, "json-lines")
    sinks.write_json_lines(e, path)
    broken = e.filter("event_id % 5 = 0").select(F.concat(F.lit('{"event_id": '), F.col("event_id"), F.lit(', "x')).alias("value"))
    broken.write.mode("append").text(path)
    p = crawl_log.parse(spark.read.text(path).withColumnRenamed("value", "line"))
    good = crawl_log.entries(p).select(
        *[crawl_log.field(n, t).alias(n) for n, t in
          (("event_id", "bigint"), ("user_id", "bigint"), ("event_type", "string"), ("value", "double"))],
        F.unix_micros(crawl_log.field("ts", "timestamp")).alias("us"),
        F.get_json_object(crawl_log.field("props"), "$.k").cast("bigint").alias("k"))
    bad = crawl_log.corrupt(p).select(F.regexp_extract("line", r"(\d+)", 1).cast("bigint").alias("event_id"))
    return good.join(bad.withColumn("cut", F.lit(True)), "event_id", "left").withColumn(
        "cut", F.coalesce("cut", F.lit(False)))


@query("partitioned_output", r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages),
n AS (SELECT page_id, host, '2024-01-0' || (page_id % 3 + 1) AS date,
             row_number() OVER (ORDER BY page_id) AS seqnum FROM p)
SELECT *, host || '-' || date || '-' || seqnum || '.warc.gz' AS name FROM n""")
def partitioned_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    date = F.concat(F.lit("2024-01-0"), F.col("page_id") % 3 + 1)
    path = scratch_path(spark, "by-host")
    sinks.write_by_host(sinks.with_output_parts(pages, "url", date, "page_id"), path)
    return spark.read.schema("page_id BIGINT, seqnum BIGINT, host STRING, date STRING").parquet(path).select(
        "page_id", "host", "date", "seqnum",
        sinks.output_name("{host}-{date}-{seqnum}.warc.gz", F.col("host"), F.col("date"), F.col("seqnum")).alias("name"))
