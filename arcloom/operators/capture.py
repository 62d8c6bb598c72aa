"""Network events -> request/response captures, and what is computed from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcloom.fixed_values import EV_FAILED, EV_FINISHED, EV_REQUEST, EV_RESPONSE
from arcloom.functions import headers as H
from arcloom.functions import text as X
from arcloom.functions.urls import is_web
from arcloom.operators.skew import SEGMENT_SPAN, lookup_join, ordered_scan
from arcloom.sources.events import keys_of, params

EMITTED = ("finished", "redirect", "failed")
AUDIT_ONLY = ("no_response", "superseded", "open")


def network_events(raw: DataFrame, *keep: str) -> DataFrame:
    """Network events that can matter: off-scheme requests and responses are gone.

    ``keep`` names further columns to hand on.

    Dropping them before any shuffle is also what the rules ask for: such a
    request opens nothing and leaves an open item open.  Parameters stay as
    they came; only what decides is read here.
    """
    q = F.col("q")
    return (
        raw.filter(F.col("method").isin(EV_REQUEST, EV_RESPONSE, EV_FINISHED, EV_FAILED))
        .select("page_id", "seq", "method", "params", *keep, X.once(keys_of()).alias("q"))
        .filter(
            F.when(F.col("method") == EV_REQUEST, is_web(q["request"]["url"]))
            .when(F.col("method") == EV_RESPONSE, is_web(q["response"]["url"]))
            .otherwise(True)
        )
        .select("page_id", q["requestId"].alias("request_id"), "seq", "method", "params", *keep)
    )


def _roles(events: DataFrame, span: int) -> DataFrame:
    """One row per event that takes part in an episode, tagged with its role in it.

    Whether an item is open before an event is told by the last start or end
    before it.  A start seen while an item is open also closes that item, so it
    appears twice: as ``start`` of its own and as ``next`` of the episode before.
    """
    start = F.col("method") == EV_REQUEST
    end = F.col("method").isin(EV_FINISHED, EV_FAILED)
    scanned = ordered_scan(
        events, ["page_id", "request_id"], "seq",
        sums={"episode": start.cast("bigint")},
        previous={"opened": F.when(start, F.lit(True)).when(end, F.lit(False))},
        span=span,
    )
    is_open = F.coalesce("opened", F.lit(False))
    role = (
        F.when(start & is_open, F.array(F.lit("start"), F.lit("next")))
        .when(start, F.array(F.lit("start")))
        .when(F.col("method") == EV_RESPONSE, F.array(F.lit("response")))
        .otherwise(F.array(F.lit("end")))
    )
    return (
        scanned.filter(start | is_open)
        .select("page_id", "request_id", "seq", "method", "episode", role.alias("roles"),
                X.once(params()).alias("p"))
        .select("page_id", "request_id", "seq", "method", "episode", "p", F.explode("roles").alias("role"))
        .withColumn("episode", F.col("episode") - (F.col("role") == "next").cast("bigint"))
    )


def _newest(role: str, value: Column, extra: Column | None = None) -> Column:
    wanted = F.col("role") == role
    wanted = wanted if extra is None else wanted & extra
    return F.max_by(F.when(wanted, value), F.when(wanted, F.col("seq")))


def _instant(seconds: Column) -> Column:
    return F.timestamp_micros(F.round(seconds * 1e6).cast("bigint"))


def assemble(raw: DataFrame, span: int = SEGMENT_SPAN) -> DataFrame:
    """All episodes of all requests, with their outcome.

    Rows with an outcome in ``EMITTED`` are captures; the rest is for audits.
    """
    p = F.col("p")
    folded = (
        _roles(network_events(raw), span)
        .groupBy("page_id", "request_id", "episode")
        .agg(
            _newest("start", F.struct("seq", p["type"].alias("type"), p["timestamp"].alias("clock"),
                                      p["wallTime"].alias("wall"), p["initiator"].alias("initiator"),
                                      p["request"].alias("request"))).alias("st"),
            _newest("response", F.struct("seq", p["type"].alias("type"), p["timestamp"].alias("clock"),
                                         p["response"].alias("r"))).alias("re"),
            _newest("response", p["response"]["requestHeaders"],
                    p["response"]["requestHeaders"].isNotNull()).alias("sent_headers"),
            _newest("end", F.struct("seq", "method", p["encodedDataLength"].alias("bytes"))).alias("en"),
            _newest("next", F.struct("seq", p["redirectResponse"].alias("r"))).alias("nx"),
        )
    )
    return finish_episodes(folded)


def finish_episodes(folded: DataFrame, otherwise: Column | None = None) -> DataFrame:
    """Episodes with their outcome from what was folded of each request: start, response, end, next start.

    Where ``otherwise`` is not NULL it is the outcome.
    """
    re, en, nx = F.col("re"), F.col("en"), F.col("nx")
    outcome = (
        F.when(en["method"] == EV_FAILED, "failed")
        .when(en["method"] == EV_FINISHED, F.when(re.isNotNull(), "finished").otherwise("no_response"))
        .when(nx.isNull(), "open")
        .when(nx["r"].isNotNull(), "redirect")
        .otherwise("superseded")
    )
    if otherwise is not None:
        outcome = F.coalesce(otherwise, outcome)
    folded = folded.withColumn("outcome", outcome).withColumn(
        "r", F.when(F.col("outcome") == "redirect", nx["r"]).otherwise(re["r"])
    )
    st, r = F.col("st"), F.col("r")
    req = st["request"]
    responded = F.col("outcome").isin("finished", "redirect")
    clock = F.when(F.col("outcome") == "finished", st["wall"] + (re["clock"] - st["clock"])).otherwise(st["wall"])
    sent = F.coalesce(
        F.when(F.col("outcome") == "redirect", nx["r"]["requestHeaders"]),
        F.col("sent_headers"), req["headers"],
    )
    has_post = F.coalesce(req["hasPostData"], F.lit(False))
    return folded.select(
        "page_id", "request_id", "episode",
        st["seq"].alias("start_seq"),
        F.coalesce(en["seq"], nx["seq"]).alias("emit_seq"),
        req["url"].alias("url"),
        F.coalesce(F.nullif(re["type"], F.lit("")), st["type"]).alias("resource_type"),
        r["remoteIPAddress"].alias("remote_ip"),
        r["protocol"].alias("protocol"),
        F.struct(
            req["method"].alias("method"),
            H.unfold(sent).alias("headers"),
            F.when(has_post, F.encode(req["postData"], "UTF-8")).alias("body"),
            st["initiator"].alias("initiator"),
            has_post.alias("has_post_data"),
            _instant(st["wall"]).alias("ts"),
        ).alias("request"),
        F.when(
            responded,
            F.struct(
                r["status"].alias("status"),
                r["statusText"].alias("status_text"),
                H.unfold(r["headers"]).alias("headers"),
                r["mimeType"].alias("mime_type"),
                F.lit(None).cast("binary").alias("body"),
                F.lit(None).cast("boolean").alias("body_is_text"),
                F.when(F.col("outcome") == "finished", en["bytes"].cast("bigint"))
                .otherwise(F.lit(0).cast("bigint")).alias("bytes_received"),
                _instant(clock).alias("ts"),
            ),
        ).alias("response"),
        "outcome",
    )


def emitted(episodes: DataFrame) -> DataFrame:
    return episodes.filter(F.col("outcome").isin(*EMITTED))


def attach_bodies(captures: DataFrame, bodies: DataFrame) -> DataFrame:
    """Put fetched response bodies in place, as the last step so they are shuffled once.

    ``bodies``: one row per fetched body ``(page_id, request_id, emit_seq, body
    STRING, base64 BOOLEAN)``.  Only finished loads have one.
    """
    fetched = bodies.select(
        "page_id", "request_id", "emit_seq",
        X.body_bytes(F.col("body"), F.col("base64")).alias("__body"),
        (~F.col("base64")).alias("__text"),
    )
    keep = F.col("outcome") == "finished"
    return (
        captures.join(fetched, ["page_id", "request_id", "emit_seq"], "left")
        .withColumn(
            "response",
            F.when(keep, F.col("response")
                   .withField("body", F.col("__body"))
                   .withField("body_is_text", F.col("__text"))).otherwise(F.col("response")),
        )
        .drop("__body", "__text")
    )


def page_totals(captures: DataFrame, *keys: str) -> DataFrame:
    """Requests, finished, failed and received bytes of emitted captures."""
    keys = keys or ("page_id",)
    return emitted(captures).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("response").isNotNull()).alias("finished"),
        F.count_if(F.col("response").isNull()).alias("failed"),
        F.coalesce(F.sum("response.bytes_received"), F.lit(0)).alias("bytes_rcv"),
    )


def fingerprint() -> Column:
    """Digest of what two captures must share to be equal.

    Ids, times and received bytes depend on the network and stay out; header
    names compare without case, header order counts.
    """
    def plain(headers: Column) -> Column:
        return F.transform(headers, lambda h: F.concat_ws("\x1f", F.lower(h["name"]), h["value"]))

    rq, rs = F.col("request"), F.col("response")
    stable = F.struct(
        F.col("url"), F.col("remote_ip"), F.col("protocol"), F.col("resource_type"),
        rq["method"].alias("method"), rq["initiator"].alias("initiator"),
        plain(rq["headers"]).alias("rq_headers"), F.base64(rq["body"]).alias("rq_body"),
        rs.isNull().alias("no_response"), rs["status"].alias("status"),
        rs["status_text"].alias("status_text"), plain(rs["headers"]).alias("rs_headers"),
        rs["mime_type"].alias("mime"), F.base64(rs["body"]).alias("rs_body"),
    )
    return F.sha2(F.to_json(stable), 256)


def equal_groups(captures: DataFrame) -> DataFrame:
    """Sets of equal captures: first member and size.  Combined map-side, never listed."""
    first = F.min(F.struct("page_id", "start_seq"))
    return (
        captures.withColumn("fingerprint", fingerprint())
        .groupBy("fingerprint")
        .agg(first.alias("first"), F.count(F.lit(1)).alias("n_equal"))
        .select("fingerprint", F.col("first.page_id").alias("page_id"),
                F.col("first.start_seq").alias("start_seq"), "n_equal")
    )


def crawl_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Newest capture of every URL in two crawls: added, removed, changed or same."""
    def newest(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("url").agg(F.max_by(fingerprint(), F.struct("start_seq", "page_id")).alias(name))

    both = newest(before, "b").join(newest(after, "a"), "url", "full_outer")
    change = (
        F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed")
        .when(F.col("a") == F.col("b"), "same").otherwise("changed")
    )
    return both.select("url", change.alias("change"))


def correlate_log(log: DataFrame, records: DataFrame) -> DataFrame:
    """Log entries with the records of the request they talk about.

    Both sides share ``(file_seq, request_id)``; records are folded to one row
    per request first, so no entry-by-record pairs are built.
    """
    per_request = records.filter(F.col("request_id").isNotNull()).groupBy("file_seq", "request_id").agg(
        F.min_by("record_id", F.when(F.col("rec_type") == "request", F.col("record_seq"))).alias("request_record"),
        F.min_by("record_id", F.when(F.col("rec_type") == "response", F.col("record_seq"))).alias("response_record"),
        F.count_if(F.col("rec_type") == "request").alias("n_requests"),
        F.count_if(F.col("rec_type") == "response").alias("n_responses"),
    )
    return lookup_join(log, per_request, ["file_seq", "request_id"], salt_by=["seq"])
