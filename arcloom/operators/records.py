"""Archive records: the record schema, builders from capture items, and links."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcloom.fixed_values import HTML_MIME, JSON_MIME, PNG_MIME, SCRIPT_MIME
from arcloom.functions import headers as H
from arcloom.functions import text as X
from arcloom.functions.urls import request_target
from arcloom.operators.capture import emitted
from arcloom.operators.skew import lookup_join, ordered_scan
from arcloom.schema import NAMES, ORDER, RECORD_COLUMNS, HeaderNames
from arcloom.session import cut_lineage, scratch_path, scratch_scope


def as_records(df: DataFrame, names: HeaderNames = NAMES, extra: Column | None = None,
               unless: Column | None = None, keep: Sequence[str] = (), **columns: Column) -> DataFrame:
    """Project to the record schema; columns that are not given become NULL, those in ``keep`` follow it.

    The header list is rendered from the typed columns plus ``extra``, in one
    fixed order, so every sink writes the same bytes for the same record.  Rows
    for which ``unless`` holds already are records and pass unchanged.
    """
    same = [] if unless is None else [F.when(unless, F.struct(*RECORD_COLUMNS)).alias("__same")]
    given = df.select(
        *[columns.get(name, F.lit(None)).cast(kind).alias(name)
          for name, kind in RECORD_COLUMNS.items() if name != "headers"],
        (extra if extra is not None else H.no_headers()).alias("__extra"),
        *same, *keep,
    )
    return render_headers(given, names, keep)


def render_headers(df: DataFrame, names: HeaderNames = NAMES, keep: Sequence[str] = ()) -> DataFrame:
    """Fill ``content_length``, ``payload_digest`` and ``headers`` from the typed columns."""
    http = F.when(
        F.col("http_start_line").isNotNull(),
        F.octet_length(H.block(F.col("http_start_line"), F.coalesce("http_headers", H.no_headers()))),
    ).otherwise(0)
    length = (http + F.coalesce(F.octet_length("payload"), F.lit(0))).cast("bigint")
    df = df.withColumn("content_length", length)
    h, c = H.header, F.col
    rendered = H.present(
        h("WARC-Type", c("rec_type")),
        h("WARC-Record-ID", c("record_id")),
        h("WARC-Target-URI", F.nullif("target_uri", F.lit(""))),
        h("WARC-Date", X.iso_date(c("warc_date"))),
        h("WARC-IP-Address", c("ip")),
        h("WARC-Payload-Digest", c("payload_digest")),
        h("WARC-Refers-To-Target-URI", c("refers_to_uri")),
        h("WARC-Refers-To-Date", X.iso_date(c("refers_to_date"))),
        h("WARC-Refers-To", c("refers_to")),
        h("WARC-Concurrent-To", c("concurrent_to")),
        h("WARC-Warcinfo-ID", c("warcinfo_id")),
        h("WARC-Truncated", c("truncated")),
        h(names.request_id, c("request_id")),
        h(names.sub_type, c("sub_type")),
    )
    tail = H.present(
        h("Content-Type", c("content_type")),
        h("Content-Length", c("content_length").cast("string")),
    )
    extra = F.col("__extra") if "__extra" in df.columns else H.no_headers()
    out = df.withColumn("headers", F.concat(rendered, extra, tail))
    if "__same" not in df.columns:
        return out.select(*RECORD_COLUMNS, *keep)
    same = F.col("__same")
    return out.select(*[
        F.when(same.isNotNull(), same[n]).otherwise(F.col(n)).alias(n) for n in RECORD_COLUMNS
    ], *keep)


def _capture_id(kind: str) -> Column:
    return X.urn_uuid(F.lit(kind), F.col("page_id").cast("string"), F.col("request_id"),
                      F.col("episode").cast("string"))


def _request_columns() -> dict[str, Column]:
    rq = F.col("request")
    lost = rq["has_post_data"] & rq["body"].isNull()
    return dict(
        record_seq=F.col("emit_seq") * 2,
        record_id=_capture_id("request"),
        rec_type=F.lit("request"),
        warc_date=rq["ts"],
        content_type=F.lit("application/http; msgtype=request"),
        truncated=F.when(lost, F.lit("unspecified")),
        http_start_line=F.concat(rq["method"], F.lit(" "), request_target("url"), F.lit(" HTTP/1.1")),
        http_headers=rq["headers"],
        payload=F.coalesce(rq["body"], F.lit(b"")),
    )


def _response_columns() -> dict[str, Column]:
    rs = F.col("response")
    return dict(
        record_seq=F.col("emit_seq") * 2 + 1,
        record_id=_capture_id("response"),
        rec_type=F.lit("response"),
        warc_date=rs["ts"],
        content_type=F.lit("application/http; msgtype=response"),
        concurrent_to=_capture_id("request"),
        ip=F.nullif("remote_ip", F.lit("")),
        truncated=F.when(rs["body"].isNull(), F.lit("unspecified")),
        http_start_line=F.concat_ws(" ", F.lit("HTTP/1.1"), rs["status"].cast("string"),
                                    H.status_text(rs["status"], rs["status_text"])),
        http_headers=H.response_headers(rs["headers"], rs["mime_type"], rs["body"], rs["body_is_text"]),
        payload=F.coalesce(rs["body"], F.lit(b"")),
    )


def _of_capture(columns: dict[str, Column]) -> dict[str, Column]:
    return dict(
        columns, file_path=F.col("page_id").cast("string"), file_seq=F.col("page_id"), target_uri=F.col("url"),
        request_id=F.col("request_id"), payload_digest=X.base32_sha1(columns["payload"]),
    )


def request_records(captures: DataFrame, names: HeaderNames = NAMES) -> DataFrame:
    """One ``request`` record per emitted capture."""
    return as_records(emitted(captures), names, **_of_capture(_request_columns()))


def response_records(captures: DataFrame, names: HeaderNames = NAMES) -> DataFrame:
    """One ``response`` record per capture that has a response, tied to its request record."""
    answered = emitted(captures).filter(F.col("response").isNotNull())
    return as_records(answered, names, **_of_capture(_response_columns()))


def capture_records(captures: DataFrame, names: HeaderNames = NAMES) -> DataFrame:
    """Both records of every emitted capture, from one pass over the captures."""
    kinds = F.when(F.col("response").isNull(), F.array(F.lit("request"))).otherwise(
        F.array(F.lit("request"), F.lit("response")))
    rows = emitted(captures).withColumn("__kind", F.explode(kinds))
    rq, rs = _request_columns(), _response_columns()
    either = {
        n: F.when(F.col("__kind") == "request", rq.get(n, F.lit(None))).otherwise(rs[n]) for n in rs
    }
    return as_records(rows, names, **_of_capture(either))


def _item(**more: Column) -> dict[str, Column]:
    base = {c: F.col(c) for c in ("file_path", "file_seq", "record_seq", "warc_date")}
    return {**base, **more}


def _item_id(kind: str) -> Column:
    return X.urn_uuid(F.lit(kind), F.col("file_path"), F.col("record_seq").cast("string"))


def script_records(items: DataFrame, names: HeaderNames = NAMES) -> DataFrame:
    """Injected scripts ``(…order, path, data)`` -> ``resource`` records."""
    payload = F.encode("data", "UTF-8")
    return as_records(items, names, **_item(
        record_id=_item_id("script"), rec_type=F.lit("resource"),
        target_uri=F.concat(F.lit("file://"), F.col("path")),
        content_type=F.lit(f"{SCRIPT_MIME}; charset=utf-8"), sub_type=F.lit("script"),
        payload_digest=X.base32_sha1(payload), payload=payload,
    ))


def snapshot_records(items: DataFrame, names: HeaderNames = NAMES) -> DataFrame:
    """Static snapshots ``(…order, url, document BINARY, viewport)`` -> ``conversion`` records."""
    return as_records(
        items, names, H.present(H.header(names.viewport, F.col("viewport"))), **_item(
            record_id=_item_id("snapshot"), rec_type=F.lit("conversion"), target_uri=F.col("url"),
            content_type=F.lit(f"{HTML_MIME}; charset=utf-8"), sub_type=F.lit("dom-snapshot"),
            payload_digest=X.base32_sha1(F.col("document")), payload=F.col("document"),
        ))


def screenshot_records(items: DataFrame, names: HeaderNames = NAMES) -> DataFrame:
    """Screenshots ``(…order, url, yoff, data BINARY)`` -> ``conversion`` records."""
    return as_records(
        items, names, H.present(H.header(names.y_offset, F.col("yoff").cast("string"))), **_item(
            record_id=_item_id("screenshot"), rec_type=F.lit("conversion"), target_uri=F.col("url"),
            content_type=F.lit(PNG_MIME), sub_type=F.lit("screenshot"),
            payload_digest=X.base32_sha1(F.col("data")), payload=F.col("data"),
        ))


def warcinfo_records(items: DataFrame, names: HeaderNames = NAMES) -> DataFrame:
    """Capture starts ``(…order, payload STRING with JSON)`` -> ``warcinfo`` records."""
    payload = F.encode("payload", "UTF-8")
    return as_records(items, names, **_item(
        record_id=_item_id("warcinfo"), rec_type=F.lit("warcinfo"),
        content_type=F.lit(f"{JSON_MIME}; charset=utf-8"),
        payload_digest=X.base32_sha1(payload), payload=payload,
    ))


def log_records(batches: DataFrame, names: HeaderNames = NAMES) -> DataFrame:
    """Log batches ``(…order, body STRING of JSON lines)`` -> ``metadata`` records."""
    payload = F.encode("body", "UTF-8")
    return as_records(batches, names, **_item(
        record_id=_item_id("log"), rec_type=F.lit("metadata"), sub_type=F.lit("log"),
        content_type=F.lit(f"{JSON_MIME}; charset=utf-8"),
        payload_digest=X.base32_sha1(payload), payload=payload,
    ))


# item type -> builder; extend a copy to route your own items
BUILDERS: Mapping[str, Callable[[DataFrame], DataFrame]] = {
    "capture": capture_records,
    "script": script_records,
    "dom-snapshot": snapshot_records,
    "screenshot": screenshot_records,
    "warcinfo": warcinfo_records,
    "log": log_records,
}


def build_records(items: Mapping[str, DataFrame],
                  builders: Mapping[str, Callable[[DataFrame], DataFrame]] = BUILDERS) -> DataFrame:
    """Union of the records of all item types; item types without a builder are skipped."""
    out = None
    for kind, df in items.items():
        if kind in builders:
            built = builders[kind](df)
            out = built if out is None else out.unionByName(built, allowMissingColumns=True)
    if out is None:
        raise ValueError("no item type has a builder")
    return out


# --- links between records ------------------------------------------------------


def asof_warcinfo(records: DataFrame, span: int | None = None) -> DataFrame:
    """Per record the id of the last ``warcinfo`` before it in its file.

    Narrow in and out: only ids and order columns are shuffled.
    """
    narrow = records.select(*ORDER, "record_id", "rec_type")
    return ordered_scan(
        narrow, ["file_seq"], "record_seq",
        previous={"warcinfo_id": F.when(F.col("rec_type") == "warcinfo", F.col("record_id"))}, span=span,
    )


def asof_document(items: DataFrame, is_document: Column, wants: Column, span: int | None = None) -> DataFrame:
    """Per conversion the newest earlier document response of the same URL in its file.

    Unmatched ones stay, with a NULL ``refers_to``.
    """
    narrow = items.filter(is_document | wants).select(
        *ORDER, "target_uri", "record_id", is_document.alias("__doc"), wants.alias("__wants")
    )
    scanned = ordered_scan(
        narrow, ["file_seq", "target_uri"], "record_seq",
        previous={"refers_to": F.when(F.col("__doc"), F.col("record_id"))}, span=span,
    )
    return scanned.filter("__wants").drop("__doc", "__wants")


def with_links(records: DataFrame, links: DataFrame, column: str, names: HeaderNames = NAMES) -> DataFrame:
    """Write a link column found by an as-of scan into the records and their headers."""
    found = links.select(*ORDER, F.col(column).alias("__link"))
    joined = records.join(found, list(ORDER), "left")
    custom = F.filter("headers", lambda h: ~F.lower(h["name"]).startswith("warc-")
                      & ~F.lower(h["name"]).isin("content-type", "content-length",
                                                 names.request_id.lower(), names.sub_type.lower()))
    return render_headers(
        joined.withColumn(column, F.coalesce("__link", column)).withColumn("__extra", custom).drop("__link"),
        names,
    )


def pair_responses(records: DataFrame) -> DataFrame:
    """Each response with the request it was concurrent to.

    An id that repeats, as after merging an archive with itself, stands for its
    first request in input order: every response comes out once.
    """
    first = F.min_by(F.struct("http_start_line", "warc_date"), F.struct(*ORDER)).alias("__first")
    requests = records.filter("rec_type = 'request' AND record_id IS NOT NULL").groupBy(
        F.col("record_id").alias("concurrent_to")).agg(first).select(
        "concurrent_to", F.col("__first.http_start_line").alias("request_line"), F.col("__first.warc_date").alias("request_date"))
    responses = records.filter("rec_type = 'response'")
    return lookup_join(responses, requests, ["concurrent_to"], ["record_id"], hot=False)


LINK_COLUMNS = ("warcinfo_id", "concurrent_to", "refers_to")


def dangling_links(records: DataFrame, columns: tuple[str, ...] = LINK_COLUMNS) -> DataFrame:
    """Link targets that no record has: ``(link, target, n_records)``.

    References are counted per target map-side before they meet the record
    ids, so a target that a third of all records point at is one row here.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("link"), F.col(c).alias("target")) for c in columns])
    wanted = (
        records.select(F.explode(pairs).alias("x"))
        .select("x.link", "x.target")
        .filter("target is not null")
        .groupBy("link", "target")
        .agg(F.count(F.lit(1)).alias("n_records"))
    )
    return wanted.join(records.select(F.col("record_id").alias("target")), "target", "left_anti")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """The record each revisit finally stands for: ``(record_id, resolved_id)``.

    Merging merged archives makes revisits of revisits.  Every round replaces
    a target that is itself a revisit by that one's target, so chains halve
    and ever fewer rows move; when their number stays, only circles are left,
    which come out with a NULL ``resolved_id``.  Every revisit comes out once;
    an id that repeats stands for its first revisit in input order.
    """
    path = scratch_path(records.sparkSession, "resolved")
    with scratch_scope():  # the rounds go, the result stays
        _resolved(records).write.parquet(path)
    return records.sparkSession.read.schema("record_id STRING, resolved_id STRING").parquet(path)


def _resolved(records: DataFrame) -> DataFrame:
    moving = None
    links = cut_lineage(
        records.filter("rec_type = 'revisit'").select(*ORDER, "record_id", F.col("refers_to").alias("resolved_id")), "revisits")
    while True:
        step = links.filter("record_id IS NOT NULL").groupBy(F.col("record_id").alias("resolved_id")).agg(
            F.min_by("resolved_id", F.struct(*ORDER)).alias("__next"))
        jumped = lookup_join(links, step, ["resolved_id"], ["record_id"]).select(
            *ORDER, "record_id", F.coalesce("__next", "resolved_id").alias("resolved_id"), F.col("__next").isNotNull().alias("moved"))
        links = cut_lineage(jumped, "revisits")
        before, moving = moving, links.filter("moved").count()
        if moving in (0, before):
            break
    return links.select("record_id", F.when(~F.col("moved"), F.col("resolved_id")).alias("resolved_id"))
