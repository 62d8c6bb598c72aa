"""Crawl logs: tolerant scan, routing, redaction, batching, totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcloom.fixed_values import (
    CRAWL_CONTEXT,
    EXIT_NAMES,
    FEED_IGNORED_MESSAGES,
    FEED_TAIL,
    MSG_EXIT,
    MSG_FETCH,
    MSG_FORWARDED,
    MSG_LINKS,
    MSG_QUEUED,
    MSG_SCHEME_IGNORED,
    MSG_STATS,
    PAGE_CONTEXT,
    URLS_PER_JOB,
)
from arcloom.functions.text import once


def field(path: str, type_: str = "string") -> Column:
    """A field of the parsed entry ``v``, NULL when absent or of another kind."""
    return F.try_variant_get("v", f"$.{path}", type_)


def parse(lines: DataFrame, line: str = "line") -> DataFrame:
    """Add ``v`` (VARIANT) and the common fields; broken lines get a NULL ``v``.

    An entry is a JSON object; anything else counts as broken.
    """
    variant = F.try_parse_json(F.when(F.ltrim(line).startswith("{"), F.col(line)))
    parsed = lines.select("*", once(variant).alias("v"))
    return parsed.select(
        "*",
        field("date", "timestamp").alias("date"),
        field("level", "int").alias("level"),
        field("uuid").alias("uuid"),
        field("msg").alias("msg"),
        field("context").alias("context"),
        field("job").alias("job"),
    )


def entries(parsed: DataFrame) -> DataFrame:
    return parsed.filter("v is not null")


def corrupt(parsed: DataFrame, line: str = "line") -> DataFrame:
    """Side output: lines that are no entries."""
    keep = [c for c in parsed.columns if c not in ("v", "date", "level", "uuid", "msg", "context", "job")]
    return parsed.filter("v is null").select(*keep)


def log_lines_of_records(records: DataFrame) -> DataFrame:
    """Lines kept inside archives: ``(file_seq, record_seq, line_seq, line)``."""
    text = F.decode("payload", "UTF-8")
    return (
        records.filter("rec_type = 'metadata' and sub_type = 'log'")
        .select("file_seq", "record_seq", F.posexplode(F.split(text, "\n")).alias("line_seq", "line"))
        .filter("line <> ''")
    )


def at_least(level: int) -> Column:
    return F.col("level") >= level


def only_messages(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    return df.filter(F.col("uuid").isin(*ids))


def without_messages(df: DataFrame, ids: Sequence[str] = FEED_IGNORED_MESSAGES) -> DataFrame:
    return df.filter(F.coalesce(~F.col("uuid").isin(*ids), F.lit(True)))


def bind(df: DataFrame, **values: Column) -> DataFrame:
    """Context columns for entries that do not say otherwise themselves."""
    return df.withColumns({
        name: F.coalesce(F.col(name), value) if name in df.columns else value for name, value in values.items()
    })


def unbind(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def transform_chain(df: DataFrame, *consumers) -> DataFrame:
    """Pass entries through consumers, each getting what the one before returns."""
    for consume in consumers:
        df = df.transform(consume)
    return df


def redacted(line: str = "line") -> Column:
    """The entry's JSON without what must not leave the house.

    Queue messages lose their command line, forwarded fetch messages the
    command in their nested data; all others pass as they are.
    """
    top = F.from_json(F.col(line), "MAP<STRING, VARIANT>")
    nested = F.from_json(F.to_json(F.try_element_at(top, F.lit("data"))), "MAP<STRING, VARIANT>")
    no_cmdline = F.to_json(F.map_filter(top, lambda k, _: k != "cmdline"))
    cleaned = F.to_json(F.map_filter(nested, lambda k, _: k != "command"))
    no_command = F.to_json(F.map_from_entries(F.transform(
        F.map_entries(top),
        lambda e: F.struct(e["key"], F.when(e["key"] == "data", F.parse_json(cleaned)).otherwise(e["value"])))))
    return (
        F.when(F.col("uuid") == MSG_QUEUED, no_cmdline)
        .when((F.col("uuid") == MSG_FORWARDED) & (field("data.uuid") == MSG_FETCH), no_command)
        .otherwise(F.col(line))
    )


def feed(parsed: DataFrame, line: str = "line") -> DataFrame:
    """What subscribers see: noise dropped, secrets removed."""
    return without_messages(entries(parsed)).withColumn(line, redacted(line))


def tail(df: DataFrame, order: str = "seq", n: int = FEED_TAIL) -> DataFrame:
    """Newest ``n`` entries: a top-n per task and a merge of those."""
    return df.orderBy(F.desc(order)).limit(n)


def fetched_urls(parsed: DataFrame, order: str = "seq", n: int = URLS_PER_JOB) -> DataFrame:
    """Newest ``n`` fetched URLs of every job.

    The rank limit is applied in every map task before the shuffle, so a job
    that owns a third of the log sends ``n`` rows per task, not all.
    """
    fetched = entries(parsed).filter(
        (F.col("uuid") == MSG_FORWARDED) & (field("data.uuid") == MSG_FETCH)
    ).select("job", order, field("data.url").alias("url"))
    newest = Window.partitionBy("job").orderBy(F.desc(order))
    return fetched.withColumn("nth", F.row_number().over(newest)).filter(F.col("nth") <= n)


def extracted_links(parsed: DataFrame, *keep: str) -> DataFrame:
    """Links of link messages, one row each, next to the ``keep`` columns."""
    links = F.from_json(F.to_json(F.try_variant_get("v", "$.links", "variant")), "ARRAY<STRING>")
    return only_messages(entries(parsed), [MSG_LINKS]).select(*keep, F.explode(links).alias("link"))


# --- totals ---------------------------------------------------------------------

PAGE_STATS = {"requests": "requests", "finished": "finished", "failed": "failed", "bytes_rcv": "bytesRcv"}
CRAWL_STATS = {**PAGE_STATS, "crashed": "crashed", "ignored": "ignored"}


def crawl_totals(parsed: DataFrame, *keys: str) -> DataFrame:
    """Sum of page-level stats, crashed pages and ignored URLs per ``keys``.

    Cumulative stats carry the same message id; they are told apart by their
    context and never summed.
    """
    e = entries(parsed)
    page = (F.col("uuid") == MSG_STATS) & (F.col("context") == PAGE_CONTEXT)
    sums = [
        F.coalesce(F.sum(F.when(page, F.coalesce(field(src, "bigint"), F.lit(0)))), F.lit(0)).alias(dst)
        for dst, src in PAGE_STATS.items()
    ]
    crashed = (F.col("uuid") == MSG_EXIT) & (field("status", "int") != 0)
    ignored = F.col("uuid") == MSG_SCHEME_IGNORED
    return e.groupBy(*keys).agg(
        *sums, F.count_if(crashed).alias("crashed"), F.count_if(ignored).alias("ignored"))


def latest_totals(parsed: DataFrame, *keys: str, order: str = "seq") -> DataFrame:
    """Last cumulative stats message per ``keys``."""
    stats = F.struct(*[F.coalesce(field(src, "bigint"), F.lit(0)).alias(dst) for dst, src in CRAWL_STATS.items()])
    cumulative = only_messages(entries(parsed), [MSG_STATS]).filter(F.col("context") == CRAWL_CONTEXT)
    return cumulative.groupBy(*keys).agg(F.max_by(stats, order).alias("s")).select(*keys, "s.*")


def exit_codes(parsed: DataFrame, *keys: str) -> DataFrame:
    status = field("status", "int")
    name = F.coalesce(F.get(F.array(*[F.lit(n) for n in EXIT_NAMES]), status), F.lit("unknown"))
    return (
        only_messages(entries(parsed), [MSG_EXIT])
        .select(*keys, status.alias("status"), name.alias("meaning"))
        .groupBy(*keys, "status", "meaning")
        .agg(F.count(F.lit(1)).alias("n_pages"))
    )
