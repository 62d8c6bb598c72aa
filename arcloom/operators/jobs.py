"""Folding bot logs into the state of every job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcloom.fixed_values import (
    MSG_ABORTED,
    MSG_FINISHED,
    MSG_FORWARDED,
    MSG_QUEUED,
    MSG_RECURSION,
    MSG_STARTED,
    MSG_STATS,
)
from arcloom.functions.text import pretty_bytes
from arcloom.operators.crawl_log import entries, field

STATUS_OF = {MSG_QUEUED: "pending", MSG_STARTED: "running", MSG_FINISHED: "finished", MSG_ABORTED: "aborted"}
CRAWL_KEYS = ("requests", "finished", "failed", "bytesRcv", "crashed", "ignored")
RECURSION_KEYS = ("pending", "have", "running")
UNKNOWN_USER, UNKNOWN_URL = "<unknown>", "unknown"


def job_events(parsed: DataFrame, order: str = "seq") -> DataFrame:
    """Typed job messages; everything the folds below need and nothing else."""
    status = F.lit(None).cast("string")
    for uuid, name in STATUS_OF.items():
        status = F.when(F.col("uuid") == uuid, F.lit(name)).otherwise(status)
    nested = F.when(F.col("uuid") == MSG_FORWARDED, field("data.uuid"))
    # log dates carry an explicit zone, so they may be compared as instants
    return entries(parsed).filter("job is not null").select(
        "job", F.col(order).alias("seq"), "date", status.alias("status"), nested.alias("nested"),
        F.when(F.col("uuid") == MSG_QUEUED, field("url")).alias("url"),
        F.when(F.col("uuid") == MSG_QUEUED, field("user")).alias("user"),
        *[F.when(nested.isin(MSG_STATS, MSG_RECURSION), field(f"data.{k}", "bigint")).alias(k)
          for k in CRAWL_KEYS + RECURSION_KEYS],
    )


def _last(value: Column, where: Column) -> Column:
    return F.max_by(F.when(where, value), F.when(where, F.col("seq")))


def _life(abort_is_final: bool) -> list[Column]:
    latest = _last(F.col("status"), F.col("status").isNotNull())
    if abort_is_final:
        latest = F.when(F.count_if(F.col("status") == "aborted") > 0, F.lit("aborted")).otherwise(latest)
    times = [
        F.min(F.when(F.col("status") == s, F.col("date"))).alias(name)
        for s, name in (("pending", "queued_at"), ("running", "started_at"),
                        ("finished", "finished_at"), ("aborted", "aborted_at"))
    ]
    return [
        F.coalesce(latest, F.lit("undefined")).alias("status"),
        F.coalesce(_last(F.col("url"), F.col("url").isNotNull()), F.lit(UNKNOWN_URL)).alias("url"),
        F.coalesce(_last(F.col("user"), F.col("user").isNotNull()), F.lit(UNKNOWN_USER)).alias("user"),
        *times,
    ]


def state_latest(events: DataFrame, abort_is_final: bool = True) -> DataFrame:
    """One row per job; a stats message replaces the one before, key by key absent = 0.

    A job nobody queued still gets a row, with placeholders.  Only aggregates
    that combine map-side are used, so the same fold runs on a stream.
    """
    def newest(message: str, keys: tuple[str, ...]) -> Column:
        return _last(F.struct(*keys), F.col("nested") == message)

    folded = events.groupBy("job").agg(
        *_life(abort_is_final), newest(MSG_STATS, CRAWL_KEYS).alias("s"), newest(MSG_RECURSION, RECURSION_KEYS).alias("r")
    )
    return folded.select(
        *[c for c in folded.columns if c not in ("s", "r")],
        *[F.coalesce(f"s.{k}", F.lit(0)).alias(k) for k in CRAWL_KEYS],
        *[F.coalesce(f"r.{k}", F.lit(0)).alias(k) for k in RECURSION_KEYS],
    )


def state_merge(events: DataFrame, abort_is_final: bool = True) -> DataFrame:
    """One row per job; stats and recursion messages update key by key."""
    return events.groupBy("job").agg(
        *_life(abort_is_final),
        *[F.coalesce(_last(F.col(k), F.col(k).isNotNull()), F.lit(0)).alias(k) for k in CRAWL_KEYS + RECURSION_KEYS],
    )


def report_line(state: DataFrame) -> DataFrame:
    """``(job, report)`` as told to the user who asks for a job's status."""
    return state.select("job", F.format_string(
        "Job %s is %s: pages done %d, waiting %d, crashed %d; requests %d, failed %d; %s from %s",
        "job", "status", "have", "pending", "crashed", "requests", "failed", pretty_bytes(F.col("bytesRcv")), "url",
    ).alias("report"))


def fleet(state: DataFrame) -> DataFrame:
    """Jobs per shown status and bytes transferred; finished and aborted are shown as one."""
    shown = F.when(F.col("status").isin("finished", "aborted"), "finished").otherwise(F.col("status"))
    return state.groupBy(shown.alias("shown_status")).agg(
        F.count(F.lit(1)).alias("n_jobs"), F.sum("bytesRcv").alias("bytes_rcv"))


def with_job(messages: DataFrame, jobs: DataFrame) -> DataFrame:
    """Messages with their job's url and user; placeholders for unknown jobs."""
    from arcloom.operators.skew import lookup_join

    known = jobs.select("job", F.col("url").alias("job_url"), F.col("user").alias("job_user"))
    return lookup_join(messages, known, ["job"], ["seq"]).withColumns({
        "job_url": F.coalesce("job_url", F.lit(UNKNOWN_URL)),
        "job_user": F.coalesce("job_user", F.lit(UNKNOWN_USER)),
    })
