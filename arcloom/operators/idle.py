"""When is a page idle, and when should its capture stop?"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcloom.operators.skew import SEGMENT_SPAN, ordered_scan


def _effective(frames: DataFrame, span: int) -> DataFrame:
    """Frame events that change what is loading; ``delta`` is +1 or -1.

    Frames are a set: starting twice counts once, and a stop of a frame that is
    not loading is ignored.
    """
    started = F.col("kind") == "started"
    known = ordered_scan(frames, ["page_id", "frame_id"], "seq", previous={"was_loading": started}, span=span)
    loading = F.coalesce("was_loading", F.lit(False))
    delta = F.when(started & ~loading, 1).when(~started & loading, -1).otherwise(0)
    return known.select("page_id", "seq", "ts", delta.cast("bigint").alias("delta"), "kind")


def unmatched_stops(frames: DataFrame, span: int = SEGMENT_SPAN) -> DataFrame:
    """Number of ignored stops per page."""
    return (
        _effective(frames, span)
        .groupBy("page_id")
        .agg(F.count_if((F.col("kind") == "stopped") & (F.col("delta") == 0)).alias("unmatched"))
    )


def page_starts(frames: DataFrame) -> DataFrame:
    return frames.groupBy("page_id").agg(F.min("ts").alias("start_ts"))


def idle_intervals(frames: DataFrame, starts: DataFrame | None = None, span: int = SEGMENT_SPAN) -> DataFrame:
    """Maximal spans without a loading frame; the last may be open (``idle_until`` NULL).

    With ``starts`` (``page_id, start_ts``) the span from the page start to the
    first load is included as ``idle_no`` 0: a page is idle before it loads.

    The n-th change that ends a load and change n+1, which starts the next one,
    meet in a group of two, so no ``lead`` over a page is needed.
    """
    changes = ordered_scan(
        _effective(frames, span).filter("delta <> 0"), ["page_id"], "seq",
        sums={"loading": F.col("delta"), "nth": F.lit(1)}, span=span,
    )
    falls = F.col("loading") == 0
    rises = (F.col("loading") == 1) & (F.col("delta") == 1)
    ends = changes.filter(falls | rises).select(
        "page_id",
        F.when(falls, F.col("nth") + 1).otherwise(F.col("nth")).alias("change"),
        F.when(falls, F.col("ts")).alias("idle_from"),
        F.when(rises, F.col("ts")).alias("idle_until"),
    )
    if starts is not None:
        ends = ends.unionByName(
            starts.select("page_id", F.lit(1).cast("bigint").alias("change"), F.col("start_ts").alias("idle_from")),
            allowMissingColumns=True,
        )
    return (
        ends.groupBy("page_id", "change")
        .agg(F.max("idle_from").alias("idle_from"), F.max("idle_until").alias("idle_until"))
        .filter("idle_from is not null")
        .withColumn("change", F.col("change") - 1)
        .withColumnRenamed("change", "after_change")
    )


def stop_times(frames: DataFrame, idle_timeout: float, timeout: float,
               starts: DataFrame | None = None, span: int = SEGMENT_SPAN) -> DataFrame:
    """When each page's capture ends and why: idle long enough, else the global timeout."""
    starts = page_starts(frames) if starts is None else starts
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    spans = idle_intervals(frames, starts, span)
    long_enough = F.col("idle_until").isNull() | (
        us("idle_until") - us("idle_from") >= int(idle_timeout * 1_000_000)
    )
    first = spans.filter(long_enough).groupBy("page_id").agg(
        (F.min(us("idle_from")) + int(idle_timeout * 1_000_000)).alias("idle_stop")
    )
    deadline = us("start_ts") + int(timeout * 1_000_000)
    by_idle = F.coalesce(F.col("idle_stop") <= deadline, F.lit(False))
    return starts.join(first, "page_id", "left").select(
        "page_id",
        F.when(by_idle, "idle").otherwise("timeout").alias("reason"),
        F.timestamp_micros(F.when(by_idle, F.col("idle_stop")).otherwise(deadline)).alias("stop_ts"),
        (F.when(by_idle, F.col("idle_stop")).otherwise(deadline) - us("start_ts")).alias("after_us"),
    )


def activity_sessions(events: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """Request-gap view of idleness: bursts of events at most a gap apart.

    Events in one time slot as wide as the gap belong together, so slots are
    folded first, map-side.  What is left per key is one row per slot, however
    many events there were; those are chained across slot borders.
    """
    us, width = F.unix_micros(ts), F.lit(gap_seconds * 1_000_000)
    slots = events.groupBy(key, (us - F.pmod(us, width)).alias("slot")).agg(
        F.min(us).alias("first"), F.max(us).alias("last"), F.count(F.lit(1)).alias("n"))
    by_key = Window.partitionBy(key).orderBy("slot")
    starts_new = F.coalesce(F.col("first") - F.lag("last").over(by_key) > gap_seconds * 1_000_000, F.lit(True))
    return (
        slots.withColumn("new", starts_new.cast("int"))
        .withColumn("session", F.sum("new").over(by_key))
        .groupBy(key, "session")
        .agg(F.timestamp_micros(F.min("first")).alias("session_start"),
             F.timestamp_micros(F.max("last") + gap_seconds * 1_000_000).alias("session_end"),
             F.sum("n").alias("n_events"))
        .drop("session")
    )


def activity_session_stream(events: DataFrame, key: str, ts: str, gap: str, delay: str) -> DataFrame:
    """The same on a stream: a session is given out once the watermark has passed its end."""
    return (
        events.withWatermark(ts, delay)
        .groupBy(key, F.session_window(ts, gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n_events"))
        .select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")
    )
