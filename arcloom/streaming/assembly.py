"""Captures from a stream whose events arrive out of order, with state for requests.

What is kept of a request: events that may still be preceded by others, and the
open item.  Requests are dealt by hash to buckets that share a state and a
timer, since every access to a state costs as much as many events: its number
grows with the buckets, not with the requests.  Events wait until the watermark has
passed them and are then taken in the order of their event time, so captures do
not depend on how events were dealt to micro-batches.  Timers of event time
drive this, also for requests no further event comes for: an item still open
``timeout`` after its start is closed as ``expired``.  What is kept is bounded
by the watermark's delay and the timeout.

The state machine sees order, time and kind only.  Parameters pass through as
they came and are read by expressions afterwards, as in the batch assembly.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from arcloom.fixed_values import EV_FAILED, EV_FINISHED, EV_REQUEST, EV_RESPONSE
from arcloom.operators import capture
from arcloom.sources.events import params

BUCKETS = 1024
# a row for the events of a micro-batch
_EVENTS = ("page ARRAY<STRING>, request ARRAY<STRING>, seq ARRAY<BIGINT>, us ARRAY<BIGINT>, method ARRAY<STRING>,"
           " params ARRAY<STRING>, sends ARRAY<BOOLEAN>")
_OPEN = "page STRING, request STRING, seq BIGINT, us BIGINT, start STRING, re_seq BIGINT, re STRING, sent STRING"
CLOSED_SCHEMA = (
    "page_id BIGINT, request_id STRING, start_seq BIGINT, start STRING, re_seq BIGINT, re STRING, sent STRING,"
    " end_seq BIGINT, end_method STRING, end STRING, next_seq BIGINT, next STRING, expired BOOLEAN"
)
_COLUMNS = [c.split()[0] for c in CLOSED_SCHEMA.split(", ")]


def _due(us: int) -> int:
    """The first millisecond at which a watermark has passed a time."""
    return -(-us // 1000)


class _RequestAssembler(StatefulProcessor):
    """The requests of a bucket."""

    def __init__(self, timeout_us: int) -> None:
        self.timeout_us = timeout_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _EVENTS)
        self.open = handle.getListState("open", _OPEN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        soonest = None
        for pdf in rows:
            us = [int(u) for u in pdf["us"]]
            self.waiting.appendValue((
                pdf["page"].tolist(), pdf["request_id"].tolist(), [int(s) for s in pdf["seq"]], us,
                pdf["method"].tolist(), pdf["params"].tolist(), [bool(x) for x in pdf["sends"]]))
            soonest = min(us) if soonest is None else min(soonest, *us)
        self._wake(_due(soonest))
        return iter(())

    def _wake(self, ms: int) -> None:
        """A bucket has one timer: the earliest."""
        timers = list(self.handle.listTimers())
        if not timers or ms < min(timers):
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        events = [e for part in (self.waiting.get() if self.waiting.exists() else ()) for e in zip(*part)]
        due = sorted((e for e in events if e[3] <= now), key=lambda e: (e[3], e[2]))
        items = {item[:2]: tuple(item[2:]) for item in (self.open.get() if self.open.exists() else ())}
        closed: list[tuple] = []

        def close(request, end=(None, None, None), after=(None, None), expired=False) -> None:
            seq, _, start, re_seq, re, sent = items.pop(request)
            page = None if request[0] is None else int(request[0])
            closed.append((page, request[1], seq, start, re_seq, re, sent, *end, *after, expired))

        for page, name, seq, us, method, text, sends in due:
            request = (page, name)
            if request in items and us > items[request][1] + self.timeout_us:
                close(request, expired=True)
            item = items.get(request)
            if method == EV_REQUEST:
                if item is not None:
                    close(request, after=(seq, text))
                items[request] = (seq, us, text, None, None, None)
            elif item is not None and method == EV_RESPONSE:
                items[request] = (*item[:3], seq, text, text if sends else item[5])
            elif item is not None:
                close(request, end=(seq, method, text))
        for request in [r for r, item in items.items() if item[1] + self.timeout_us <= now]:
            close(request, expired=True)
        self._keep([e for e in events if e[3] > now], items)
        if closed:
            # whole numbers and absent ones in one column: objects keep both as they are
            yield pd.DataFrame({c: pd.Series(v, dtype="object") for c, v in zip(_COLUMNS, zip(*closed))})

    def _keep(self, later: list[tuple], items: dict[tuple, tuple]) -> None:
        if later:
            self.waiting.put([tuple(list(c) for c in zip(*later))])
        else:
            self.waiting.clear()
        if items:
            self.open.put([(*request, *item) for request, item in items.items()])
        else:
            self.open.clear()
        times = [e[3] for e in later] + [item[1] + self.timeout_us for item in items.values()]
        if times:  # the timer that is running out goes by itself
            self.handle.registerTimer(_due(min(times)))

    def close(self) -> None:
        pass


def closed_requests(raw: DataFrame, delay: str, timeout: float, buckets: int = BUCKETS) -> DataFrame:
    """Episodes as their events close them: a stream of ``CLOSED_SCHEMA``.

    ``raw`` has capture events (``sources.events``).  An event older than the
    newest one by more than ``delay`` when its batch begins is late: it is left
    out, and counted (``late_events``).  Needs the RocksDB state store.  A task
    holds what waits in one of the ``buckets``; their number belongs to the
    checkpoint.
    """
    # the planning worker of stateful operators sees no shipped files, only what is pickled
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    events = capture.network_events(raw.withWatermark("ts", delay), "ts")
    sends = (F.col("method") == EV_RESPONSE) & params()["response"]["requestHeaders"].isNotNull()
    bucket = F.pmod(F.xxhash64("page_id", "request_id"), F.lit(buckets))
    rows = events.select(bucket.alias("bucket"), F.col("page_id").cast("string").alias("page"), "request_id", "seq", "ts", F.unix_micros("ts").alias("us"), "method", "params",
                         F.coalesce(sends, F.lit(False)).alias("sends"))
    return rows.groupBy("bucket").transformWithStateInPandas(
        _RequestAssembler(round(timeout * 1e6)), CLOSED_SCHEMA, "append", "EventTime")


def episodes(closed: DataFrame) -> DataFrame:
    """Captures and audit rows of closed requests, in the columns of the batch assembly without its episode number."""
    def read(text: str):
        return F.when(F.col(text).isNotNull(), params(text))

    parsed = closed.select("*", read("start").alias("s"), read("re").alias("r"), read("sent").alias("t"),
                           read("end").alias("e"), read("next").alias("x"))
    s, r, e = F.col("s"), F.col("r"), F.col("e")
    folded = parsed.select(
        "page_id", "request_id", F.lit(None).cast("bigint").alias("episode"),
        F.struct(F.col("start_seq").alias("seq"), s["type"].alias("type"), s["timestamp"].alias("clock"), s["wallTime"].alias("wall"),
                 s["initiator"].alias("initiator"), s["request"].alias("request")).alias("st"),
        F.when(F.col("re").isNotNull(), F.struct(F.col("re_seq").alias("seq"), r["type"].alias("type"),
                                                 r["timestamp"].alias("clock"), r["response"].alias("r"))).alias("re"),
        F.col("t")["response"]["requestHeaders"].alias("sent_headers"),
        F.when(F.col("end_seq").isNotNull(), F.struct(F.col("end_seq").alias("seq"), F.col("end_method").alias("method"),
                                                      e["encodedDataLength"].alias("bytes"))).alias("en"),
        F.when(F.col("next_seq").isNotNull(), F.struct(F.col("next_seq").alias("seq"), F.col("x")["redirectResponse"].alias("r"))).alias("nx"),
        "expired")
    return capture.finish_episodes(folded, F.when(F.col("expired"), "expired")).drop("episode")


def late_events(query: StreamingQuery) -> int:
    """Events a finished query has left out because they came too late."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
