"""Idle detection on a stream, with event-time timers."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STOP_SCHEMA = "page_id BIGINT, reason STRING, stop_us BIGINT, after_us BIGINT"


class _StopDetector(StatefulProcessor):
    """Per page: the loading frames, since when it is idle, when it began, whether it stopped."""

    def __init__(self, idle_us: int, timeout_us: int) -> None:
        self.idle_us, self.timeout_us = idle_us, timeout_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.page = handle.getValueState("page", "start_us BIGINT, idle_since BIGINT, stopped BOOLEAN")
        self.loading = handle.getMapState("loading", "frame_id BIGINT", "since BIGINT")

    def _due(self, start: int, idle_since: int | None) -> tuple[int, str]:
        deadline = start + self.timeout_us
        if idle_since is not None and idle_since + self.idle_us <= deadline:
            return idle_since + self.idle_us, "idle"
        return deadline, "timeout"

    def _stop(self, page_id: int, start: int, at: int, reason: str) -> pd.DataFrame:
        self.page.update((start, None, True))
        self.loading.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        return pd.DataFrame({"page_id": [page_id], "reason": [reason], "stop_us": [at], "after_us": [at - start]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # one page's rows of one micro-batch
        pdf = pd.concat([r[["seq", "us", "frame_id", "kind"]] for r in rows]).sort_values("seq")
        first = int(pdf["us"].min())
        start, idle_since, stopped = self.page.get() if self.page.exists() else (first, first, False)
        if stopped:
            return
        # every access to the state is a call out of this process: frames are read once, and written where they have changed
        before = {frame for frame, in self.loading.keys()}
        loading: dict[int, int | None] = dict.fromkeys(before)
        for frame, kind, us in zip(pdf["frame_id"].tolist(), pdf["kind"].tolist(), pdf["us"].tolist()):
            at, reason = self._due(start, idle_since)
            if us >= at:
                yield self._stop(key[0], start, at, reason)
                return
            frame = int(frame)
            if kind == "started":
                loading[frame] = int(us)
                idle_since = None
            elif frame in loading:
                del loading[frame]
                if not loading:
                    idle_since = int(us)
        for frame in before - loading.keys():
            self.loading.removeKey((frame,))
        for frame, since in loading.items():
            if since is not None:
                self.loading.updateValue((frame,), (since,))
        self.page.update((start, idle_since, False))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(self._due(start, idle_since)[0] // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start, idle_since, stopped = self.page.get()
        if not stopped:
            at, reason = self._due(start, idle_since)
            yield self._stop(key[0], start, at, reason)

    def close(self) -> None:
        pass


def stop_stream(frames: DataFrame, idle_timeout: float, timeout: float, delay: str = "0 seconds") -> DataFrame:
    """Stops of pages as a stream: ``(page_id, reason, stop_us, after_us)``, one row per page.

    ``frames``: ``(page_id, seq, ts, us, frame_id BIGINT, kind)`` with ``us``
    the event time in microseconds.  A page stops at the first moment it was
    idle for ``idle_timeout``, at the latest ``timeout`` after its first event;
    a timer tells when no event does.  Needs the RocksDB state store.
    """
    # the planning worker of stateful operators sees no shipped files, only what is pickled
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    return (
        frames.withWatermark("ts", delay)
        .groupBy("page_id")
        .transformWithStateInPandas(
            _StopDetector(int(idle_timeout * 1e6), int(timeout * 1e6)), STOP_SCHEMA, "append", "EventTime")
    )


ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
