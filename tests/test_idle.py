import pandas as pd
from pyspark.sql import functions as F

from arcloom.operators import idle
from arcloom.sources.events import RAW_SCHEMA, frame_events
from arcloom.streaming.idle import _StopDetector

SCHEMA = "page_id BIGINT, seq BIGINT, t DOUBLE, frame_id BIGINT, kind STRING"


def frames(spark, *rows):
    data = [(1, i, float(t), f, "started" if k == "+" else "stopped") for i, (t, f, k) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA).withColumn("ts", F.timestamp_seconds("t"))


def spans(df, **kw):
    return sorted((r.idle_from.timestamp(), r.idle_until and r.idle_until.timestamp()) for r in idle.idle_intervals(df, **kw).collect())


def test_intervals(spark):
    df = frames(spark, (0, 1, "+"), (1, 2, "+"), (2, 1, "-"), (3, 2, "-"), (7, 1, "+"), (8, 1, "+"), (9, 1, "-"))
    for span in (2, 1000):
        assert spans(df, span=span) == [(3.0, 7.0), (9.0, None)]


def test_a_page_is_idle_before_it_loads(spark):
    starts = spark.createDataFrame([(1, -5.0)], "page_id BIGINT, t DOUBLE").select("page_id", F.timestamp_seconds("t").alias("start_ts"))
    assert spans(frames(spark, (0, 1, "+")), starts=starts) == [(-5.0, 0.0)]


def test_stop_without_start_is_ignored_and_counted(spark):
    df = frames(spark, (0, 1, "-"), (1, 1, "+"), (2, 2, "-"), (3, 1, "-"), (4, 1, "-"))
    assert spans(df) == [(3.0, None)]
    assert idle.unmatched_stops(df).first().unmatched == 3


def stop(spark, *rows, idle_s=1, total=60):
    r = idle.stop_times(frames(spark, *rows), idle_s, total).first()
    return r.reason, r.after_us / 1e6


def test_stop_reasons(spark):
    assert stop(spark, (0, 1, "+"), (10, 1, "-")) == ("idle", 11.0)
    assert stop(spark, (0, 1, "+"), idle_s=1, total=5) == ("timeout", 5.0)
    assert stop(spark, (0, 1, "+"), (2, 1, "-"), (2.5, 1, "+"), (4, 1, "-"), (5, 1, "+")) == ("idle", 5.0)
    assert stop(spark, (0, 1, "+"), (4.5, 1, "-"), total=5) == ("timeout", 5.0)
    assert stop(spark, (0, 1, "-"), (0.5, 2, "+")) == ("timeout", 60.0)


def test_frame_events_from_raw(spark):
    rows = [(1, 0, "Page.frameStartedLoading", None, '{"frameId": "F"}'), (1, 1, "Page.frameStoppedLoading", None, '{"frameId": "F"}'),
            (1, 2, "Network.loadingFailed", None, "{}")]
    out = frame_events(spark.createDataFrame(rows, RAW_SCHEMA)).orderBy("seq").collect()
    assert [(r.frame_id, r.kind) for r in out] == [("F", "started"), ("F", "stopped")]


def test_session_stream_equals_batch(spark):
    from arcloom.session import scratch_path
    from arcloom.streaming import sinks

    path = scratch_path(spark, "t-sessions")
    times = [0, 5, 14, 30, 31, 60, 1000]
    df = spark.createDataFrame([(k, t) for k in (1, 2) for t in times], "k INT, t INT").select("k", F.timestamp_seconds("t").alias("ts"))
    df.write.parquet(path)
    batch = idle.activity_sessions(df, "k", "ts", 10)
    assert sorted((r.session_start.timestamp(), r.n_events) for r in batch.filter("k = 1").collect()) == [
        (0, 3), (30, 2), (60, 1), (1000, 1)]
    s = idle.activity_session_stream(spark.readStream.schema("k INT, ts TIMESTAMP").parquet(path), "k", "ts", "10 seconds", "1 second")
    sinks.run_available(s, lambda d, i: sinks.write_batch(d, path + "-out", i), path + "-cp")
    got = sinks.read_batches(
        spark, path + "-out", "k INT, session_start TIMESTAMP, session_end TIMESTAMP, n_events BIGINT").drop("batch_id")
    closed = batch.filter(F.unix_seconds("session_end") < 999)  # the watermark has not passed the last one
    assert got.exceptAll(closed).count() == 0 and got.count() == closed.count() == 6


class Frames(dict):
    """A map state that counts how often it is called."""

    calls = 0

    def keys(self):
        self.calls += 1
        return iter(list(super().keys()))

    def updateValue(self, k, v):
        self.calls += 1
        self[k] = v

    def removeKey(self, k):
        self.calls += 1
        del self[k]


class Handle:
    def __init__(self):
        self.timers, self.value = [], None

    def getValueState(self, *_):
        return self

    def getMapState(self, *_):
        return Frames()

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def listTimers(self):
        return list(self.timers)

    def deleteTimer(self, t):
        self.timers.remove(t)

    def registerTimer(self, t):
        self.timers.append(t)


def test_frames_are_read_once_and_written_where_they_changed():
    """Calls to the state grow with the frames whose state changes, not with events or with what is loading."""
    page, handle = _StopDetector(1_000_000, 10_000_000_000), Handle()
    page.init(handle)

    def take(*rows):
        page.loading.calls = 0
        frame = pd.DataFrame([(i, us, f, k) for i, (us, f, k) in enumerate(rows)], columns=["seq", "us", "frame_id", "kind"])
        return [r for pdf in page.handleInputRows((1,), iter([frame]), None) for r in pdf.to_dict("records")]

    assert take(*[(i, f, "started") for i, f in enumerate(range(100))]) == [] and len(page.loading) == 100
    # a hundred frames stay, one comes and goes a thousand times
    assert take(*[(200 + i, 500, "started" if i % 2 == 0 else "stopped") for i in range(2000)]) == []
    assert page.loading.calls == 1 and sorted(f for f, in page.loading) == list(range(100))
    assert take(*[(3000 + f, f, "stopped") for f in range(100)]) == [] and not page.loading
    assert handle.value == (0, 3099, False) and len(handle.timers) == 1
    page.loading.clear = lambda: None
    assert take((2_000_000, 1, "started")) == [{"page_id": 1, "reason": "idle", "stop_us": 1_003_099, "after_us": 1_003_099}]
