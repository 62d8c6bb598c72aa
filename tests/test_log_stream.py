"""Byte batches of a log stream against one pass over the whole log, at any borders of micro-batches."""

import random

import pytest

from arcloom.operators import log_batches
from arcloom.session import scratch_path
from arcloom.streaming import batches, sinks


@pytest.mark.parametrize("seed", [1, 2])
def test_cuts_do_not_depend_on_micro_batches(spark, seed):
    rnd = random.Random(seed)
    rows = [(f"f{f}", f, s, "x" * rnd.choice([0, 3, 40, 99, 300])) for f in range(3) for s in range(rnd.choice([1, 25, 60]))]
    schema = "file_path STRING, file_seq BIGINT, seq BIGINT, line STRING"
    base = scratch_path(spark, "t-log-stream")
    worker = batches.LogBatcher(f"{base}/out", f"{base}/state", limit=200, span=7)
    borders = sorted(rnd.randrange(61) for _ in range(3))
    parts = [[r for r in rows if lo <= r[2] < hi] for lo, hi in zip([0, *borders], [*borders, 61])]
    for i, part in enumerate(parts):
        df = spark.createDataFrame(part, schema)
        worker(df, i)
        if i == 1:
            worker(df, i)  # run again, as after a failure
    found = {(r.file_seq, r.batch, r.record_seq, r.body) for r in worker.batches(spark, len(parts) - 1).collect()}
    want = {(r.file_seq, r.batch, r.record_seq, r.body) for r in log_batches.log_batches(
        spark.createDataFrame(rows, schema), limit=200, span=7).collect()}
    assert found == want
    held = sinks.read_batches(spark, f"{base}/state/lines", batches.LINE_SCHEMA + ", batch_id INT")
    assert all(sum(len(r.line) + 1 for r in held.collect() if r.batch_id == b and r.file_seq == f) <= 200
               for b in range(len(parts)) for f in range(3))
