"""Captures from a stream of events.

Every micro-batch is put behind the events of still open requests and run
through the batch assembly, so both give the same captures by construction and
a hot request is split the same way.  Only events of open requests are kept
between batches, as a written table per batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcloom.fixed_values import EV_FAILED, EV_FINISHED, EV_REQUEST, EV_RESPONSE
from arcloom.operators import capture
from arcloom.operators.skew import SEGMENT_SPAN, lookup_join
from arcloom.session import cut_lineage, remove, scratch_scope
from arcloom.sources.events import RAW_SCHEMA
from arcloom.streaming.sinks import write_batch


class CaptureAssembler:
    """``foreachBatch`` consumer that writes finished episodes and carries open ones.

    ``out`` gets one folder per batch with all closed episodes (captures and
    audit rows).  An open request whose start is more than ``expire_seconds``
    older than the newest event is closed as ``expired``; events that come for
    it later are ignored, as those of any request that is not open.
    Events must arrive in ``seq`` order per page across batches.
    """

    def __init__(self, out: str, state: str, expire_seconds: int | None = None, span: int = SEGMENT_SPAN) -> None:
        self.out, self.state, self.expire_seconds, self.span = out, state, expire_seconds, span

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        with scratch_scope():
            self._take(batch, batch_id)
        # a batch that is run again needs the state before it, and no earlier one
        remove(f"{self.state}/batch_id={batch_id - 2}")

    def _take(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        columns = [c.split()[0] for c in RAW_SCHEMA.split(", ")]
        events = batch.filter(F.col("method").isin(EV_REQUEST, EV_RESPONSE, EV_FINISHED, EV_FAILED)).select(*columns)
        if batch_id > 0:
            carried = spark.read.schema(RAW_SCHEMA).parquet(f"{self.state}/batch_id={batch_id - 1}")
            events = carried.unionByName(events)
        events = cut_lineage(events, "events")
        # numbering starts anew in every batch; (page, request, start_seq) names an episode
        episodes = capture.assemble(events, self.span).drop("episode")
        if self.expire_seconds is not None:
            newest = events.agg(F.max("ts").alias("ts")).first()["ts"]
            old = (F.col("outcome") == "open") & (
                F.col("request.ts") < F.lit(newest) - F.make_dt_interval(secs=F.lit(self.expire_seconds)))
            episodes = episodes.withColumn("outcome", F.when(old, "expired").otherwise(F.col("outcome")))
        episodes = cut_lineage(episodes, "episodes")
        write_batch(episodes.filter("outcome <> 'open'"), self.out, batch_id)
        still_open = episodes.filter("outcome = 'open'").select("page_id", "request_id", "start_seq")
        keyed = events.withColumn("request_id", F.get_json_object("params", "$.requestId"))
        kept = lookup_join(keyed, still_open, ["page_id", "request_id"], ["seq"], how="inner").filter("seq >= start_seq")
        write_batch(kept.select(*columns), self.state, batch_id)


EPISODE_SCHEMA = (
    "page_id BIGINT, request_id STRING, start_seq BIGINT, emit_seq BIGINT, url STRING, resource_type STRING,"
    " remote_ip STRING, protocol STRING,"
    " request STRUCT<method: STRING, headers: ARRAY<STRUCT<name: STRING, value: STRING>>, body: BINARY,"
    " initiator: STRING, has_post_data: BOOLEAN, ts: TIMESTAMP>,"
    " response STRUCT<status: INT, status_text: STRING, headers: ARRAY<STRUCT<name: STRING, value: STRING>>,"
    " mime_type: STRING, body: BINARY, body_is_text: BOOLEAN, bytes_received: BIGINT, ts: TIMESTAMP>,"
    " outcome STRING"
)


def running_totals(episodes: DataFrame, *keys: str) -> DataFrame:
    """Page totals that keep counting while captures arrive (update mode)."""
    return capture.page_totals(episodes, *keys)
