"""Browser capture events: schema, parsing, batch and stream reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcloom.fixed_values import EV_FRAME_NAVIGATED, EV_FRAME_STARTED, EV_FRAME_STOPPED

# one row per event: arrival order is ``seq`` (unique per page), parameters are JSON
RAW_SCHEMA = "page_id BIGINT, seq BIGINT, method STRING, ts TIMESTAMP, params STRING"

_RESPONSE = (
    "STRUCT<url: STRING, status: INT, statusText: STRING, headers: MAP<STRING, STRING>,"
    " requestHeaders: MAP<STRING, STRING>, mimeType: STRING, remoteIPAddress: STRING, protocol: STRING>"
)
PARAMS_SCHEMA = (
    "STRUCT<requestId: STRING, type: STRING, timestamp: DOUBLE, wallTime: DOUBLE, initiator: STRING,"
    " encodedDataLength: DOUBLE,"
    " request: STRUCT<url: STRING, method: STRING, headers: MAP<STRING, STRING>,"
    " hasPostData: BOOLEAN, postData: STRING>,"
    f" response: {_RESPONSE}, redirectResponse: {_RESPONSE},"
    " frameId: STRING, frame: STRUCT<id: STRING, parentId: STRING, url: STRING, mimeType: STRING>>"
)

# what must be known of an event before it is known to matter
KEY_SCHEMA = "STRUCT<requestId: STRING, request: STRUCT<url: STRING>, response: STRUCT<url: STRING>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW_SCHEMA).json(path)


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    return (
        spark.readStream.schema(RAW_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(path)
    )


def params(raw: Column | str = "params") -> Column:
    return F.from_json(raw, PARAMS_SCHEMA)


def keys_of(raw: Column | str = "params") -> Column:
    return F.from_json(raw, KEY_SCHEMA)


def frame_events(raw: DataFrame) -> DataFrame:
    """Loading starts and stops of frames: ``(page_id, seq, ts, frame_id, kind)``."""
    kind = F.when(F.col("method") == EV_FRAME_STARTED, "started").otherwise("stopped")
    return raw.filter(F.col("method").isin(EV_FRAME_STARTED, EV_FRAME_STOPPED)).select(
        "page_id", "seq", "ts", params()["frameId"].alias("frame_id"), kind.alias("kind")
    )


def root_navigations(raw: DataFrame, root_frames: DataFrame) -> DataFrame:
    """Navigations of each page's root frame only.

    ``root_frames`` has one row per page: ``(page_id, root_frame)``.
    """
    frame = params()["frame"]
    moves = raw.filter(F.col("method") == EV_FRAME_NAVIGATED).select(
        "page_id", "seq", "ts", frame["id"].alias("frame_id"), frame["url"].alias("url"),
        frame["mimeType"].alias("mime_type"),
    )
    return keep_root(moves, root_frames)


def keep_root(moves: DataFrame, root_frames: DataFrame) -> DataFrame:
    roots = root_frames.select("page_id", F.col("root_frame").alias("frame_id"))
    return moves.join(roots, ["page_id", "frame_id"], "left_semi")
