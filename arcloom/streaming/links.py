"""What a record refers to, on a stream: the last marked record before it, kept as state per key."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FOUND_SCHEMA = "file_seq BIGINT, key STRING, record_seq BIGINT, record_id STRING, found STRING"


class _LastBefore(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "record_id STRING")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("record_seq")
        ids, marked = pdf["record_id"].to_numpy(dtype=object), pdf["marked"].to_numpy(dtype=bool)
        known = self.last.get()[0] if self.last.exists() else None
        # the place of the last marked row before each row, -1 for what was known before this batch
        upto = np.maximum.accumulate(np.where(marked, np.arange(len(pdf)), -1))
        before = np.concatenate([[-1], upto[:-1]])
        if upto[-1] >= 0:
            self.last.update((ids[upto[-1]],))
        wanted = np.flatnonzero(pdf["wanted"].to_numpy(dtype=bool))
        if len(wanted):
            found = np.append(ids, known)[before[wanted]]  # -1 is the last place
            yield pd.DataFrame({"file_seq": key[0], "key": key[1], "record_seq": pdf["record_seq"].to_numpy()[wanted],
                                "record_id": ids[wanted], "found": pd.Series(found, dtype="object")})

    def close(self) -> None:
        pass


def _last_before(records: DataFrame, key: Column, marked: Column, wanted: Column) -> DataFrame:
    # the planning worker of stateful operators sees no shipped files, only what is pickled
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    rows = records.select(
        F.col("file_seq").cast("bigint").alias("file_seq"), key.alias("key"), "record_seq", "record_id",
        F.coalesce(marked, F.lit(False)).alias("marked"), F.coalesce(wanted, F.lit(False)).alias("wanted")).filter("marked OR wanted")
    return rows.groupBy("file_seq", "key").transformWithStateInPandas(_LastBefore(), FOUND_SCHEMA, "append", "None")


def asof_document_stream(items: DataFrame, is_document: Column, wants: Column) -> DataFrame:
    """Per conversion the newest earlier document of the same URL in its file: ``(file_seq, target_uri, record_seq, record_id, refers_to)``.

    The stream twin of ``records.asof_document``: one record id is kept per file
    and URL, however many micro-batches lie between.  Records of a file must
    arrive in order across micro-batches; within one their order is restored.
    Needs the RocksDB state store.
    """
    found = _last_before(items, F.col("target_uri"), is_document, wants)
    return found.select("file_seq", F.col("key").alias("target_uri"), "record_seq", "record_id", F.col("found").alias("refers_to"))


def asof_warcinfo_stream(records: DataFrame) -> DataFrame:
    """Per record the last ``warcinfo`` before it in its file: ``(file_seq, record_seq, record_id, warcinfo_id)``; see above."""
    found = _last_before(records, F.lit(""), F.col("rec_type") == "warcinfo", F.lit(True))
    return found.select("file_seq", "record_seq", "record_id", F.col("found").alias("warcinfo_id"))
