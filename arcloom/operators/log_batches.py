"""Cutting log lines into batches by size, exactly and in parallel.

A batch ends with the line that takes it over a limit, so where one ends
depends on all lines before it.  What a run of lines does to that state is
small, though: the bytes held on entry only decide which of its first lines
closes the first batch; everything after follows from there.  So each file is
cut into segments of consecutive lines, each segment is summed up on its own,
the summaries are chained per file, and each segment then numbers its lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcloom.fixed_values import LOG_FLUSH_BYTES
from arcloom.operators.skew import SEGMENT_SPAN, ordered_scan

_SUMMARY = ("file_seq BIGINT, seg BIGINT, total BIGINT, upto ARRAY<BIGINT>, held ARRAY<BIGINT>, closed ARRAY<BIGINT>")
_ENTRY = "file_seq BIGINT, seg BIGINT, entry_held BIGINT, entry_batch BIGINT"


def _next_starts(upto: np.ndarray, limit: int) -> np.ndarray:
    """For a batch that starts at line i: the line after its last one, or len+1 if it stays open."""
    before = np.concatenate(([0], upto[:-1]))
    return np.searchsorted(upto, before + limit, side="right") + 1


def _summaries(limit: int):
    def summarize(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        upto = np.cumsum(pdf["size"].to_numpy(dtype=np.int64))
        n, nxt = len(upto), _next_starts(upto, limit)
        before = np.concatenate(([0], upto))
        held, closed = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        for i in range(n - 1, -1, -1):
            if nxt[i] > n:
                held[i] = upto[-1] - before[i]
            else:
                held[i], closed[i] = held[nxt[i]], closed[nxt[i]] + 1
        # the first batch can only be closed by a line that begins within the limit
        zone = int(np.searchsorted(before[:-1], limit, side="right"))
        return pd.DataFrame({
            "file_seq": [pdf["file_seq"].iloc[0]], "seg": [pdf["seg"].iloc[0]], "total": [int(upto[-1])],
            "upto": [upto[:zone]], "held": [held[1:zone + 1]], "closed": [closed[1:zone + 1]]})
    return summarize


def _chain(limit: int):
    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, held, batch = None, 0, 0
        for pdf in batches:
            entries = []
            for r in pdf.itertuples():
                if r.file_seq != file:
                    file, held, batch = r.file_seq, 0, 0
                entries.append((held, batch))
                closer = int(np.searchsorted(r.upto, limit - held, side="right"))
                if closer < len(r.upto):
                    held, batch = int(r.held[closer]), batch + 1 + int(r.closed[closer])
                else:
                    held += r.total
            yield pdf[["file_seq", "seg"]].assign(
                entry_held=[h for h, _ in entries], entry_batch=[b for _, b in entries])
    return chain


def _numbers(limit: int):
    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        upto = np.cumsum(pdf["size"].to_numpy(dtype=np.int64))
        n, nxt = len(upto), _next_starts(upto, limit)
        starts = np.zeros(n + 1, np.int64)
        at = int(np.searchsorted(upto, limit - int(pdf["entry_held"].iloc[0]), side="right")) + 1
        while at <= n:
            starts[at] = 1
            at = int(nxt[at]) if at < n else n + 1
        batch = int(pdf["entry_batch"].iloc[0]) + np.cumsum(starts[:n])
        return pdf[["file_seq", "seq"]].assign(batch=batch)
    return number


def exact_cuts(sized: DataFrame, limit: int = LOG_FLUSH_BYTES, span: int = SEGMENT_SPAN) -> DataFrame:
    """``(file_seq, seq, size)`` -> ``(file_seq, seq, batch)``.

    Groups are bounded by ``span`` lines; the pass over a whole file sees one
    row per segment.
    """
    rows = sized.withColumn("seg", F.expr(f"seq div {span}"))
    summaries = rows.groupBy("file_seq", "seg").applyInPandas(_summaries(limit), _SUMMARY)
    entries = summaries.repartition("file_seq").sortWithinPartitions("file_seq", "seg").mapInPandas(_chain(limit), _ENTRY)
    return (
        rows.join(entries, ["file_seq", "seg"])
        .groupBy("file_seq", "seg")
        .applyInPandas(_numbers(limit), "file_seq BIGINT, seq BIGINT, batch BIGINT")
    )


def log_batches(lines: DataFrame, limit: int = LOG_FLUSH_BYTES, exact: bool = True,
                span: int = SEGMENT_SPAN) -> DataFrame:
    """Lines ``(file_path, file_seq, seq, line)`` -> batches ``(…, batch, record_seq, body)``.

    ``exact=False`` cuts at multiples of the running size instead, without
    Python.  A batch is bounded by the limit and one line, so collecting it is
    safe; only lengths are looked at before that.
    """
    sized = lines.select("file_seq", "seq", (F.octet_length("line") + 1).cast("bigint").alias("size"))
    if exact:
        cuts = exact_cuts(sized, limit, span)
    else:
        cuts = ordered_scan(sized, ["file_seq"], "seq", sums={"upto": F.col("size")}, span=span).select(
            "file_seq", "seq", F.expr(f"(upto - size) div {limit}").alias("batch"))
    members = F.array_sort(F.collect_list(F.struct("seq", "line")))
    return (
        lines.join(cuts, ["file_seq", "seq"])
        .groupBy("file_seq", "batch")
        .agg(F.first("file_path").alias("file_path"), F.max("seq").alias("record_seq"), members.alias("m"))
        .select("file_path", "file_seq", "batch", "record_seq",
                F.concat(F.array_join(F.transform("m", lambda x: x["line"]), "\n"), F.lit("\n")).alias("body"))
    )
