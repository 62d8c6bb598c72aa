"""Counts of byte n-grams per document, and statistics of them over all documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcloom.llm import tasks

# (bytes of the rows, their offsets) -> (rows x dims) counts
Counter = Callable[[np.ndarray, np.ndarray], np.ndarray]


def gram_counter(classes: np.ndarray, bits: int, sizes: tuple[int, ...], dims: int) -> Counter:
    """Counts n-grams of byte classes, hashed to ``dims`` cells.  ``classes`` maps each byte to fewer than 2**bits."""
    table = classes.astype(np.uint32)

    def count(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows = len(offsets) - 1
        row = tasks.row_of(offsets)
        mapped = table[data]
        out = np.zeros(rows * dims, np.float32)
        for n in sizes:
            if len(data) < n:
                continue
            code = mapped[:len(data) - n + 1].copy()
            for k in range(1, n):
                code = (code << np.uint32(bits)) | mapped[k:len(data) - n + 1 + k]
            inside = row[:len(code)] == row[n - 1:]
            code = (code + np.uint32(n)) * np.uint32(2654435761)  # spreads neighbouring codes over the cells
            cell = (code >> np.uint32(7)) % np.uint32(dims)
            at = row[:len(code)].astype(np.int64) * dims + cell
            out += np.bincount(at[inside], minlength=len(out)).astype(np.float32)
        return out.reshape(rows, dims)

    return count


def document_frequencies(df: DataFrame, text: str, counter: Counter, dims: int) -> tuple[int, np.ndarray]:
    """(documents, documents with each cell) over all rows; ``dims`` numbers reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(dims, np.int64), 0
        for batch in batches:
            for part, data, offsets in tasks.chunks(batch, text):
                seen += (counter(data, offsets) > 0).sum(axis=0)
                rows += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), pa.array([seen.tolist()], pa.list_(pa.int64()))],
                                         names=["rows", "seen"])

    per_task = df.select(text).mapInArrow(run, "rows bigint, seen array<bigint>")
    total = per_task.select("rows", F.posexplode("seen").alias("cell", "n")).groupBy("cell").agg(
        F.sum("n").alias("n"), F.sum("rows").alias("rows")).collect()
    seen = np.zeros(dims)
    for r in total:
        seen[r["cell"]] = r["n"]
    return (total[0]["rows"] if total else 0), seen


def inverse_frequencies(documents: int, seen: np.ndarray) -> np.ndarray:
    return (np.log((1.0 + documents) / (1.0 + seen)) + 0.0).astype(np.float32)


def weigh(counts: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Unit vectors of logarithmic counts times ``inverse``; a row without any weight stays zero."""
    vectors = np.log1p(counts) * inverse
    norm = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return vectors / np.where(norm > 0, norm, 1.0)
