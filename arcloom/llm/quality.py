"""Quality by the votes of the nearest labelled texts.

Terms of a text are its form rather than its vocabulary: n-grams of character
classes, and word repetition.  TF-IDF vectors of labelled texts are reduced by
a singular value decomposition (latent-semantic vectors), broadcast, and every
text is compared with all of them by cosine, in blocks.  The ``NEIGHBOURS``
nearest vote, weighted by similarity.

Document frequencies cover all texts; at most ``SAMPLE`` labelled texts are
learned from, so the broadcast is ``SAMPLE * RANK`` floats whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcloom.llm import grams, tasks
from arcloom.llm.samples import labelled_sample

SAMPLE = 6000
RANK = 48
NEIGHBOURS = 25
POWER = 4  # weight of a neighbour: similarity to this power
GRAM_DIMS = 1024
REPEAT_DIMS = 12  # how often a word repeats the one before it, in steps of the share
DIMS = GRAM_DIMS + REPEAT_DIMS


def form_classes() -> np.ndarray:
    """Bytes by their part in the form of a text."""
    table = np.full(256, 9, np.uint32)
    table[97:123] = 1
    table[65:91] = 2
    table[48:58] = 3
    table[128:] = 4
    table[0x20] = 0
    for b, kind in ((0x09, 5), (0x0A, 5), (0x0D, 5), (0x2E, 6), (0x2C, 6), (0x21, 7), (0x3F, 7), (0x7C, 8)):
        table[b] = kind
    for b in b"#$%&*+=<>^~_@\\/":
        table[b] = 10
    for b in b"(){}[]\"':;-":
        table[b] = 11
    return table


def _counter() -> grams.Counter:
    forms = grams.gram_counter(form_classes(), 4, (1, 2, 3), GRAM_DIMS)

    def count(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows = len(offsets) - 1
        words, row, _, _ = tasks.word_hashes(data, offsets)
        same = np.zeros(rows)
        if len(words) > 1:
            again = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
            same = np.bincount(row[1:][again], minlength=rows)
        share = same / np.maximum(np.bincount(row, minlength=rows), 1)
        level = np.minimum((share * REPEAT_DIMS * 2).astype(int), REPEAT_DIMS)
        steps = (np.arange(REPEAT_DIMS)[None, :] < level[:, None]).astype(np.float32)
        # as heavy as the text is long: shares stay comparable with counts
        return np.concatenate([forms(data, offsets), steps * np.maximum(np.diff(offsets), 1)[:, None]], axis=1)

    return count


def fit(docs: DataFrame, labels: DataFrame, train: Column, text: str = "text", label: str = "quality",
        id_column: str = "doc_id") -> dict:
    """Latent-semantic vectors and labels of a bounded sample of the rows where ``train`` (on the id) holds."""
    counter = _counter()
    documents, seen = grams.document_frequencies(docs, text, counter, DIMS)
    # cells that nearly every text has still tell its form by how often they occur
    inverse = grams.inverse_frequencies(documents, seen) + np.float32(0.2)
    sample = labelled_sample(docs, labels, label, train, SAMPLE, "quality", id_column, text)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in tasks.chunks(batch, "text"):
                rows = grams.weigh(counter(data, offsets), inverse).astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("label"), pa.array([r.tobytes() for r in rows], pa.binary())],
                    names=["id", "label", "v"])

    id_type = sample.schema["id"].dataType.simpleString()
    rows = sorted(sample.mapInArrow(vectors, f"id {id_type}, label int, v binary").collect(), key=lambda r: r["id"])
    marks = np.array([r["label"] for r in rows], np.float32)
    if not len(rows):
        return {"inverse": inverse, "axes": np.zeros((DIMS, 0), np.float32), "points": np.zeros((0, 0), np.float32),
                "labels": marks, "prior": 0.5}
    x = np.stack([np.frombuffer(r["v"], np.float32) for r in rows])
    # right singular vectors of the sample: eigenvectors of its small Gram matrix
    _, axes = np.linalg.eigh((x.T @ x).astype(np.float64))
    axes = axes[:, ::-1][:, :RANK].astype(np.float32)
    return {"inverse": inverse, "axes": axes, "points": _unit(x @ axes), "labels": marks, "prior": float(marks.mean())}


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1.0)


def _votes(x: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """(score, similarity of the nearest) of latent vectors ``x``."""
    points, marks = model["points"], model["labels"]
    k = min(NEIGHBOURS, len(points))
    if not k:
        return np.full(len(x), model["prior"]), np.zeros(len(x))
    cosines = x @ points.T
    near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
    similar = np.clip(np.take_along_axis(cosines, near, axis=1), 0.0, 1.0).astype(np.float64)
    weight = similar ** POWER
    total = weight.sum(axis=1)
    score = np.where(total > 0, (weight * marks[near]).sum(axis=1) / np.where(total > 0, total, 1.0), model["prior"])
    return score, similar.max(axis=1)


def score(docs: DataFrame, model: dict, text: str = "text", score: str = "score", nearest: str = "nearest") -> DataFrame:
    """Add the score (0 to 1, higher: label 1 likelier) and the similarity of the nearest labelled text.

    An empty or NULL text, or any when nothing was learned, scores the share of
    label 1 among the sample.  Rows are independent; equal texts score alike.
    """
    if clash := {c.lower() for c in docs.columns} & {score.lower(), nearest.lower()}:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    counter = _counter()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part, data, offsets in tasks.chunks(batch, text):
                latent = _unit(grams.weigh(counter(data, offsets), m["inverse"]).astype(np.float32) @ m["axes"])
                value, close = _votes(latent, m)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(np.clip(value, 0.0, 1.0)), pa.array(close.astype(np.float64))],
                    names=[*part.schema.names, score, nearest])

    schema = docs.selectExpr("*", f"0D AS `{score}`", f"0D AS `{nearest}`").schema
    return docs.mapInArrow(run, schema)
