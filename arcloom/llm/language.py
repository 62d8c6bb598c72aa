"""Language identification by nearest centroid.

Texts become unit vectors of TF-IDF weighted letter n-grams.  Each language has
several centroids, found by spherical k-means; a text takes the language of the
centroid with the greatest cosine.  A text farther from every centroid than the
training texts of that centroid mostly are is marked as rejected.

Document frequencies cover all texts.  Centroids are fitted on at most
``SAMPLE_PER_LANGUAGE`` training texts of each language, chosen by a hash of the
id; a language is learned however rare it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcloom.llm import grams, tasks
from arcloom.session import cut_lineage

DIMS = 4096
SAMPLE_PER_LANGUAGE = 400
CENTROIDS = 4
ROUNDS = 12
REJECT_SHARE = 0.01  # share of a centroid's training texts that its distance limit leaves outside
UNKNOWN = "und"


def letter_classes() -> np.ndarray:
    """Letters without case, bytes of other scripts folded to 32 classes, everything else as one gap."""
    table = np.zeros(256, np.uint32)
    for b in range(26):
        table[65 + b] = table[97 + b] = 1 + b
    for b in range(128, 256):
        table[b] = 27 + (b & 31)
    return table


def _counter() -> grams.Counter:
    return grams.gram_counter(letter_classes(), 6, (2, 3), DIMS)


def _fit_one(vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit centroids, least cosine a member should have)."""
    chosen = [0]
    for _ in range(min(k, len(vectors)) - 1):  # farthest first: deterministic
        far = (vectors @ vectors[chosen].T).max(axis=1).argmin()
        if far in chosen:
            break
        chosen.append(int(far))
    centres = vectors[chosen]
    for _ in range(ROUNDS):
        nearest = (vectors @ centres.T).argmax(axis=1)
        sums = np.stack([vectors[nearest == i].sum(axis=0) if (nearest == i).any() else centres[i]
                         for i in range(len(centres))])
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = sums / np.where(norm > 0, norm, 1.0)
    cosines = vectors @ centres.T
    nearest = cosines.argmax(axis=1)
    limits = np.array([np.quantile(cosines[nearest == i, i], REJECT_SHARE) if (nearest == i).any() else 0.0
                       for i in range(len(centres))])
    return centres.astype(np.float32), limits


def fit(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang", id_column: str = "doc_id") -> dict:
    """Learn from rows where ``train`` holds, text has a letter and lang is not NULL."""
    counter = _counter()
    documents, seen = grams.document_frequencies(docs, text, counter, DIMS)
    inverse = grams.inverse_frequencies(documents, seen)
    by_hash = Window.partitionBy("__lang").orderBy("__h", "__id", "__t")
    usable = docs.filter(train & F.col(lang).isNotNull() & F.col(text).isNotNull())
    # texts of a language with many are first thinned by the hash to a few times the bound: no language gathers in a task
    listed = usable.select(F.col(lang).alias("__lang"), F.xxhash64(F.col(id_column), F.lit(11)).alias("__h"),
                           F.col(id_column).alias("__id"), F.xxhash64(text).alias("__t"))
    share_of = listed.groupBy("__lang").agg((F.lit(4.0 * SAMPLE_PER_LANGUAGE) / F.count(F.lit(1))).alias("__share"))
    # one row a language, of which the model itself is far more: thinned in the scan, before anything meets by language
    thinned = listed.join(F.broadcast(share_of), "__lang").filter(F.pmod("__h", F.lit(1 << 30)) < F.col("__share") * (1 << 30))
    picked = cut_lineage(thinned.withColumn("__n", F.row_number().over(by_hash)).filter(
        F.col("__n") <= SAMPLE_PER_LANGUAGE), "lang-sample")
    # rows that repeat in full count once, so a language has no more texts here than were picked
    chosen = usable.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(id_column).alias("__id"), F.xxhash64(text).alias("__t")).join(
        F.broadcast(picked.select(F.col("__lang").alias("lang"), "__id", "__t").distinct()), ["lang", "__id", "__t"], "left_semi").dropDuplicates(
            ["lang", "__id", "__t"]).select("lang", "text")
    share = inverse

    def centres(group: pa.Table) -> pa.Table:
        # at most SAMPLE_PER_LANGUAGE texts
        name = group.column("lang")[0].as_py()
        rows = []
        for batch in group.select(["text"]).combine_chunks().to_batches():
            for _, data, offsets in tasks.chunks(batch, "text"):
                rows.append(grams.weigh(counter(data, offsets), share))
        vectors = np.concatenate(rows)
        vectors = vectors[vectors.any(axis=1)]
        if not len(vectors):
            return pa.table({"lang": pa.array([], pa.string()), "centre": pa.array([], pa.binary()),
                             "least": pa.array([], pa.float64())})
        order = np.lexsort(vectors.T[:8])
        found, limits = _fit_one(vectors[order], CENTROIDS)
        return pa.table({"lang": [name] * len(found), "centre": [c.tobytes() for c in found], "least": limits.tolist()})

    learned = chosen.groupBy("lang").applyInArrow(centres, "lang string, centre binary, least double").collect()
    learned.sort(key=lambda r: (r["lang"], r["centre"]))
    return {
        "langs": [r["lang"] for r in learned],
        "centres": np.stack([np.frombuffer(r["centre"], np.float32) for r in learned]) if learned
        else np.zeros((0, DIMS), np.float32),
        "least": np.array([r["least"] for r in learned]),
        "inverse": inverse,
    }


def predict(docs: DataFrame, model: dict, text: str = "text", lang_pred: str = "lang_pred", score: str = "score",
            rejected: str = "rejected") -> DataFrame:
    """Add the predicted language, a score from 0 to 1 (the cosine) and whether the text is too far from its centroid.

    A NULL text, or one without a letter, is ``und`` with score 0.  A text
    whose letters no training text shares takes the first language, score 0,
    and is rejected.  Equal texts have equal results.  Without any learned
    language everything is ``und``.
    """
    if clash := {c.lower() for c in docs.columns} & {lang_pred.lower(), score.lower(), rejected.lower()}:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x CENTROIDS x DIMS floats
    counter = _counter()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part, data, offsets in tasks.chunks(batch, text):
                rows = part.num_rows
                letters = (((data | 32) >= 97) & ((data | 32) <= 122)).astype(np.int64)
                sums = np.concatenate([[0], np.cumsum(letters)])
                lettered = (sums[offsets[1:]] - sums[offsets[:-1]]) > 0
                for i in np.flatnonzero(~lettered):  # no ASCII letter: look at the characters
                    lettered[i] = any(map(str.isalpha, part.column(text)[i].as_py() or ""))
                langs, cosine, far = [UNKNOWN] * rows, np.zeros(rows), np.zeros(rows, bool)
                if len(m["langs"]) and lettered.any():
                    cosines = grams.weigh(counter(data, offsets), m["inverse"]) @ m["centres"].T
                    best = cosines.argmax(axis=1)
                    value = cosines[np.arange(rows), best].astype(float)
                    cosine = np.where(lettered, np.clip(value, 0.0, 1.0), 0.0)
                    far = lettered & (value < m["least"][best])
                    langs = [m["langs"][b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(langs, pa.string()), pa.array(cosine, pa.float64()), pa.array(far)],
                    names=[*part.schema.names, lang_pred, score, rejected])

    schema = docs.selectExpr("*", f"'' AS `{lang_pred}`", f"0D AS `{score}`", f"false AS `{rejected}`").schema
    return docs.mapInArrow(run, schema)
