"""Toxicity by a learned lexicon whose terms are also found misspelled.

* Lexicon: words of labelled texts that stand in toxic ones far more often than
  chance allows, counted by their distinct surroundings so that copies of one
  text count once.
* Search: the Levenshtein automata of all terms, walked together over the trie
  of the lexicon, make one deterministic automaton; every word of every text
  runs through it, many words at a time.
* Context: a window around each hit tells quotation and report from abuse.
* Score: evidence of the hits, calibrated on the labelled sample.

At most ``SAMPLE`` labelled texts are learned from.  Every word that the evidence
in them supports becomes a term; evidence alone sizes the lexicon.  Every text is
searched in full.
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcloom.llm import tasks
from arcloom.llm.samples import labelled_sample
from arcloom.session import cut_lineage, share

SAMPLE = 20_000
MIN_CONTEXTS = 3
FUZZY_LENGTH = 5  # shorter terms are found as they are only
EDIT_PRIOR = 5.0  # texts that a misspelling's expected weight counts as, against its own counts
EDIT_PENALTY = 0.5  # what a misspelling is worth less than its term, at least
WINDOW = 120  # characters on either side of a hit
QUOTED, REPORTED, ADDRESSED = 0.25, 0.6, 1.25  # how a hit counts inside quotes, after a report, next to an address

OPEN, CLOSE, BOTH = "“«„‹", "”»›", "\""
REPORT = re.compile(r"\b(said|says|wrote|writes|quoted?|called|reported|sagte|schrieb|zitiert|dit|écrit|cité|dijo|"
                    r"escribió|citó)\b[^.!?]*$", re.IGNORECASE)
ADDRESS = re.compile(r"\b(you|your|you're|u|du|dein|deine|ihr|tu|toi|vous|ton|tú|usted|eres)\b", re.IGNORECASE)


class Automaton:
    """Deterministic automaton for all words within the allowed edits of a term.

    A state is the set of (trie node, edits so far) reachable by the letters
    read; letters that lead out of none of its nodes all act alike.  So a state
    is stored as the state after any other letter, and the few letters that
    lead elsewhere: one sorted list of (state, letter) for the whole automaton.
    """

    def __init__(self, terms: Iterable[str], fuzzy_length: int = FUZZY_LENGTH) -> None:
        self.terms = sorted(set(terms))
        edits = [int(len(t) >= fuzzy_length) for t in self.terms]
        children: list[dict[str, int]] = [{}]
        ends: list[int] = [-1]
        most = [0]
        for i, term in enumerate(self.terms):
            node = 0
            most[0] = max(most[0], edits[i])
            for c in term:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    ends.append(-1)
                    most.append(0)
                node = children[node][c]
                most[node] = max(most[node], edits[i])
            ends[node] = i
        letters = sorted({c for t in self.terms for c in t})
        self.letters = {c: i + 1 for i, c in enumerate(letters)}  # 0: any other character
        self.shortest = min(map(len, self.terms), default=0) - 1
        self.longest = max(map(len, self.terms), default=0) + 1

        def closed(found: dict[int, int]) -> tuple[tuple[int, int], ...]:
            """Add what is reached by leaving out letters of a term; keep the fewest edits of each node."""
            todo = list(found.items())
            while todo:
                node, e = todo.pop()
                if found.get(node, e) < e:
                    continue
                for child in children[node].values():
                    if e + 1 <= most[child] and found.get(child, 99) > e + 1:
                        found[child] = e + 1
                        todo.append((child, e + 1))
            return tuple(sorted(found.items()))

        def step(state: tuple[tuple[int, int], ...], c: str) -> tuple[tuple[int, int], ...]:
            found: dict[int, int] = {}

            def reach(node: int, e: int) -> None:
                if e <= most[node] and found.get(node, 99) > e:
                    found[node] = e
            for node, e in state:
                reach(node, e + 1)  # one letter too many
                for letter, child in children[node].items():
                    reach(child, e + (letter != c))
            return closed(found)

        start = closed({0: 0})
        number = {(): 0, start: 1}
        todo, others, moves = [start], {0: 0}, {}
        while todo:
            state = todo.pop()
            leading = {c for node, _ in state for c in children[node]}
            for c in [None, *sorted(leading)]:
                after = step(state, c)
                if after not in number:
                    number[after] = len(number)
                    todo.append(after)
                if c is None:
                    others[number[state]] = number[after]
                elif number[after] != others[number[state]]:
                    moves[number[state] * (len(letters) + 1) + self.letters[c]] = number[after]
        self.other = np.array([others[i] for i in range(len(number))], np.int32)
        self.keys = np.array(sorted(moves), np.int64)
        self.after = np.array([moves[k] for k in self.keys.tolist()], np.int32)
        # the term a word is taken for: the one with fewest edits, then the first
        self.accepts = np.full(len(number), -1, np.int32)
        self.edits = np.zeros(len(number), np.int8)
        for state, i in number.items():
            best = min(((e, ends[node]) for node, e in state if ends[node] >= 0 and e <= edits[ends[node]]), default=None)
            if best:
                self.edits[i], self.accepts[i] = best
        self._classes: np.ndarray | None = None

    def classes(self) -> np.ndarray:
        """Class of each code point; upper case counts as lower case."""
        if self._classes is None:
            table = np.zeros(0x110000, np.int16)
            for c, i in self.letters.items():
                table[ord(c)] = i
                if len(c.upper()) == 1 and c.upper().lower() == c:
                    table[ord(c.upper())] = i
            self._classes = table
        return self._classes

    def step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The states after one letter each."""
        if not len(self.keys):
            return self.other[state]
        key = state.astype(np.int64) * (len(self.letters) + 1) + letter
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.after[at], self.other[state])

    def find(self, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indices of the words that match, their final states) of words given as runs of code points."""
        alive = np.flatnonzero((lengths >= self.shortest) & (lengths <= self.longest))
        state = np.ones(len(alive), np.int32)
        kept, ended = [], []
        classes = self.classes()
        for j in range(self.longest + 1):
            over = lengths[alive] == j
            hit = over & (self.accepts[state] >= 0)
            kept.append(alive[hit])
            ended.append(state[hit])
            go = ~over
            alive, state = alive[go], state[go]
            if not len(alive):
                break
            state = self.step(state, classes[points[starts[alive] + j]])
            live = state > 0
            alive, state = alive[live], state[live]
        return np.concatenate(kept), np.concatenate(ended)


def _word_characters() -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] in "LN" for c in range(0x110000)])


_letters: list[np.ndarray] = []


def _words(points: np.ndarray, row_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters and digits: (start, length, row); a run never crosses a row."""
    if not _letters:
        _letters.append(_word_characters())
    inside = _letters[0][points]
    edge = np.zeros(len(points) + 1, bool)
    edge[row_ends] = True
    before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~edge[1:]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends - starts, np.searchsorted(row_ends, starts, side="right")


class Quotes:
    """Where quotations are open in a text: state is kept from the start of each line, however long that is."""

    MARKS = re.compile("[\n" + BOTH + OPEN + CLOSE + "]")

    def __init__(self, text: str) -> None:
        self.at: list[int] = []
        # after each mark: is a straight quotation open, is a pair open; reset by a new line
        self.straight, self.paired, self.line = [False], [False], [0]
        for m in self.MARKS.finditer(text):
            c = m[0]
            self.at.append(m.start())
            if c == "\n":
                self.straight.append(False)
                self.paired.append(False)
                self.line.append(self.line[-1] + 1)
                continue
            self.line.append(self.line[-1])
            self.straight.append(self.straight[-1] != (c in BOTH))
            self.paired.append(True if c in OPEN else False if c in CLOSE else self.paired[-1])
        # before each mark: does the line hold another straight mark, another closing one
        ahead = (False, False)
        self.ahead = [ahead]
        for i in reversed(range(len(self.at))):
            c = text[self.at[i]]
            ahead = (False, False) if c == "\n" else (ahead[0] or c in BOTH, ahead[1] or c in CLOSE)
            self.ahead.append(ahead)
        self.ahead.reverse()

    def around(self, start: int, end: int) -> bool:
        """Whether a quotation is open at ``start`` and ends in the same line after ``end``."""
        before, after = bisect.bisect_left(self.at, start), bisect.bisect_left(self.at, end)
        straight, paired = self.ahead[after]
        return (self.straight[before] and straight) or (self.paired[before] and paired)


def context_weight(text: str, start: int, end: int, quotes: Quotes | None = None) -> float:
    """How much a hit at ``text[start:end]`` counts: less in quotes or after a report, more next to an address."""
    before = text[max(0, start - WINDOW):start]
    after = text[end:end + WINDOW]
    weight = 1.0
    if (quotes or Quotes(text)).around(start, end):
        weight *= QUOTED
    if REPORT.search(before):
        weight *= REPORTED
    near = before[-30:] + " " + after[:30]
    if weight == 1.0 and ADDRESS.search(near):
        weight *= ADDRESSED
    return weight


def _hits(part: pa.RecordBatch, text: str, data: np.ndarray, offsets: np.ndarray,
          found: Automaton) -> Iterator[tuple[int, int, int, float]]:
    """(row, term, edits, context weight) of each hit."""
    if not len(data) or not found.terms:
        return
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    row_ends = lead[offsets[1:]]
    starts, lengths, rows = _words(points, row_ends)
    which, states = found.find(points, starts, lengths)
    texts: dict[int, tuple[str, Quotes]] = {}
    for w, state in zip(which.tolist(), states.tolist(), strict=True):
        r = int(rows[w])
        if r not in texts:
            whole = part.column(text)[r].as_py()
            texts[r] = whole, Quotes(whole)
        at = int(starts[w]) - int(row_ends[r - 1] if r else 0)
        yield (r, int(found.accepts[state]), int(found.edits[state]),
               context_weight(texts[r][0], at, at + int(lengths[w]), texts[r][1]))


def _candidates(sample: DataFrame) -> tuple[list[str], int, int]:
    """(terms, toxic texts, clean texts)."""
    clean, toxic = (sample.filter(F.col("label") == v).count() for v in (0, 1))
    if not toxic or not clean:
        return [], toxic, clean
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    split = sample.select("label", words.alias("w"))
    single = split.select("label", F.explode(F.array_distinct("w")).alias("word")).groupBy("word").agg(
        F.sum("label").alias("t"), F.count(F.lit(1)).alias("m"))
    toxic_share = toxic / (toxic + clean)
    # twice as often in toxic texts as their share says, at least; the rest can't pass the test below
    likely = cut_lineage(single.filter((F.col("t") >= MIN_CONTEXTS) & (F.col("t") >= 2 * toxic_share * F.col("m"))).select("word"),
                         "toxicity-words")
    around = split.filter(F.size("w") > 0).select("label", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("w")), lambda i: F.struct(
            F.element_at("w", i).alias("word"), F.xxhash64(F.get("w", i - 2), F.get("w", i)).alias("around")))).alias("x"))
    counted = cut_lineage(around.select("label", "x.*").join(likely, "word").groupBy("word", "around").agg(
        F.max("label").alias("label")).groupBy("word").agg(F.sum("label").alias("t"), F.count(F.lit(1)).alias("m")), "toxicity-counts")
    # log-likelihood ratio of a word's share of toxic surroundings, against what as many words reach by chance
    needed = math.log(max(counted.count(), 1)) + math.log(1000)
    t, m = F.col("t"), F.col("m")
    c = m - t
    gain = t * F.log(t / (m * toxic_share)) + F.when(c > 0, c * F.log(c / (m * (1 - toxic_share)))).otherwise(0.0)
    kept = counted.filter((t >= MIN_CONTEXTS) & (t / m > toxic_share) & (gain > needed))
    return sorted(r["word"] for r in kept.select("word").collect()), toxic, clean


def fit(docs: DataFrame, labels: DataFrame, train: Column, text: str = "text", label: str = "toxic",
        id_column: str = "doc_id") -> dict:
    """Learn lexicon, weights and calibration from a bounded sample of rows where ``train`` (on the id) holds."""
    sample = labelled_sample(docs, labels, label, train, SAMPLE, "toxicity", id_column, text)
    terms, toxic, clean = _candidates(sample)
    found = Automaton(terms)
    shared = share(sample.sparkSession, found)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in tasks.chunks(batch, "text"):
                hits = [sorted({(t, e) for r, t, e, _ in rows}) for rows in _by_row(part, "text", data, offsets, shared.value)]
                keys = [",".join(f"{t}:{e}" for t, e in h) for h in hits]
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(keys, pa.string())], names=["label", "hits"])

    patterns = sample.mapInArrow(tasks.lean(search), "label int, hits string").groupBy("label", "hits").count().collect()
    counts = np.zeros((max(len(terms), 1), 2, 2))
    for r in patterns:
        for key in filter(None, r["hits"].split(",")):
            t, e = map(int, key.split(":"))
            counts[t, e, r["label"]] += r["count"]
    weights = fitted_weights(counts, toxic, clean)
    evidence = np.array([sum(weights[int(t), int(e)] for t, e in (k.split(":") for k in filter(None, r["hits"].split(","))))
                         for r in patterns])
    slope, intercept = _calibrate(evidence, np.array([r["label"] for r in patterns], float),
                                  np.array([r["count"] for r in patterns], float))
    return {"automaton": found, "weights": weights, "slope": slope, "intercept": intercept}


def fitted_weights(counts: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Evidence of each term, as it is and misspelled, from the texts that hold it (term, edits, label).

    A misspelling is expected to be worth its term's weight less a penalty; the
    penalty is the median of what misspellings of all terms show.  Its own
    counts move it from there.
    """
    def odds(seen: np.ndarray) -> np.ndarray:
        return np.log((seen[..., 1] + 0.5) / (toxic + 1)) - np.log((seen[..., 0] + 0.5) / (clean + 1))

    plain = np.maximum(odds(counts[:, 0]), 0.0)
    seen = counts[:, 1].sum(axis=1)
    # half of the terms lose no more than this; a few whose misspellings are everyday words do not count against the rest
    losses = np.maximum(plain - odds(counts[:, 1]), 0.0)[seen > 0]
    penalty = max(float(np.quantile(losses, 0.5, method="lower")) if len(losses) else 0.0, EDIT_PENALTY)
    expected = np.maximum(plain - penalty, 0.0)
    misspelled = (seen * odds(counts[:, 1]) + EDIT_PRIOR * expected) / (seen + EDIT_PRIOR)
    return np.maximum(np.stack([plain, misspelled], axis=1), 0.0)


def _calibrate(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one feature, weakly regularised; (slope, intercept)."""
    if not len(x) or len(set(y.tolist())) < 2:
        return 1.0, -3.0
    design = np.stack([x, np.ones_like(x)], axis=1)
    theta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        gradient = design.T @ (n * (y - p)) - np.array([0.5, 0.01]) * theta
        curve = (design * (n * p * (1 - p))[:, None]).T @ design + np.diag([0.5, 0.01])
        move = np.linalg.solve(curve, gradient)
        theta += np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return max(float(theta[0]), 0.0), float(theta[1])


def _by_row(part: pa.RecordBatch, text: str, data: np.ndarray, offsets: np.ndarray, found: Automaton) -> list[list[tuple]]:
    rows: list[list[tuple]] = [[] for _ in range(part.num_rows)]
    for hit in _hits(part, text, data, offsets, found):
        rows[hit[0]].append(hit)
    return rows


def score(docs: DataFrame, model: dict, text: str = "text", score: str = "score", hits: str = "hits") -> DataFrame:
    """Add the score (0 to 1, higher: toxic likelier) and the number of hits.

    A term counts once per text and number of edits, with the greatest context
    weight among its hits.  Empty and NULL texts have no hits and the lowest
    score.  Rows are independent; equal texts score alike.
    """
    if clash := {c.lower() for c in docs.columns} & {score.lower(), hits.lower()}:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    shared = share(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part, data, offsets in tasks.chunks(batch, text):
                values, numbers = [], []
                for rows in _by_row(part, text, data, offsets, m["automaton"]):
                    best: dict[tuple[int, int], float] = {}
                    for _, t, e, w in rows:
                        best[t, e] = max(best.get((t, e), 0.0), w)
                    evidence = sum(m["weights"][k] * w for k, w in best.items())
                    values.append(1 / (1 + math.exp(-max(min(m["slope"] * evidence + m["intercept"], 30.0), -30.0))))
                    numbers.append(len(rows))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(values, pa.float64()), pa.array(numbers, pa.int64())],
                    names=[*part.schema.names, score, hits])

    schema = docs.selectExpr("*", f"0D AS `{score}`", f"0L AS `{hits}`").schema
    return docs.mapInArrow(tasks.lean(run), schema)
