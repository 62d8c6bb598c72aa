"""Periodic runs of words: online catching of squares over dyadic blocks.

A run is a stretch of words with smallest period q, as long as two periods at
least, that neither neighbouring word extends.  Text arrives word by word.  For
each power of two L the completed blocks of L words have a catcher each: a
block beginning at b waits for the L latest words to equal it at a distance q
of 2L - 1 to 4L - 2.  Any square of such a period holds a whole block in its
first half, so one of the two blocks in question catches it by the time it
ends.  From a catch, the words before the block are compared with those q later
(going back once), the words after it as they arrive: each appended word
advances the squares that are still open.  A square is reported as soon as it
is as long as twice its period; reports of one stretch are one run.

Blocks are compared by 64-bit names, made of the names of their halves, so the
words of one append are compared with their two blocks for a whole level at a
time, and a text costs n log n.  Two different blocks share a name with a
chance of about 2**-64 per comparison.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from arcloom.llm import tasks

MIN_LENGTH = 12
_PIECE = 1 << 16  # words that are joined at a time

_ADD = np.uint64(0x9E3779B97F4A7C15)
RUN_TYPE = T.ArrayType(T.StructType([T.StructField(x, T.LongType(), False) for x in ("start", "length", "period")]), False)
_ARROW_RUNS = pa.list_(pa.field("element", pa.struct([pa.field(x, pa.int64(), False) for x in ("start", "length", "period")]), False))


class SquareCatchers:
    """Finds the runs of a growing sequence of word hashes.

    ``longest`` bounds the periods that can occur (half the longest text of the
    sequence), so no catchers are kept for longer blocks.
    """

    def __init__(self, min_length: int = MIN_LENGTH, longest: int | None = None) -> None:
        self.min_length = min_length
        self.longest = longest
        self.size = 0
        self.names: list[np.ndarray] = [np.zeros(64, np.uint64)]  # by level: the name of the L words from each place on
        self.named = [0]  # by level: how many places have one
        self.open = np.zeros((3, 0), np.int64)  # start, end, period of squares that the latest word continues
        self.closed: list[np.ndarray] = []

    def _name(self, level: int) -> int:
        """Names of the blocks of a level that are complete and have none yet; returns the first such place."""
        block = 1 << level
        names = self.names
        if level == len(names):
            names.append(np.zeros(0, np.uint64))
            self.named.append(0)
        done = self.named[level]
        if len(names[level]) < len(names[0]):
            grown = np.zeros(len(names[0]), np.uint64)
            grown[:done] = names[level][:done]
            names[level] = grown
        half, places = block >> 1, self.size - block + 1
        below = names[level - 1]
        names[level][done:places] = tasks.mix(below[done:places] * _ADD + below[done + half:places + half])
        self.named[level] = places
        return done

    def append(self, words: np.ndarray) -> None:
        """Take the next words, and advance and catch what they complete."""
        old, self.size = self.size, self.size + len(words)
        if self.size > len(self.names[0]):
            grown = np.zeros(max(self.size, 2 * len(self.names[0])), np.uint64)
            grown[:old] = self.names[0][:old]
            self.names[0] = grown
        self.names[0][old:self.size] = words
        caught = [self._catch(0, old)]
        level = 1
        # the shortest period of a level must fit twice into what there is
        while 2 * ((2 << level) - 1) <= min(self.size, self.longest or self.size):
            caught.append(self._catch(level, self._name(level)))
            level += 1
        self._advance(np.concatenate([self.open, *caught], axis=1))

    def _catch(self, level: int, done: int) -> np.ndarray:
        """Squares that begin to show: (start, end so far, period) of suffixes that equal one of their two blocks."""
        block = 1 << level
        names = self.names[level]
        here = np.arange(done, self.size - block + 1)
        found = []
        near = (here - (2 * block - 1)) // block * block  # the nearest block at the least distance or more
        for at in (near, near - block):
            inside = np.flatnonzero(at >= 0)
            hit = inside[names[here[inside]] == names[at[inside]]]
            found.append(np.stack([at[hit], here[hit] - at[hit]]))
        begin, period = np.concatenate(found, axis=1)
        # of blocks that follow each other at the same distance, the first one has the whole stretch
        order = np.lexsort((begin, period))
        begin, period = begin[order], period[order]
        first = np.ones(len(begin), bool)
        first[1:] = (begin[1:] != begin[:-1] + block) | (period[1:] != period[:-1])
        begin, period = begin[first], period[first]
        return np.stack([self._back(begin, period, level), begin + period + block, period])

    def _back(self, begin: np.ndarray, period: np.ndarray, level: int) -> np.ndarray:
        """How far to the left the words agree with those a period later: by blocks of doubled length, then halved."""
        at = begin.copy()
        top = 0  # longest block that any stretch goes back by
        going = np.arange(len(at))
        while len(going):
            step = 1 << min(top, level)
            names = self.names[min(top, level)]
            fits = going[at[going] >= step]
            going = fits[names[at[fits] - step] == names[at[fits] - step + period[fits]]]
            at[going] -= step
            top += 1
        for down in range(min(top, level), -1, -1):
            step, names = 1 << down, self.names[down]
            fits = np.flatnonzero(at >= step)
            same = fits[names[at[fits] - step] == names[at[fits] - step + period[fits]]]
            at[same] -= step
        return at

    def _advance(self, squares: np.ndarray) -> None:
        """Compare the words after each square with those a period before; report those that have ended."""
        if not squares.shape[1]:
            self.open = squares
            return
        squares = np.unique(squares, axis=1)
        start, end, period = squares
        top = len(self.names) - 1
        up, going = 0, np.arange(len(end))
        while len(going):
            level = min(up, top)
            step, names = 1 << level, self.names[level]
            fits = going[end[going] + step <= self.size]
            going = fits[self._same(names, end[fits], period[fits])]
            end[going] += step
            up += 1
        for level in range(min(up, top), -1, -1):
            step, names = 1 << level, self.names[level]
            fits = np.flatnonzero(end + step <= self.size)
            end[fits[self._same(names, end[fits], period[fits])]] += step
        ended = end < self.size
        long = end - start >= np.maximum(2 * period, self.min_length)
        self.closed.append(squares[:, ended & long])
        # an open square that began the same way is the same one
        self.open = np.unique(squares[:, ~ended], axis=1)

    @staticmethod
    def _same(names: np.ndarray, at: np.ndarray, period: np.ndarray) -> np.ndarray:
        return names[at] == names[at - period]

    def runs(self) -> np.ndarray:
        """(start, length, period) of all runs so far, by start, then period; the text may go on afterwards."""
        long = self.open[1] - self.open[0] >= np.maximum(2 * self.open[2], self.min_length)
        all_found = np.concatenate([*self.closed, self.open[:, long]], axis=1)
        start, end, period = all_found[:, np.lexsort((all_found[2], all_found[1], all_found[0]))]
        # one stretch caught at multiples of its period counts by the smallest
        first = np.ones(len(start), bool)
        first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        start, end, period = start[first], end[first], period[first]
        order = np.lexsort((period, start))
        return np.stack([start, end - start, period])[:, order]


def _separated(words: np.ndarray, counts: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of several texts as one sequence, a word of its own kind after each text; and where texts begin.

    A separator occurs once, so no square reaches over it.
    """
    starts = np.zeros(len(counts), np.int64)
    np.cumsum(counts[:-1] + 1, out=starts[1:])
    out = tasks.mix(np.arange(seed, seed + len(words) + len(counts), dtype=np.uint64) * _ADD + np.uint64(1))
    text = np.repeat(np.arange(len(counts)), counts)
    out[np.arange(len(words)) + text] = words
    return out, starts


def _kept(runs: np.ndarray, words: int) -> np.ndarray:
    """Whether each word stays: those after a run's first period go."""
    edges = np.zeros(words + 1, np.int64)
    start, length, period = runs
    np.add.at(edges, start + period, 1)
    np.add.at(edges, start + length, -1)
    return np.cumsum(edges[:-1]) == 0


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[bytes]:
    """The words at byte ranges joined by one space, in pieces."""
    for lo in range(0, len(starts), _PIECE):
        begin, size = starts[lo:lo + _PIECE], ends[lo:lo + _PIECE] - starts[lo:lo + _PIECE] + 1
        stop = np.cumsum(size)
        take = np.repeat(begin - (stop - size), size) + np.arange(stop[-1])
        spaces = stop - 1
        take[spaces] = 0
        piece = data[take]
        piece[spaces] = 0x20
        yield piece.tobytes() if lo + _PIECE < len(starts) else piece[:-1].tobytes()


def find_runs(df: DataFrame, text: str = "text", runs: str = "runs", collapsed: str | None = "collapsed",
              collapsed_sha256: str | None = None, min_length: int = MIN_LENGTH) -> DataFrame:
    """Add the runs of each text (start, length and period in words, by start, then period).

    ``collapsed`` is the text without the words that any run holds after its
    first period, words joined by one space; ``collapsed_sha256`` the lowercase
    hex digest of that, for those who need no copy of the text.  Either may be
    None.

    Words are ``[^\\x20\\x09-\\x0D]+``.  NULL, empty and blank texts have no
    runs and collapse to the empty text.  Rows are independent: equal texts
    have equal runs, an empty table gives an empty result, other columns pass
    through.  A clash of names is an error.  A task holds one batch of texts,
    and some 100 bytes a word of at most one of them beyond 1 MB.
    """
    names = [x for x in (runs, collapsed, collapsed_sha256) if x]
    clash = {c.lower() for c in df.columns} & {x.lower() for x in names}
    if clash:
        raise ValueError(f"column exists already: {', '.join(sorted(clash))}")
    types = {runs: RUN_TYPE, collapsed: T.StringType(), collapsed_sha256: T.StringType()}

    def found_in(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[list[dict], bytes | None, str | None]]:
        rows = len(offsets) - 1
        hashed, row, starts, ends = tasks.word_hashes(data, offsets)
        counts = np.bincount(row, minlength=rows)
        sequence, begins = _separated(hashed, counts, int(hashed[0]) & 0xFFFFFFFF if len(hashed) else 0)
        catchers = SquareCatchers(min_length, int(counts.max(initial=0)))
        catchers.append(sequence)
        all_runs = catchers.runs()
        cut = np.searchsorted(all_runs[0], [*begins, len(sequence)])
        first = np.concatenate([[0], np.cumsum(counts)])
        for i in range(rows):
            mine = all_runs[:, cut[i]:cut[i + 1]].copy()
            mine[0] -= begins[i]
            a, b = starts[first[i]:first[i + 1]], ends[first[i]:first[i + 1]]
            if mine.shape[1]:
                keep = _kept(mine, len(a))
                a, b = a[keep], b[keep]
            whole, digest = [], hashlib.sha256()
            for piece in _joined(data, a, b):
                digest.update(piece)
                if collapsed:
                    whole.append(piece)
            yield ([{"start": s, "length": n, "period": q} for s, n, q in mine.T.tolist()],
                   b"".join(whole) if collapsed else None, digest.hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in tasks.chunks(batch, text):
                found = list(found_in(data, offsets))
                new = {runs: pa.array([x[0] for x in found], _ARROW_RUNS)}
                if collapsed:
                    new[collapsed] = pa.array([x[1] for x in found], pa.binary()).cast(pa.string())
                if collapsed_sha256:
                    new[collapsed_sha256] = pa.array([x[2] for x in found], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, *new.values()], [*part.schema.names, *new])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *[T.StructField(x, types[x]) for x in names]]))
