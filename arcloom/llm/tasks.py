"""Helpers for work on Arrow batches inside tasks: texts as byte arrays.

A text column is looked at as one ``uint8`` array with offsets, in chunks of a
bounded number of bytes, so no Python string is made per row and a batch of
long texts never needs many times its size.  NULL texts read as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
CHUNK_ROWS = 256
GIVE_BACK_BYTES = 16 << 20  # of small groups: worked on before memory is given back

_FNV = np.uint64(0x9E3779B97F4A7C15)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)
# an odd multiplier has an inverse modulo 2**64, which lets a word's hash be cut out of a running sum
_BASE = 0x9D2C5680A3F1B7C5 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; row i is ``bytes[offsets[i]:offsets[i + 1]]``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[ends[0]:ends[-1]], ends - ends[0]


def chunks(batch: pa.RecordBatch, text: str, max_bytes: int = CHUNK_BYTES,
           max_rows: int = CHUNK_ROWS) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row ranges of a batch with their bytes and offsets; one row may exceed ``max_bytes``."""
    data, offsets = text_bytes(batch.column(text))
    at, rows = 0, batch.num_rows
    while at < rows:
        stop = int(np.searchsorted(offsets, offsets[at] + max_bytes, side="right")) - 1
        stop = min(max(stop, at + 1), at + max_rows, rows)
        yield batch.slice(at, stop - at), data[offsets[at]:offsets[stop]], offsets[at:stop + 1] - offsets[at]
        at = stop
    # a process may wait long for its next task: what the batch took besides itself goes back
    pa.default_memory_pool().release_unused()


_trim: list[Callable[[int], int] | None] = []
_worked = [0]


def give_back() -> None:
    """Return what this process holds but does not use to the system.

    Spark keeps a task's process for later tasks, and both allocators keep what
    was freed, so an idle process would stay as large as its largest batch.
    """
    if not _trim:
        try:
            _trim.append(ctypes.CDLL(None).malloc_trim)
        except (AttributeError, OSError, TypeError):  # only glibc has it
            _trim.append(None)
    if _powers and len(_powers[0]) > 2 * CHUNK_BYTES:  # tables of a very long text
        _powers.clear()
    pa.default_memory_pool().release_unused()
    if _trim[0]:
        _trim[0](0)


_built: dict[str, object] = {}


def built(name: str, make: Callable[[], object]) -> object:
    """What ``make`` returns, made once for all tasks of an operator in this process; one thing is kept at a time."""
    if name not in _built:
        drop_built()
        _built[name] = make()
        give_back()  # making it may have taken several times what it is
    return _built[name]


def drop_built(but: str | None = None) -> None:
    """Drop what tasks of another operator have built: Spark gives its processes to whatever comes next."""
    if _built and but not in _built:
        _built.clear()
        give_back()


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
         keep: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` of a ``mapInArrow`` that leaves a process with no more than it needs when its task ends.

    ``keep`` names what ``run`` has ``built``, which stays for its next task.
    """
    def run_lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_built(keep)
        yield from run(batches)
        give_back()
    return run_lean


def lean_groups(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``run`` of an ``applyInArrow`` that gives memory back whenever its groups add up to ``GIVE_BACK_BYTES``."""
    def run_lean(group: pa.Table) -> pa.Table:
        drop_built()
        _worked[0] += group.nbytes
        out = run(group)
        if _worked[0] >= GIVE_BACK_BYTES:
            _worked[0] = 0
            give_back()
        return out
    return run_lean


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The row each byte belongs to."""
    return np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, int(n).bit_length())
        tables = []
        for base in (_BASE, _BASE_INVERSE):
            table = np.empty(size, np.uint64)
            table[0] = 1
            done = 1
            while done < size:  # doubling: p[done + i] = p[i] * base**done
                step = np.uint64(pow(base, done, 1 << 64))
                table[done:2 * done] = table[:done] * step
                done *= 2
            tables.append(table)
        _powers[:] = tables
    return _powers[0][:n], _powers[1][:n]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each row: (64-bit hash, row, start byte, end byte)."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    letter = ~_SPACE[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, letter[:-1]
    row_start = offsets[:-1][offsets[:-1] < n]
    before[row_start] = False  # a row's first byte never continues the row before it
    starts = np.flatnonzero(letter & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, letter[1:]
    row_end = offsets[1:][offsets[1:] > 0] - 1
    after[row_end] = False
    ends = np.flatnonzero(letter & ~after) + 1
    power, inverse = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    hashed = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _FNV)
    row = np.searchsorted(offsets, starts, side="right") - 1
    return hashed, row, starts, ends


def shingle_hashes(words: np.ndarray, row: np.ndarray, rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words of a row: (hash, row).

    A row with 1 to ``width - 1`` words has the whole sequence as its one shingle.
    """
    counts = np.bincount(row, minlength=rows)
    first = np.zeros(rows + 1, np.int64)
    np.cumsum(counts, out=first[1:])
    n = len(words)
    whole = np.zeros(max(n - width + 1, 0), np.uint64)
    for k in range(width if len(whole) else 0):
        whole = mix(whole * _FNV + words[k:n - width + 1 + k])
    inside = row[:len(whole)] == row[width - 1:] if len(whole) else np.zeros(0, bool)
    short = np.flatnonzero((counts > 0) & (counts < width))
    value = np.zeros(len(short), np.uint64)
    for k in range(width - 1):
        has = counts[short] > k
        at = first[short[has]] + k
        value[has] = mix(value[has] * _FNV + words[at])
    value = mix(value + counts[short].astype(np.uint64))  # a short sequence is not a full one's beginning
    all_hash = np.concatenate([whole[inside], value])
    all_row = np.concatenate([row[:len(whole)][inside], short])
    order = np.argsort(all_row, kind="stable")
    return all_hash[order], all_row[order]
