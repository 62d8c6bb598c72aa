"""Byte-level BPE: encoding with offsets, and decoding.

The ``tokenizers`` library merges; its model is built from a rank file (one
base64 token and its rank a line).  Byte-level models work on text in which each
byte stands as one printable character; the table below maps bytes to those
characters, and decoding reverses it.

* Each match of the splitting pattern is encoded by itself, without special tokens.
* Pieces are looked up before they are encoded: natural text repeats its words,
  and a task keeps those met last, about twice ``CACHE_PIECES`` at most.  What is
  kept is the bytes of the ids, so the ids of a text are its pieces' joined.
* New pieces go to the library many in one string, each behind a character that
  stands for no byte and is in no merge, so nothing merges across pieces.
* Offsets: a token is a run of bytes, and may start or end inside a character.
  ``starts`` holds the character each token's first byte belongs to.

NULL text is empty: no tokens, no bytes.  Extra columns pass through ``encode``
and ``decode`` untouched; names of new columns are parameters, and a clash with
an existing column is an error rather than a silent replacement.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcloom.llm import tasks
from arcloom.session import share

CACHE_PIECES = 50_000
CACHE_PIECE_CHARS = 64  # longer pieces are encoded but not kept
ENCODE_ROWS = 256  # rows encoded together
ENCODE_PIECES = 2_000  # new pieces encoded together
JOINED_PIECES = 64  # new pieces in one string
BARRIER = "\u0200"  # after all characters that stand for bytes


def byte_characters() -> list[str]:
    """The printable character of each byte: itself where it is printable, else the next unused one from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file by id; ids must be gapless."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}
    tokens = [b""] * len(ranks)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


class Codec:
    """Encoder and decoder of one vocabulary; built once per task process."""

    def __init__(self, tokens: list[bytes], pattern: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer, models

        self.tokens = tokens
        self.find = regex.compile(pattern).findall
        to_char = byte_characters()
        # UTF-8 has no byte 0xFF, so it is free to mark where a piece begins
        self._to_char = "".join(to_char[:255]) + BARRIER
        self._to_byte = {ord(c): b for b, c in enumerate(to_char)}
        named = ["".join(to_char[b] for b in token) for token in tokens]
        known = dict(zip(tokens, named, strict=True))
        # a pair may merge whenever its joined bytes are a token, whichever way it was cut; pairs share the names
        merges = [(known[token[:i]], known[token[i:]]) for token in tokens
                  for i in range(1, len(token)) if token[:i] in known and token[i:] in known]
        vocab = {x: i for i, x in enumerate([*named, BARRIER])}
        self._encoder = Tokenizer(models.BPE(vocab=vocab, merges=merges, cache_capacity=0))
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        # decoding reads the characters of the vocabulary back through the reversed table
        self.pieces = [bytes(self._to_byte[ord(c)] for c in name) for name in named]
        # bytes of the ids of pieces: of those met lately, and of those met before them
        self._kept: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def _encode_pieces(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        for at in range(0, len(pieces), ENCODE_PIECES):
            part = pieces[at:at + ENCODE_PIECES]
            raw = [b"\xff" + p.encode() for p in part]
            joined = [b"".join(raw[i:i + JOINED_PIECES]).decode("latin-1").translate(self._to_char)
                      for i in range(0, len(raw), JOINED_PIECES)]
            got = self._encoder.encode_batch_fast(joined, add_special_tokens=False)
            ids = np.fromiter(chain.from_iterable([x.ids for x in got]), "<u4")
            starts = np.flatnonzero(ids == len(self.tokens))
            flat, ends = ids.tobytes(), [*starts[1:].tolist(), len(ids)]
            yield from ((p, flat[4 * a + 4:4 * b]) for p, a, b in zip(part, starts.tolist(), ends, strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        found = [self.find(t) for t in texts]
        kept, older = self._kept, self._older
        new = set().union(*found).difference(kept)
        again = new & older.keys()
        kept.update(zip(again, map(older.__getitem__, again)))
        kept.update(self._encode_pieces(list(new - again)))
        out = [np.frombuffer(b"".join(map(kept.__getitem__, pieces)), "<u4") for pieces in found]
        for p in [p for p in new if len(p) > CACHE_PIECE_CHARS]:
            del kept[p]
        if len(kept) > CACHE_PIECES:  # pieces that are met again come back from the older ones
            self._older, self._kept = kept, {}
        return out

    def forget(self) -> None:
        """Drop the pieces kept: an idle worker needs no more than the vocabulary."""
        self._kept, self._older = {}, {}

    def starts(self, text: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(character of each token's first byte, whether that byte is inside the character)."""
        at = np.zeros(len(ids), np.int64)
        np.cumsum(self.lengths[ids[:-1]], out=at[1:]) if len(ids) else None
        raw = np.frombuffer(text, np.uint8)
        lead = (raw & 0xC0) != 0x80
        return (np.cumsum(lead)[at] - 1).astype(np.int32), ~lead[at]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))

    def decode_tokens(self, ids: np.ndarray) -> list[str]:
        """Text of each token; a character split over tokens belongs to the one that completes it.

        Bytes that never form a character become U+FFFD, as in whole-text decoding.
        """
        import codecs

        step = codecs.getincrementaldecoder("utf-8")("replace")
        out = [step.decode(self.pieces[i]) for i in ids.tolist()]
        if out:
            out[-1] += step.decode(b"", True)
        return out


def _share(spark: SparkSession, path: str, pattern: str) -> tuple[Callable[[], Codec], str]:
    """Send the vocabulary to the tasks, a file of fixed size, whatever the data: (what gives a task its codec, name)."""
    tokens = read_ranks(path)
    name = "codec-" + hashlib.sha256(pattern.encode() + b"\0".join(tokens)).hexdigest()
    shared = share(spark, (tokens, pattern))
    return lambda: tasks.built(name, lambda: Codec(*shared.value)), name


def _refuse_clash(df: DataFrame, names: list[str]) -> None:
    clash = {c.lower() for c in df.columns} & {n.lower() for n in names}
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")


def _append(batch: pa.RecordBatch, **new: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *new.values()], names=[*batch.schema.names, *new])


def _id_bytes(lists: list[np.ndarray]) -> pa.Array:
    return pa.array([x.astype("<u4").tobytes() for x in lists], pa.binary())


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", starts: str | None = None,
           splits: str | None = None, decoded: str | None = None) -> DataFrame:
    """Add the token ids of ``text`` as little-endian unsigned 32-bit integers (``ids``, binary).

    ``starts`` names a column for the character at which each token starts,
    ``splits`` one for the number of tokens that start inside a character, and
    ``decoded`` one for the bytes that the ids decode to, in the same task: a
    round trip needs no second Python process with a vocabulary of its own.
    One pass without a shuffle; rows are independent of each other.
    """
    extra = [x for x in (ids, starts, splits, decoded) if x]
    _refuse_clash(df, extra)
    codec_of_task, name = _share(df.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of_task()
        for batch in batches:
            for at in range(0, batch.num_rows, ENCODE_ROWS):
                part = batch.slice(at, ENCODE_ROWS)
                texts = [t or "" for t in part.column(text).to_pylist()]
                found = codec.encode(texts)
                new = {ids: _id_bytes(found)}
                if starts or splits:
                    places = [codec.starts(t.encode(), x) for t, x in zip(texts, found, strict=True)]
                    if starts:
                        new[starts] = pa.array([p.tolist() for p, _ in places], pa.list_(pa.int32()))
                    if splits:
                        new[splits] = pa.array([int(s.sum()) for _, s in places], pa.int64())
                if decoded:
                    new[decoded] = pa.array([codec.decode_bytes(x) for x in found], pa.binary())
                yield _append(part, **new)
        codec.forget()

    fields = [T.StructField(ids, T.BinaryType())]
    fields += [T.StructField(starts, T.ArrayType(T.IntegerType()))] if starts else []
    fields += [T.StructField(splits, T.LongType())] if splits else []
    fields += [T.StructField(decoded, T.BinaryType())] if decoded else []
    return df.mapInArrow(tasks.lean(run, name), T.StructType([*df.schema.fields, *fields]))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", data: str | None = "decoded",
           tokens: str | None = None) -> DataFrame:
    """Add the bytes that ``ids`` stand for (``data``), and on request the text of each token (``tokens``).

    NULL ids decode to no bytes.  An id outside the vocabulary ends the job.
    """
    extra = [x for x in (data, tokens) if x]
    _refuse_clash(df, extra)
    codec_of_task, name = _share(df.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of_task()
        for batch in batches:
            for at in range(0, batch.num_rows, ENCODE_ROWS):
                part = batch.slice(at, ENCODE_ROWS)
                found = [np.frombuffer(x or b"", "<u4") for x in part.column(ids).to_pylist()]
                new = {}
                if data:
                    new[data] = pa.array([codec.decode_bytes(x) for x in found], pa.binary())
                if tokens:
                    new[tokens] = pa.array([codec.decode_tokens(x) for x in found], pa.list_(pa.string()))
                yield _append(part, **new)

    fields = [T.StructField(data, T.BinaryType())] if data else []
    fields += [T.StructField(tokens, T.ArrayType(T.StringType()))] if tokens else []
    return df.mapInArrow(tasks.lean(run, name), T.StructType([*df.schema.fields, *fields]))


def n_tokens(ids: str | Column = "ids") -> Column:
    return F.expr(f"octet_length(`{ids}`) div 4") if isinstance(ids, str) else F.floor(F.octet_length(ids) / 4)
