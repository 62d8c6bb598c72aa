"""WARC files as a Spark data source, for reading and writing.

Reading: files are cut into slices, and small neighbours share a task.  Records
that are gzip members of their own can be entered at any member; a slice owns
the members that begin in it.  ``record_seq`` is made from the byte offset and
orders records within a file (it is not a count).

A scan with ``index`` gives heads only: where each record's gzip member is, how
long it is, and everything but the payload.

Writing: at least one file per partition and named archive, one gzip member per
record, files cut at a size.  A row that names a place in another archive is
copied from there as it is, byte range by byte range.  All files of a job, or
of a stream's batch, count from one commit on (``commits``).
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamArrowWriter,
    DataSourceStreamWriter,
    DataSourceWriter,
    EqualTo,
    In,
    InputPartition,
    WriterCommitMessage,
)

from arcloom.schema import INDEX_DDL, NAMES, ORDER, PAYLOAD_TYPES, RECORD_COLUMNS, RECORD_DDL, SPAN_KEY, HeaderNames
from arcloom.sources import commits, files
from arcloom.sources.pieces import pieces

GZIP_MAGIC = b"\x1f\x8b\x08"
CHUNK = 1 << 18
COPY_BYTES = 8 << 20  # neighbouring members are copied together up to this size
FILE_BYTES = 1 << 30  # an output file is ended once it has as much
SLICE_BYTES = 256 << 20
OPEN_BYTES = 256 << 10  # opening a file counts as reading so much, when small files are put together
BATCH_BYTES, BATCH_ROWS = 4 << 20, 1000  # records a reader has at hand before it passes them on
SEQ_SHIFT = 20  # records inside one member are numbered below its offset
SLICE_SPAN = 1 << 46  # order span of a window segment: 64 MiB of archive


def _text(raw: bytes) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def _date(value: str | None) -> datetime | None:
    if not value:
        return None
    try:
        at = datetime.fromisoformat(value.replace("Z", "+00:00"))
    except ValueError:
        return None
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


class _Member(io.RawIOBase):
    """Decompressed view of the gzip member at ``offset``; knows where the next one starts."""

    def __init__(self, fd, offset: int) -> None:
        fd.seek(offset)
        self.fd, self.inflate, self.consumed, self.next_offset = fd, zlib.decompressobj(31), offset, None
        self.cut_off = False

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        want = len(buffer)
        while self.next_offset is None:
            if self.inflate.unconsumed_tail:
                raw = self.inflate.unconsumed_tail
            else:
                raw = self.fd.read(CHUNK)
                self.consumed += len(raw)
            if not raw:
                self.next_offset, self.cut_off = self.consumed, True  # the file ends inside this member
                return 0
            out = self.inflate.decompress(raw, want)
            if self.inflate.eof:
                self.next_offset = self.consumed - len(self.inflate.unused_data)
            if out:
                buffer[: len(out)] = out
                return len(out)
        return 0


def _begins_record(fd, offset: int) -> bool:
    """Whether a gzip member with a record begins at ``offset``, however long its gzip header is."""
    fd.seek(offset)
    inflate, head = zlib.decompressobj(31), b""
    try:
        while len(head) < 5 and not inflate.eof:
            raw = inflate.unconsumed_tail or fd.read(1 << 12)
            if not raw:
                break
            head += inflate.decompress(raw, 5 - len(head))
    except zlib.error:
        return False
    return head == b"WARC/"


def _first_member(fd, start: int, end: int) -> int | None:
    """Offset of the first record-bearing member that begins in ``[start, end)``."""
    if start == 0:
        return 0
    at = start
    while at < end:
        fd.seek(at)
        window = fd.read(CHUNK)
        hit = window.find(GZIP_MAGIC)
        while hit >= 0:
            if at + hit >= end:
                return None
            if _begins_record(fd, at + hit):
                return at + hit
            hit = window.find(GZIP_MAGIC, hit + 1)
        if len(window) < len(GZIP_MAGIC):
            return None
        at += len(window) - len(GZIP_MAGIC) + 1
    return None


def _header_lines(stream) -> list[tuple[str, str]]:
    """Named fields up to the empty line; indented lines continue a value."""
    found: list[tuple[str, str]] = []
    while True:
        line = stream.readline().rstrip(b"\r\n")
        if not line:
            return found
        if line[:1] in b" \t" and found:
            name, value = found[-1]
            found[-1] = (name, f"{value} {_text(line.strip())}")
        else:
            name, _, value = _text(line).partition(":")
            found.append((name.strip(), value.strip()))


@dataclass
class _Slice(InputPartition):
    path: str
    file_seq: int
    start: int
    end: int

    def __init__(self, path: str, file_seq: int, start: int, end: int) -> None:
        super().__init__(None)
        self.path, self.file_seq, self.start, self.end = path, file_seq, start, end


@dataclass
class _Slices(InputPartition):
    """What a task reads, in order."""

    slices: list[_Slice]

    def __init__(self, slices: list[_Slice]) -> None:
        super().__init__(None)
        self.slices = slices


_PAIRS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
_ARROW = {"STRING": pa.string(), "BIGINT": pa.int64(), "TIMESTAMP": pa.timestamp("us", tz="UTC"), "BINARY": pa.binary()}
_RECORD_ARROW = pa.schema([(n, _ARROW.get(t, _PAIRS)) for n, t in RECORD_COLUMNS.items()])
_INDEX_ARROW = pa.schema([f for f in _RECORD_ARROW if f.name != "payload"] + [
    pa.field("member_offset", pa.int64()), pa.field("member_length", pa.int64())])


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    def pairs(values):
        return [v and [{"name": n, "value": x} for n, x in v] for v in values]

    return pa.RecordBatch.from_arrays(
        [pa.array(pairs(values) if f.type == _PAIRS else values, f.type) for f, values in zip(schema, zip(*rows))], schema=schema)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded size; only a single record may be larger."""
    headers, payload = schema.get_field_index("headers"), schema.get_field_index("payload")
    held: list[tuple] = []
    size = 0
    for row in rows:
        own = sum(len(n) + len(v) for n, v in row[headers]) + (len(row[payload] or b"") if payload >= 0 else 0)
        if held and (size + own > BATCH_BYTES or len(held) >= BATCH_ROWS):
            yield _arrow(held, schema)
            held, size = [], 0
        held.append(row)
        size += own
    if held:
        yield _arrow(held, schema)


class WarcReader(DataSourceReader):
    def __init__(self, options) -> None:
        listed = options.get("paths")
        self.given = json.loads(listed) if listed else [options["path"]]
        self.tasks = int(options.get("tasks", "64"))
        self.payload = options.get("payload", "true").lower() == "true"
        self.slice_bytes = int(options.get("sliceBytes", str(SLICE_BYTES)))
        self.names = HeaderNames(prefix=options.get("headerPrefix", NAMES.prefix))
        self.cut_off = options.get("cutOff", "fail")
        if self.cut_off not in ("fail", "mark"):
            raise ValueError(f"cutOff is fail or mark, not {self.cut_off!r}")
        wanted = options.get("recTypes")
        self.rec_types = set(wanted.split(",")) if wanted else None
        self.index = options.get("index", "false").lower() == "true"
        self.compute = options.get("computeDigests", "false").lower() == "true"
        if self.index:
            self.payload, self.rec_types = False, None

    def partitions(self) -> list[_Slices]:
        slices = []
        for seq, (path, size) in enumerate(f for p in self.given for f in files.sized_archives_in(p)):
            sliced = path.endswith(".gz") and self.slice_bytes > 0
            step = self.slice_bytes if sliced else max(size, 1)
            slices += [_Slice(path, seq, at, min(at + step, size)) for at in range(0, max(size, 1), step)]
        # neighbours share a task up to a slice's size, but not so many that tasks are fewer than may run at once
        share = sum(s.end - s.start + OPEN_BYTES for s in slices) // self.tasks
        limit = min(self.slice_bytes or SLICE_BYTES, max(share, OPEN_BYTES))
        out, held = [], 0
        for one in slices:
            if not out or held + one.end - one.start > limit:
                out.append(_Slices([]))
                held = 0
            out[-1].slices.append(one)
            held += one.end - one.start + OPEN_BYTES
        return out

    def read(self, part: _Slices) -> Iterator[pa.RecordBatch]:
        rows = (row for one in part.slices for row in self._slice(one))
        return _batches(rows, _INDEX_ARROW if self.index else _RECORD_ARROW)

    def _slice(self, part: _Slice) -> Iterator[tuple]:
        with files.open_input(part.path) as fd:
            if not part.path.endswith(".gz"):
                fd.seek(0)
                rows = self._records(io.BufferedReader(_Plain(fd), CHUNK), part, 0)
                yield from ((*row[:-1], 0, None) for row in rows) if self.index else rows
                return
            offset = _first_member(fd, part.start, part.end)
            while offset is not None and offset < part.end:
                member = _Member(fd, offset)
                stream = io.BufferedReader(member, CHUNK)
                rows = self._records(stream, part, offset)
                yield from self._places(rows, stream, member, offset) if self.index else rows
                while stream.read(CHUNK):
                    pass
                offset = self._boundary(fd, part, member.next_offset)

    @staticmethod
    def _places(rows: Iterator[tuple], stream, member: _Member, offset: int) -> Iterator[tuple]:
        """Heads with the member they are in; its length only if it holds nothing but one whole record."""
        first, second = next(rows, None), next(rows, None)
        if first is None:
            return
        if second is None:
            while stream.read(CHUNK):
                pass
            yield (*first[:-1], offset, None if member.cut_off else member.next_offset - offset)
            return
        yield (*first[:-1], offset, None)
        yield (*second[:-1], offset, None)
        for row in rows:
            yield (*row[:-1], offset, None)

    @staticmethod
    def _boundary(fd, part: _Slice, offset: int) -> int:
        """Check that a member begins at ``offset`` if this slice still owns it.

        A slice could begin inside an archive that is itself the stored payload
        of a record, and take its members for records of this file.  Such a
        chain ends where that payload ends, which is in the last slice that
        began inside it: failing here means wrong rows never go unnoticed.
        """
        if offset < part.end:
            fd.seek(offset)
            if fd.read(len(GZIP_MAGIC)) != GZIP_MAGIC:
                raise ValueError(f"no record boundary at {part.path}:{offset}; read it with sliceBytes=0")
        return offset

    def _records(self, stream, part: _Slice, offset: int) -> Iterator[tuple]:
        nth, line = 0, stream.readline()
        while True:
            while line in (b"\r\n", b"\n"):
                line = stream.readline()
            if not line.startswith(b"WARC/"):
                return
            fields = _header_lines(stream)
            get = {}
            for name, value in fields:
                get.setdefault(name.lower(), value)
            truncated = get.get("warc-truncated")
            skip = self.rec_types is not None and get.get("warc-type") not in self.rec_types
            given = (get.get("content-length") or "0").strip()
            if given.isascii() and given.isdigit():
                left = length = int(given)
                block = None
            else:
                # without a length the block goes on to the next record
                lines = []
                line = stream.readline()
                while line and not line.startswith(b"WARC/1."):
                    lines.append(line)
                    line = stream.readline()
                block = io.BytesIO(b"".join(lines).removesuffix(b"\r\n\r\n"))
                left = length = block.getbuffer().nbytes
                truncated = truncated or "unspecified"
            source = stream if block is None else block
            start_line = http = payload = None
            if not skip:
                if (get.get("content-type") or "").startswith("application/http") and length:
                    # a head may fill its record to the last byte, with no empty line after it
                    first = source.readline(left)
                    left -= len(first)
                    lines = []
                    while left > 0:
                        more = source.readline(left)
                        left -= len(more)
                        if not more.rstrip(b"\r\n"):
                            break
                        lines.append(more)
                    start_line = _text(first.rstrip(b"\r\n"))
                    http = _header_lines(io.BytesIO(b"".join(lines)))
                if self.payload:
                    payload = source.read(left)
                    left -= len(payload)
            digest = get.get("warc-payload-digest")
            sums = hashlib.sha1() if self.compute and digest is None and get.get("warc-type") in PAYLOAD_TYPES else None
            if sums is not None and payload is not None:
                sums.update(payload)
            while left > 0:
                got = source.read(min(left, CHUNK))
                if not got:
                    break
                left -= len(got)
                if sums is not None:
                    sums.update(got)
            if sums is not None:
                digest = "sha1:" + base64.b32encode(sums.digest()).decode()
            if left > 0:
                if self.cut_off == "fail":
                    raise ValueError(f"{part.path} ends inside a record; read it with cutOff=mark to keep what is there")
                truncated, length = truncated or "unspecified", length - left
            if block is None:
                line = stream.readline()
            if not skip:
                yield (
                    part.path, part.file_seq, (offset << SEQ_SHIFT) + nth, get.get("warc-record-id"),
                    get.get("warc-type"), get.get("warc-target-uri"), _date(get.get("warc-date")),
                    get.get("content-type"), length, digest,
                    get.get("warc-refers-to"), get.get("warc-refers-to-target-uri"),
                    _date(get.get("warc-refers-to-date")), get.get("warc-concurrent-to"),
                    get.get("warc-warcinfo-id"), truncated,
                    get.get(self.names.request_id.lower()), get.get(self.names.sub_type.lower()),
                    get.get("warc-ip-address"), fields, start_line, http, payload,
                )
            nth += 1


class _Plain(io.RawIOBase):
    def __init__(self, fd) -> None:
        self.fd = fd

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        got = self.fd.read(len(buffer))
        buffer[: len(got)] = got
        return len(got)


class WarcPushdownReader(WarcReader):
    """Takes over filters on ``rec_type``.

    Apart, because Spark refuses a reader with this method unless
    ``spark.sql.python.filterPushdown.enabled`` is on.
    """

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("rec_type",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.rec_types = values if self.rec_types is None else self.rec_types & values
            else:
                yield f


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class _Output:
    """The files a task writes: a new one for each archive name, and whenever one is full."""

    def __init__(self, path: str, job: str, max_bytes: int) -> None:
        task = TaskContext.get()
        self.path, self.max_bytes = path, max_bytes
        self.folder, self.part = commits.job_folder(job), f"{task.partitionId():06d}"
        self.attempt = task.taskAttemptId()
        self.names: list[str] = []
        self.archive: str | None = None
        self.out, self.size = None, 0
        self.pending: tuple[str, int, int] | None = None  # a range still to be copied
        self.source: tuple[str, object] | None = None

    def _file(self):
        if self.out is None or self.size >= self.max_bytes:
            self._close()
            place = f"{self.folder}/{self.archive}" if self.archive else self.folder
            name = f"{place}/part-{self.part}-{len(self.names):05d}-{self.attempt}.warc.gz"
            self.out, self.size = files.open_output(f"{self.path}/{name}"), 0
            self.names.append(name)
        return self.out

    def _close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None

    def into(self, archive: str | None) -> None:
        """What follows goes to the archive of this name."""
        archive = archive and re.sub(r"[^A-Za-z0-9._=+-]+", "_", archive).lstrip(".")
        if archive != self.archive:
            self.flush()
            self._close()
            self.archive = archive

    def member(self, record: bytes) -> None:
        self.flush()
        deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
        self._write(deflate.compress(record) + deflate.flush())

    def copy(self, path: str, offset: int, length: int) -> None:
        """Take over a member as it is; neighbours go together."""
        if self.pending:
            known, start, end = self.pending
            if known == path and end == offset and end - start + length <= COPY_BYTES:
                self.pending = (path, start, offset + length)
                return
            self.flush()
        self.pending = (path, offset, offset + length)

    def flush(self) -> None:
        if not self.pending:
            return
        path, at, end = self.pending
        self.pending = None
        if self.source is None or self.source[0] != path:
            self._leave()
            self.source = (path, files.open_input(path))
        fd = self.source[1]
        fd.seek(at)
        while at < end:
            got = fd.read(min(end - at, COPY_BYTES))
            if not got:
                raise ValueError(f"{path} is shorter than its index says")
            self._write(got)
            at += len(got)

    def _write(self, data: bytes) -> None:
        out = self._file()
        out.write(data)
        self.size += len(data)

    def _leave(self) -> None:
        if self.source is not None:
            self.source[1].close()
            self.source = None

    def finish(self) -> list[str]:
        self.flush()
        self._close()
        self._leave()
        return self.names


class _Places:
    """Whole records of other archives by place, for those that cannot be copied as a byte range."""

    def __init__(self) -> None:
        self.at: tuple[str, int] | None = None
        self.rows: Iterator[tuple] = iter(())
        self.last = -1

    def record(self, path: str, offset: int, seq: int) -> Row:
        if self.at != (path, offset) or seq <= self.last:
            self.at, self.rows = (path, offset), self._member(path, offset)
        for row in self.rows:
            self.last = row[2]
            if self.last == seq:
                return _as_row(row)
        raise ValueError(f"{path} has no record {seq}")

    @staticmethod
    def _member(path: str, offset: int) -> Iterator[tuple]:
        reader = WarcReader({"path": path, "cutOff": "mark"})
        part = _Slice(path, 0, offset, offset + 1)
        with files.open_input(path) as fd:
            if path.endswith(".gz"):
                yield from reader._records(io.BufferedReader(_Member(fd, offset), CHUNK), part, offset)
            else:
                fd.seek(0)
                yield from reader._records(io.BufferedReader(_Plain(fd), CHUNK), part, 0)


def _as_row(values: tuple) -> Row:
    return Row(**dict(zip(RECORD_COLUMNS, values, strict=True)))


_WRITTEN = ("archive", "copy_path", "copy_offset", "copy_length", "record_seq", "headers", "http_start_line", "http_headers", "payload")


def _rows(batch: pa.RecordBatch) -> Iterator[Row]:
    """What the writer takes of each row; headers become pairs."""
    def values(column: pa.Array) -> list:
        listed = column.to_pylist()
        return [v and [(h["name"], h["value"]) for h in v] for v in listed] if pa.types.is_list(column.type) else listed

    names = [c for c in _WRITTEN if c in batch.schema.names]
    row = Row(*names)
    for own in zip(*(values(batch.column(c)) for c in names)):
        yield row(*own)


class _ArchiveWriter:
    """What a task does with its rows, in a batch and on a stream."""

    def __init__(self, options) -> None:
        self.path = options["path"].rstrip("/")
        self.max_bytes = int(options.get("maxFileBytes", str(FILE_BYTES)))
        self.job = commits.new_job()

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        out, places = _Output(self.path, self.job, self.max_bytes), _Places()
        for row in (row for piece in pieces(batches, "payload") for row in _rows(piece)):
            out.into(row.archive if "archive" in row else None)
            if "copy_path" in row and row.copy_path is not None:
                if row.copy_length is not None:
                    out.copy(row.copy_path, row.copy_offset, row.copy_length)
                else:
                    out.member(_record_bytes(places.record(row.copy_path, row.copy_offset, row.record_seq)))
            else:
                out.member(_record_bytes(row))
        return _Written(out.finish())

    @staticmethod
    def _names(messages) -> list[str]:
        return [name for m in messages if m is not None for name in m.names]


class WarcWriter(_ArchiveWriter, DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool) -> None:
        super().__init__(options)
        self.overwrite = overwrite

    def commit(self, messages) -> None:
        commits.commit(self.path, self.job, self._names(messages), self.overwrite)

    def abort(self, messages) -> None:
        commits.discard(self.path, self._names(messages))


class WarcStreamWriter(_ArchiveWriter, DataSourceStreamArrowWriter):
    """One commit per batch; a batch that runs again after its commit adds nothing.

    ``stream`` names the stream where several write to one folder.
    """

    def __init__(self, options) -> None:
        super().__init__(options)
        self.stream = options.get("stream", "stream")

    def commit(self, messages, batchId: int) -> None:
        commits.commit(self.path, self.job, self._names(messages), key=f"{self.stream}-{batchId:010d}")

    def abort(self, messages, batchId: int) -> None:
        commits.discard(self.path, self._names(messages))


def _record_bytes(row) -> bytes:
    block = bytes(row.payload or b"")
    if row.http_start_line is not None:
        lines = [row.http_start_line] + [f"{n}: {v}" for n, v in row.http_headers or []]
        block = ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8") + block
    head = ["WARC/1.0"] + [f"{n}: {v}" for n, v in row.headers if n.lower() != "content-length"]
    head.append(f"Content-Length: {len(block)}")
    return ("\r\n".join(head) + "\r\n\r\n").encode("utf-8") + block + b"\r\n\r\n"


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return INDEX_DDL if self.options.get("index", "false").lower() == "true" else RECORD_DDL

    def reader(self, schema) -> DataSourceReader:
        push = self.options.get("pushdown", "false").lower() == "true"
        return WarcPushdownReader(self.options) if push else WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return WarcWriter(self.options, overwrite)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return WarcStreamWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)


def read_warc(spark: SparkSession, paths: str | list[str], payload: bool = True,
              rec_types: list[str] | None = None, slice_bytes: int = SLICE_BYTES,
              names: HeaderNames = NAMES, cut_off: str = "fail") -> DataFrame:
    """Records of archives; list position becomes ``file_seq``.

    An archive that ends inside a record ends the job; ``cut_off="mark"`` keeps
    what is there of that record, with ``truncated`` set.  A record without a
    usable length is read up to the next one and marked the same way.

    ``payload=False`` skips bodies, ``rec_types`` other record types, both
    while scanning (a Python source is not told which columns are needed).
    """
    register(spark)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format("warc").option("payload", str(payload).lower()).option("pushdown", push) \
        .option("sliceBytes", slice_bytes).option("headerPrefix", names.prefix).option("cutOff", cut_off) \
        .option("tasks", 4 * spark.sparkContext.defaultParallelism)
    if rec_types:
        reader = reader.option("recTypes", ",".join(rec_types))
    records = reader.load(paths) if isinstance(paths, str) else reader.option("paths", json.dumps(list(paths))).load()
    # record_seq is made of byte offsets: windows over it are cut every SLICE_SPAN, not every so many numbers
    return records.withColumn("record_seq", F.col("record_seq").alias("record_seq", metadata={SPAN_KEY: SLICE_SPAN}))


def member_index(spark: SparkSession, paths: str | list[str], slice_bytes: int = SLICE_BYTES, names: HeaderNames = NAMES,
                 cut_off: str = "fail", compute_digests: bool = False) -> DataFrame:
    """Heads of all records and where they are: no payload is kept, in a task or in a row.

    Besides the record columns without ``payload``: ``member_offset``, and
    ``member_length`` where a gzip member holds just this record, so that its
    bytes can be copied.  ``compute_digests`` fills missing payload digests.
    """
    register(spark)
    reader = spark.read.format("warc").option("index", "true").option("sliceBytes", slice_bytes) \
        .option("headerPrefix", names.prefix).option("cutOff", cut_off).option("computeDigests", str(compute_digests).lower()) \
        .option("tasks", 4 * spark.sparkContext.defaultParallelism)
    heads = reader.load(paths) if isinstance(paths, str) else reader.option("paths", json.dumps(list(paths))).load()
    return heads.withColumn("record_seq", F.col("record_seq").alias("record_seq", metadata={SPAN_KEY: SLICE_SPAN}))


def write_warc(records: DataFrame, path: str, mode: str = "errorifexists", partitions: int | None = None,
               max_file_bytes: int = FILE_BYTES) -> None:
    """Write records in ``(file_seq, record_seq)`` order over the files of the output.

    A column ``archive`` names the archive each record goes to: a folder of its
    own per name, whose files are cut at ``max_file_bytes``; a large archive is
    spread over tasks.  Rows with ``copy_path`` are taken over from there.
    """
    register(records.sparkSession)
    if mode == "errorifexists" and files.exists(path) and files.archives_in(path):
        raise FileExistsError(path)
    extra = [c for c in ("archive", "copy_path", "copy_offset", "copy_length") if c in records.columns]
    order = (["archive"] if "archive" in extra else []) + list(ORDER)
    ordered = records.select(*RECORD_COLUMNS, *extra)
    ordered = (
        ordered.repartitionByRange(partitions, *order) if partitions else ordered.repartitionByRange(*order)
    ).sortWithinPartitions(*order)
    ordered.write.format("warc").option("maxFileBytes", max_file_bytes).mode(
        "overwrite" if mode == "overwrite" else "append").save(path)


def stream_warc(records: DataFrame, path: str, checkpoint: str, stream: str = "stream", max_file_bytes: int = FILE_BYTES):
    """Writer of a stream of records: one commit per batch, and each batch counts once however often it is run."""
    register(records.sparkSession)
    extra = [c for c in ("archive",) if c in records.columns]
    return (
        records.select(*RECORD_COLUMNS, *extra).writeStream.format("warc").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).option("stream", stream).option("maxFileBytes", max_file_bytes)
    )
