import gzip
import os

import pytest
from pyspark.sql import functions as F

from arcloom.operators import crawl_log, records, screenshots
from arcloom.session import scratch_path
from arcloom.sources import warc
from arcloom.sources.warc import read_warc, write_warc
from arcloom.streaming.dispatch import Handler, dispatcher

ITEM = "file_path STRING, file_seq BIGINT, record_seq BIGINT, "


def items(spark, schema, *rows):
    return spark.createDataFrame([("f", 0, *r) for r in rows], ITEM + schema).withColumn(
        "warc_date", F.timestamp_seconds(F.lit(1600000000)))


def all_records(spark):
    yoff = records.HeaderNames().y_offset
    assert yoff == "X-Capture-Screenshot-Y-Offset"
    return records.build_records({
        "warcinfo": items(spark, "payload STRING", (0, '{"tool": "t"}'), (6, "{}")),
        "script": items(spark, "path STRING, data STRING", (1, "/a.js", "ä"), (2, None, "x")),
        "screenshot": items(spark, "url STRING, yoff INT, data BINARY", (3, "http://h/", 0, b"\x89PNG"), (7, "http://h/", 16384, b"")),
        "dom-snapshot": items(spark, "url STRING, document BINARY, viewport STRING", (4, "http://h/", b"<p>", "1x2")),
        "log": items(spark, "body STRING", (5, '{"a": "ä⇔"}\n{"b": 1}\n')),
        "unrouted": items(spark, "x STRING", (9, "y")),
    })


def by_seq(df):
    return {r.record_seq: r for r in df.collect()}


def test_builders(spark):
    r = by_seq(all_records(spark))
    assert sorted(r) == [0, 1, 2, 3, 4, 5, 6, 7]
    assert (r[0].rec_type, r[0].target_uri, bytes(r[0].payload)) == ("warcinfo", None, b'{"tool": "t"}')
    assert (r[1].rec_type, r[1].target_uri, r[1].sub_type, r[1].content_type) == (
        "resource", "file:///a.js", "script", "application/javascript; charset=utf-8")
    assert r[2].target_uri is None and r[1].content_length == 2
    assert (r[3].rec_type, r[3].sub_type, r[3].content_type) == ("conversion", "screenshot", "image/png")
    assert (r[4].rec_type, r[4].sub_type, r[4].content_type) == ("conversion", "dom-snapshot", "text/html; charset=utf-8")
    assert {h.name: h.value for h in r[4].headers}["X-Chrome-Viewport"] == "1x2"
    assert (r[5].rec_type, r[5].sub_type) == ("metadata", "log")
    assert len({x.record_id for x in r.values()}) == 8


def test_records_carry_the_id_of_the_capture_start_before_them(spark):
    recs = all_records(spark)
    for span in (2, 1 << 20):
        out = by_seq(records.with_links(recs, records.asof_warcinfo(recs, span), "warcinfo_id"))
        first, second = out[0].record_id, out[6].record_id
        assert [out[i].warcinfo_id for i in range(8)] == [None] + [first] * 6 + [second]
        headers = {h.name: h.value for h in out[4].headers}
        assert headers["WARC-Warcinfo-ID"] == first and headers["X-Chrome-Viewport"] == "1x2"
        assert len(headers) == len(out[4].headers)


def test_conversions_refer_to_the_newest_document_before(spark):
    rows = [(0, 1, "d1", "u", True, False), (0, 2, "c1", "u", False, True), (0, 3, "d2", "u", True, False), (0, 4, "c2", "u", False, True),
            (0, 5, "c3", "other", False, True), (1, 6, "c4", "u", False, True)]
    df = spark.createDataFrame(rows, "file_seq BIGINT, record_seq BIGINT, record_id STRING, target_uri STRING, doc BOOLEAN, conv BOOLEAN")
    for span in (1, 1 << 20):
        out = records.asof_document(df, F.col("doc"), F.col("conv"), span)
        assert {(r.record_id, r.refers_to) for r in out.collect()} == {("c1", "d1"), ("c2", "d2"), ("c3", None), ("c4", None)}


def key(r):
    return (r.record_id, r.rec_type, r.target_uri, r.warc_date, r.content_type, r.content_length, r.payload_digest, r.sub_type,
            tuple((h.name, h.value) for h in r.headers), r.http_start_line,
            tuple((h.name, h.value) for h in r.http_headers or ()), bytes(r.payload))


@pytest.mark.parametrize("slice_bytes", [0, 300, 1 << 20])
def test_round_trip(spark, slice_bytes):
    path = scratch_path(spark, "t-warc")
    recs = all_records(spark)
    write_warc(recs, path, partitions=3)
    back = read_warc(spark, path, slice_bytes=slice_bytes)
    rows = back.orderBy("file_seq", "record_seq").collect()
    assert [key(r) for r in rows] == [key(r) for r in recs.orderBy("record_seq").collect()]
    lines = crawl_log.log_lines_of_records(back).orderBy("line_seq").collect()
    assert [r.line for r in lines] == ['{"a": "ä⇔"}', '{"b": 1}']


def test_write_modes(spark):
    path = scratch_path(spark, "t-modes")
    recs = all_records(spark)
    write_warc(recs, path)
    with pytest.raises(FileExistsError):
        write_warc(recs, path)
    write_warc(recs, path, mode="append")
    out = read_warc(spark, path).orderBy("file_seq", "record_seq").collect()
    assert len(out) == 16 and [r.record_id for r in out[:8]] == [r.record_id for r in out[8:]]
    write_warc(recs.filter("record_seq = 0"), path, mode="overwrite")
    assert read_warc(spark, path).count() == 1


def test_scan_options(spark):
    path = scratch_path(spark, "t-scan")
    write_warc(all_records(spark), path, partitions=1)
    assert {r.rec_type for r in read_warc(spark, path, rec_types=["metadata", "conversion"]).collect()} == {"metadata", "conversion"}
    assert read_warc(spark, path, payload=False).filter("payload is not null").count() == 0
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        out = read_warc(spark, path).filter((F.col("rec_type") == "conversion") & (F.col("record_seq") >= 0))
        assert out.count() == 3
        assert read_warc(spark, path).filter(F.col("rec_type").isin("warcinfo", "metadata")).count() == 3
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


RAW = (b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nWARC-Date: 2020-01-01T00:00:00.5Z\r\nX-Long: a\r\n b\r\n"
       b"Content-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n")
HTTP = b"HTTP/1.1 200 OK\r\nA: 1\r\nA: 2\r\n\r\nbody"


def test_foreign_files(spark, tmp_path):
    raw = RAW % (len(HTTP), HTTP)
    (tmp_path / "plain.warc").write_bytes(raw * 3)
    (tmp_path / "one-member.warc.gz").write_bytes(gzip.compress(raw * 3))
    (tmp_path / "members.warc.gz").write_bytes(gzip.compress(raw) * 3)
    for name in ("plain.warc", "one-member.warc.gz", "members.warc.gz"):
        rows = read_warc(spark, str(tmp_path / name), slice_bytes=100).orderBy("record_seq").collect()
        assert len(rows) == 3 and len({r.record_seq for r in rows}) == 3, name
        r = rows[0]
        assert (r.record_id, r.http_start_line, bytes(r.payload)) == ("<x>", "HTTP/1.1 200 OK", b"body")
        assert [(h.name, h.value) for h in r.http_headers] == [("A", "1"), ("A", "2")]
        assert r.warc_date.microsecond == 500000 and ("X-Long", "a b") in {(h.name, h.value) for h in r.headers}
    names = [str(tmp_path / n) for n in ("plain.warc", "members.warc.gz")]
    listed = read_warc(spark, names[::-1]).groupBy("file_seq", "file_path").count().orderBy("file_seq").collect()
    assert [os.path.basename(r.file_path) for r in listed] == ["members.warc.gz", "plain.warc"]


def test_archive_inside_an_archive_never_gives_wrong_rows_quietly(spark, tmp_path):
    inner = gzip.compress(RAW % (len(HTTP), HTTP)) * 40
    outer = RAW % (len(inner) + len(HTTP), HTTP + inner)
    stored = gzip.compress(outer, compresslevel=0)
    path = tmp_path / "nested.warc.gz"
    path.write_bytes(stored + gzip.compress(RAW % (len(HTTP), HTTP)))
    assert read_warc(spark, str(path), slice_bytes=0).count() == 2
    with pytest.raises(Exception, match="sliceBytes=0"):
        read_warc(spark, str(path), slice_bytes=2000).count()


def test_screenshot_manifest_and_export(spark, tmp_path):
    recs = all_records(spark)
    rows = screenshots.manifest(recs, "p-", span=2).orderBy("record_seq").collect()
    assert [(r.file, r.url, r.yoff) for r in rows] == [("p-00000.png", "http://h/", 0), ("p-00001.png", "http://h/", 16384)]
    one = screenshots.manifest(recs, "p", one=True).collect()
    assert [(r.file, r.yoff) for r in one] == [("p", 0)]
    no_offset = recs.withColumn("headers", F.filter("headers", lambda h: ~h["name"].endswith("Offset")))
    assert screenshots.screenshots(no_offset).count() == 0
    assert screenshots.screenshots(recs.withColumn("content_type", F.lit("image/png; x"))).count() == 0
    prefix = str(tmp_path / "shots" / "s")
    done = screenshots.export(recs, prefix).orderBy("record_seq").collect()
    assert [r.written for r in done] == [True, True]
    assert open(done[0].file, "rb").read() == b"\x89PNG"
    assert [r.written for r in screenshots.export(recs, prefix).collect()] == [False, False]
    assert all(r.written for r in screenshots.export(recs, prefix, force=True).collect())


def test_dispatch_pushes_to_every_handler_in_turn(spark):
    seen = []
    handlers = [Handler(lambda df, i: seen.append(("all", i, df.count()))),
                Handler(lambda df, i: seen.append(("odd", i, df.count())), lambda: F.col("id") % 2 == 1)]
    dispatcher(handlers)(spark.range(5), 7)
    assert seen == [("all", 7, 5), ("odd", 7, 2)]


def test_revisits_of_revisits_are_resolved(spark):
    rows = [("a", "response", None), ("b", "revisit", "a"), ("c", "revisit", "b"), ("d", "revisit", "c"), ("e", "revisit", "d"),
            ("f", "revisit", "gone"), ("x", "revisit", "y"), ("y", "revisit", "x")]
    rows += [("b", "revisit", "elsewhere"), ("z", "revisit", "b")]  # of a repeated id the first one counts
    df = spark.createDataFrame([(0, i, *r) for i, r in enumerate(rows)],
                               "file_seq BIGINT, record_seq BIGINT, record_id STRING, rec_type STRING, refers_to STRING")
    got = sorted((r.record_id, r.resolved_id or "") for r in records.resolve_revisits(df).collect())
    assert got == [("b", "a"), ("b", "elsewhere"), ("c", "a"), ("d", "a"), ("e", "a"), ("f", "gone"), ("x", ""), ("y", ""), ("z", "a")]


def test_json_lines_stream_and_output_name(spark):
    import json

    from arcloom.operators import sinks

    path = scratch_path(spark, "t-jsonl")
    df = spark.createDataFrame([(1, b"\xc3\xa4", None), (2, None, "x")], "id INT, data BINARY, s STRING").withColumn(
        "at", F.timestamp_seconds(F.lit(1600000000)))
    df.write.parquet(path)
    s = spark.readStream.schema(df.schema).parquet(path)
    sinks.stream_json_lines(s, path + "-out", path + "-cp").trigger(availableNow=True).start().awaitTermination()
    rows = sorted((json.loads(r.value) for r in spark.read.text(path + "-out").collect()), key=lambda r: r["id"])
    assert rows == [{"id": 1, "data": "ä", "s": None, "at": "2020-09-13T12:26:40.000000Z"},
                    {"id": 2, "data": None, "s": "x", "at": "2020-09-13T12:26:40.000000Z"}]
    name = sinks.output_name("/{host}/{date}/{seqnum}.gz", F.lit("h"), F.lit("d"), F.lit(7))
    assert spark.range(1).select(name.alias("n")).first().n == "/h/d/7.gz"


def test_outputs_with_and_without_a_template(spark):
    from arcloom.operators import sinks

    pages = spark.createDataFrame([(i, f"http://{'ab'[i % 2]}.test/{i}", f"c{i % 3 // 2}") for i in range(12)], "id BIGINT, url STRING, crawl STRING")
    rows = sinks.with_output_parts(pages, "url", F.lit("d"), "id").orderBy("id").collect()
    assert [(r.host, r.seqnum) for r in rows] == [(f"{'ab'[i % 2]}.test", i + 1) for i in range(12)]
    by_crawl = {r.id: r.seqnum for r in sinks.with_output_parts(pages, "url", F.lit("d"), "id", crawl="crawl").collect()}
    assert by_crawl == {i: sum(1 for j in range(i + 1) if j % 3 // 2 == i % 3 // 2) for i in range(12)}
    path = scratch_path(spark, "t-outputs")
    parts = sinks.with_output_parts(pages.repartition(6), "url", F.lit("d"), "id")
    sinks.write_outputs(parts, path)
    for folder in ("host=a.test/date=d", "host=b.test/date=d"):
        assert len([n for n in os.listdir(f"{path}/{folder}") if n.endswith(".parquet")]) == 1
    sinks.write_outputs(parts, path, template="all")
    sinks.write_outputs(parts, path, append=True, template="all")
    assert spark.read.parquet(f"{path}/all").count() == 24
    with pytest.raises(Exception):
        sinks.write_outputs(parts, path, template="all")


# --- archives of other writers -----------------------------------------------------------


def member(record, extra=b""):
    """A gzip member with an extra field in its header."""
    import struct
    import zlib
    body = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = body.compress(record) + body.flush()
    head = b"\x1f\x8b\x08" + (b"\x04" if extra else b"\x00") + b"\0\0\0\0\0\x03"
    return head + (struct.pack("<H", len(extra)) + extra if extra else b"") + packed + struct.pack(
        "<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def raw_record(block, n, length=None, kind="application/http; msgtype=response"):
    given = len(block) if length is None else length
    return (f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: r{n}\r\nContent-Type: {kind}\r\n"
            f"Content-Length: {given}\r\n\r\n").encode() + block + b"\r\n\r\n"


def stored(tmp_path, name, data):
    path = tmp_path / name
    path.write_bytes(data)
    return str(path)


def test_members_with_long_gzip_headers_are_found_in_slices(spark, tmp_path):
    path = stored(tmp_path, "a.warc.gz", b"".join(
        member(raw_record(b"HTTP/1.1 200 OK\r\n\r\nbody %d" % i, i), extra=b"x" * 6000) for i in range(50)))
    for size in (0, 1000, 7000):
        rows = read_warc(spark, path, slice_bytes=size).collect()
        assert sorted(r.record_id for r in rows) == sorted(f"r{i}" for i in range(50))
        assert {bytes(r.payload) for r in rows} == {b"body %d" % i for i in range(50)}


@pytest.mark.parametrize("suffix", ["warc", "warc.gz"])
@pytest.mark.parametrize("payload", [True, False])
def test_heads_without_an_empty_line(spark, tmp_path, suffix, payload):
    blocks = [b"HTTP/1.1 301 Moved\r\nLocation: /x\r\n", b"HTTP/1.1 304 Same\r\nETag: 1", b"HTTP/1.1 204 None",
              b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody"]
    pack = member if suffix.endswith("gz") else bytes
    path = stored(tmp_path, f"b.{suffix}", b"".join(pack(raw_record(b, i)) for i, b in enumerate(blocks)))
    rows = {r.record_id: r for r in read_warc(spark, path, payload=payload).collect()}
    assert [rows[f"r{i}"].http_start_line for i in range(4)] == ["HTTP/1.1 301 Moved", "HTTP/1.1 304 Same", "HTTP/1.1 204 None", "HTTP/1.1 200 OK"]
    assert [[(h.name, h.value) for h in rows[f"r{i}"].http_headers] for i in range(4)] == [
        [("Location", "/x")], [("ETag", "1")], [], [("A", "b")]]
    if payload:
        assert [bytes(rows[f"r{i}"].payload) for i in range(4)] == [b"", b"", b"", b"body"]


@pytest.mark.parametrize("suffix", ["warc", "warc.gz"])
def test_archives_that_end_inside_a_record(spark, tmp_path, suffix):
    pack = member if suffix.endswith("gz") else bytes
    block = os.urandom(3000)
    data = pack(raw_record(b"first", 0, kind="text/plain")) + pack(raw_record(block, 1, kind="text/plain"))
    path = stored(tmp_path, f"c.{suffix}", data[:-1500])
    with pytest.raises(Exception, match="ends inside a record"):
        read_warc(spark, path).collect()
    rows = {r.record_id: r for r in read_warc(spark, path, cut_off="mark").collect()}
    assert (rows["r0"].truncated, bytes(rows["r0"].payload)) == (None, b"first")
    assert rows["r1"].truncated == "unspecified" and block.startswith(bytes(rows["r1"].payload))
    assert 0 < rows["r1"].content_length == len(rows["r1"].payload) < 3000


@pytest.mark.parametrize("suffix", ["warc", "warc.gz"])
def test_a_record_without_a_usable_length_is_marked(spark, tmp_path, suffix):
    pack = member if suffix.endswith("gz") else bytes
    path = stored(tmp_path, f"d.{suffix}", b"".join(
        pack(raw_record(b"text %d" % i, i, length=given, kind="text/plain")) for i, given in enumerate([None, "many", "-2", None])))
    rows = {r.record_id: r for r in read_warc(spark, path).collect()}
    assert [bytes(rows[f"r{i}"].payload) for i in range(4)] == [b"text %d" % i for i in range(4)]
    assert [rows[f"r{i}"].truncated for i in range(4)] == [None, "unspecified", "unspecified", None]


def test_page_ids_beyond_four_bytes(spark):
    rows = items(spark, "payload STRING", (0, "{}")).withColumn("file_seq", F.lit(3_000_000_000).cast("bigint"))
    assert records.build_records({"warcinfo": rows}).first().file_seq == 3_000_000_000


def test_screenshot_numbers_are_never_cut(spark):
    images = spark.range(100_002).select(
        F.lit(0).cast("bigint").alias("file_seq"), F.col("id").alias("record_seq"), F.lit("conversion").alias("rec_type"),
        F.lit("image/png").alias("content_type"), F.lit("http://h/").alias("target_uri"),
        F.array(F.struct(F.lit(records.HeaderNames().y_offset).alias("name"), F.lit("0").alias("value"))).alias("headers"))
    names = screenshots.manifest(images, "s-").select("file").distinct()
    assert names.count() == 100_002
    assert names.filter("file IN ('s-00007.png', 's-100000.png', 's-100001.png')").count() == 3


def test_windows_over_archives_have_few_segments(spark, tmp_path):
    from arcloom.schema import SPAN_KEY
    path = stored(tmp_path, "e.warc.gz", b"".join(member(raw_record(b"x", i, kind="text/plain")) for i in range(240)))
    recs = read_warc(spark, path)
    span = recs.select("file_seq", "record_seq").schema["record_seq"].metadata[SPAN_KEY]
    assert recs.select(F.expr(f"record_seq div {span}")).distinct().count() == 1
    assert records.asof_warcinfo(recs).count() == 240


def test_small_archives_share_tasks(spark):
    """Tasks grow with the bytes, not with the number of files, and carry no list of all files."""
    path = scratch_path(spark, "t-many")
    named = all_records(spark).crossJoin(spark.range(30)).withColumn("archive", F.concat(F.lit("a"), "id")).drop("id")
    write_warc(named, path)
    reader = warc.WarcReader({"path": path, "tasks": "4"})
    parts = reader.partitions()
    listed = [one.path for part in parts for one in part.slices]
    assert len(set(listed)) >= 30 and len(parts) <= 8
    assert [one.file_seq for part in parts for one in part.slices] == list(range(len(listed)))
    assert not any(listed[0] in str(v) for v in vars(reader).values())
    back = read_warc(spark, path).groupBy(F.regexp_extract("file_path", r"/(a[0-9]+)/", 1).alias("a")).count().collect()
    assert len(back) == 30 and {r["count"] for r in back} == {8}


def test_large_files_are_still_cut_into_slices(spark):
    path = scratch_path(spark, "t-cut")
    write_warc(all_records(spark), path, partitions=1)
    assert len(warc.WarcReader({"path": path, "sliceBytes": "300"}).partitions()) > 3
