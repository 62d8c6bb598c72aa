"""Commits of archives, merging by member index, archives by name, and archives of streams."""

import gzip
import os
import threading
import zlib

import pytest
from pyspark.sql import functions as F

import oracle  # noqa: F401
from arcloom.operators import dedup, records
from arcloom.plans import streams
from arcloom.session import cut_lineage, scratch_path, scratch_scope
from arcloom.sources import commits, files
from arcloom.sources.warc import member_index, read_warc, stream_warc, write_warc
from test_archives import RAW, HTTP, all_records, key


def resources(spark, texts, first=0, **more):
    rows = [("f", 0, first + i, f"urn:{first + i}", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "file_path STRING, file_seq BIGINT, record_seq BIGINT, id STRING, data STRING")
    payload = F.encode("data", "UTF-8")
    from arcloom.functions import text as X

    return records.as_records(
        df, file_path=F.col("file_path"), file_seq=F.col("file_seq"), record_seq=F.col("record_seq"), record_id=F.col("id"),
        rec_type=F.lit("resource"), target_uri=F.concat(F.lit("http://x/"), "record_seq"),
        warc_date=F.timestamp_seconds(F.lit(1600000000)), payload=payload, payload_digest=X.base32_sha1(payload))


def bodies(df):
    return [bytes(r.payload).decode() for r in df.orderBy("file_seq", "record_seq").collect()]


def test_two_writers_keep_each_others_files(spark):
    path = scratch_path(spark, "t-two")
    jobs = [threading.Thread(target=lambda n=n: write_warc(resources(spark, [f"{n}-{i}" for i in range(40)]), path, "append", partitions=3))
            for n in range(3)]
    for j in jobs:
        j.start()
    for j in jobs:
        j.join()
    assert sorted(bodies(read_warc(spark, path))) == sorted(f"{n}-{i}" for n in range(3) for i in range(40))


def test_what_is_not_committed_does_not_count(spark):
    path = scratch_path(spark, "t-abort")
    write_warc(resources(spark, ["a", "b"]), path)
    boom = resources(spark, ["c", "d"], 10).withColumn("payload", F.when(F.col("record_seq") == 11, F.raise_error(F.lit("no"))).otherwise(
        F.col("payload")).cast("binary"))
    with pytest.raises(Exception, match="no"):
        write_warc(boom, path, "append", partitions=2)
    # a writer that died leaves files and no manifest
    with files.open_output(f"{path}/{commits.job_folder('dead')}/part-0.warc.gz") as out:
        out.write(b"half a rec")
    assert bodies(read_warc(spark, path)) == ["a", "b"]
    write_warc(resources(spark, ["e"], 20), path, "append")
    assert bodies(read_warc(spark, path)) == ["a", "b", "e"]


def test_overwriting_hides_first_and_deletes_then(spark, monkeypatch):
    path = scratch_path(spark, "t-over")
    write_warc(resources(spark, ["a"]), path)
    write_warc(resources(spark, ["b"]), path, "append")
    old = files.archives_in(path)
    deleted = []
    keep = commits.discard
    monkeypatch.setattr(commits, "discard", lambda p, names: (deleted.append((commits.committed(p), names)), keep(p, names)))
    commits.commit(path, "new", [], replaces=True)
    # when the first old file goes, no reader is told of it any more
    assert deleted and all(seen == [] for seen, _ in deleted)
    assert not any(files.exists(f) for f in old) and files.archives_in(path) == []


def test_a_key_is_committed_once(tmp_path):
    path = str(tmp_path / "out")
    for job, name in (("a", "one"), ("b", "two")):
        with files.open_output(f"{path}/{name}") as out:
            out.write(b"x")
        assert commits.commit(path, job, [name], key="s-0001") == (job == "a")
    assert commits.committed(path) == ["one"] and not os.path.exists(f"{path}/two")


def test_files_are_cut_at_a_size_and_named_archives_have_their_own(spark):
    path = scratch_path(spark, "t-cut")
    texts = [os.urandom(600).hex() for _ in range(30)]
    named = resources(spark, texts).withColumn("archive", F.concat(F.lit("h/../"), F.col("record_seq") % 3))
    write_warc(named, path, partitions=1, max_file_bytes=2000)
    found = files.archives_in(path)
    folders = {f.rpartition("/")[0].rpartition("/")[2] for f in found}
    assert folders == {"h_.._0", "h_.._1", "h_.._2"} and len(found) > 9
    assert sorted(bodies(read_warc(spark, path))) == sorted(texts)


def test_old_outputs_without_manifests_are_still_read(spark, tmp_path):
    record = RAW % (len(HTTP), HTTP)
    (tmp_path / "run-00000-part-1.warc.gz").write_bytes(gzip.compress(record))
    write_warc(resources(spark, ["new"]), str(tmp_path / "sub"))
    rows = read_warc(spark, str(tmp_path)).orderBy("file_seq").collect()
    assert [bytes(r.payload) for r in rows] == [b"body", b"new"]


def foreign_archives(folder):
    """A member a record; one member for all records; an uncompressed archive."""
    def record(n, body, kind="response"):
        http = b"HTTP/1.1 200 OK\r\nN: %d\r\n\r\n" % n + body
        digest = b"sha1:" + __import__("base64").b32encode(__import__("hashlib").sha1(body).digest())
        return (b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <r%d>\r\nWARC-Target-URI: http://x/%d\r\nWARC-Date: 2020-01-01T00:00:00Z\r\n"
                b"WARC-Payload-Digest: %s\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n"
                % (kind.encode(), n, n, digest, len(http), http))
    bodies_ = [b"alpha", b"beta", b"alpha", b"x" * 5000, b"", b"beta", b"", b"x" * 5000, b"gamma"]
    rows = [record(n, b) for n, b in enumerate(bodies_)]
    (folder / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in rows[:4]))
    (folder / "b.warc.gz").write_bytes(gzip.compress(b"".join(rows[4:6])))
    (folder / "c.warc").write_bytes(b"".join(rows[6:]))
    return [str(folder / n) for n in ("a.warc.gz", "b.warc.gz", "c.warc")], bodies_


@pytest.mark.parametrize("partitions", [1, 3])
def test_merging_copies_members_as_they_are(spark, tmp_path, partitions):
    paths, texts = foreign_archives(tmp_path)
    out = scratch_path(spark, "t-merge")
    index = member_index(spark, paths, slice_bytes=60)
    places = {r.record_id: (r.member_offset, r.member_length) for r in index.collect()}
    raw = (tmp_path / "a.warc.gz").read_bytes()
    for n in range(4):
        at, length = places[f"<r{n}>"]
        assert zlib.decompress(raw[at:at + length], 31).startswith(b"WARC/1.0") and f"<r{n}>".encode() in zlib.decompress(raw[at:at + length], 31)
    assert all(places[f"<r{n}>"][1] is None for n in range(4, 9))
    lead = dedup.provenance_record(spark, "merge", "{}", when="2024-01-01 00:00:00")
    dedup.merge_into(index, out, lead, partitions=partitions)
    merged = read_warc(spark, out).orderBy("file_seq", "record_seq").collect()
    first = {}
    want = ["warcinfo"]
    for n, t in enumerate(texts):
        want.append("revisit" if t in first else "response")
        first.setdefault(t, n)
    assert [r.rec_type for r in merged] == want
    for n, (r, t) in enumerate(zip(merged[1:], texts)):
        assert r.target_uri == f"http://x/{n}" and {h.name: h.value for h in r.http_headers} == {"N": str(n)}
        if r.rec_type == "revisit":
            assert r.refers_to == f"<r{first[t]}>" and bytes(r.payload) == b""
        else:
            assert r.record_id == f"<r{n}>" and bytes(r.payload) == t
    # bytes of whole members are the same as they were
    written = b"".join(open(f.replace("file:", ""), "rb").read() for f in files.archives_in(out))
    at, length = places["<r0>"]
    end = sum(places["<r1>"])
    assert raw[at:end] in written


def test_merging_gives_the_records_that_the_plain_way_gives(spark):
    one, two, out = (scratch_path(spark, f"t-same-{n}") for n in range(3))
    write_warc(all_records(spark), one, partitions=2)
    write_warc(all_records(spark).unionByName(resources(spark, ["x", "y", "x"], 50)), two)
    plain = dedup.merge_archives(read_warc(spark, [one, two])).orderBy("file_seq", "record_seq").collect()
    dedup.merge_into(member_index(spark, [one, two]), out)
    back = read_warc(spark, out).orderBy("file_seq", "record_seq").collect()
    strip = lambda r: tuple(b"" if x is None else x for x in key(r)[:-1]) + (bytes(r.payload or b""),)
    key_ = lambda r: (r.record_id, r.rec_type, r.target_uri, r.warc_date, r.content_type, r.payload_digest, r.refers_to, r.refers_to_uri,
                      bytes(r.payload or b""))
    assert [key_(r) for r in back] == [key_(r) for r in plain]


def test_no_payload_goes_through_an_exchange(spark, tmp_path):
    paths, _ = foreign_archives(tmp_path)
    index = member_index(spark, paths)
    assert "payload" not in index.columns
    plan = dedup.merge_plan(index)
    # the column is there for revisits and is empty for what is copied
    assert plan.filter("copy_path IS NOT NULL AND payload IS NOT NULL").count() == 0
    text = plan._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in text.splitlines() if "BatchScan" in line or "Scan warc" in line]
    assert scans and not any("payload#" in line for line in scans)


def test_missing_digests_are_computed_by_the_scan(spark, tmp_path):
    (tmp_path / "n.warc.gz").write_bytes(b"".join(gzip.compress(RAW % (len(HTTP), HTTP)) for _ in range(2)))
    index = member_index(spark, str(tmp_path / "n.warc.gz"), compute_digests=True)
    digests = {r.payload_digest for r in index.collect()}
    full = read_warc(spark, str(tmp_path / "n.warc.gz"))
    from arcloom.functions import text as X

    assert digests == {r.d for r in full.select(X.base32_sha1(F.col("payload")).alias("d")).collect()}
    assert dedup.merge_plan(index).filter("copy_path IS NULL").count() == 1


def test_a_batch_that_runs_again_adds_nothing(spark):
    base = scratch_path(spark, "t-stream")
    rows = resources(spark, [f"t{i}" for i in range(12)])
    rows.filter("false").write.parquet(f"{base}/in")
    source = spark.readStream.schema(rows.schema).parquet(f"{base}/in")

    def run():
        q = stream_warc(source, f"{base}/out", f"{base}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None

    for i in range(3):
        rows.filter(F.col("record_seq") % 3 == i).write.mode("append").parquet(f"{base}/in")
        run()
        if i == 1:
            before = files.archives_in(f"{base}/out")
            streams.forget_commit(f"{base}/checkpoint")
            run()
            assert files.archives_in(f"{base}/out") == before
    assert sorted(bodies(read_warc(spark, f"{base}/out"))) == sorted(f"t{i}" for i in range(12))


def test_scopes_of_two_threads_are_apart(spark):
    """A query that ends removes its own tables only, whatever runs at the same time."""
    ready, ended = threading.Event(), threading.Event()
    seen, problems = [], []

    def slow():
        try:
            with scratch_scope():
                table = cut_lineage(spark.range(7), "slow")
                ready.set()
                assert ended.wait(60)
                seen.append(table.count())
        except Exception as e:  # noqa: BLE001
            problems.append(e)
            ready.set()

    t = threading.Thread(target=slow)
    with scratch_scope():
        cut_lineage(spark.range(3), "first")
        t.start()
        assert ready.wait(60)
        cut_lineage(spark.range(3), "second")
    ended.set()
    t.join()
    assert seen == [7] and not problems


def test_two_streams_and_a_batch_query_at_once(spark):
    """Batches of two streams and a query outside write and remove tables in turns."""
    base = scratch_path(spark, "t-scopes")
    spark.range(40).write.parquet(f"{base}/in")
    done = []

    def each(name):
        def take(df, batch_id):
            with scratch_scope():
                kept = cut_lineage(df.withColumn("n", F.col("id") * 2), name)
                for _ in range(3):
                    with scratch_scope():
                        cut_lineage(kept, f"{name}-inner").count()
                    assert kept.count() == df.count()
                done.append((name, kept.count()))
        return take

    queries = [spark.readStream.schema("id BIGINT").option("maxFilesPerTrigger", 2).parquet(f"{base}/in").writeStream.foreachBatch(
        each(name)).option("checkpointLocation", f"{base}/{name}").trigger(availableNow=True).start() for name in ("a", "b")]
    with scratch_scope():
        own = cut_lineage(spark.range(5), "own")
        for q in queries:
            q.awaitTermination()
            assert q.exception() is None
        assert own.count() == 5
    for name in ("a", "b"):
        assert sum(n for x, n in done if x == name) == 40
