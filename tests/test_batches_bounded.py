"""Archives are read and written in batches of bounded size."""

from pyspark.sql import functions as F

from arcloom.functions import headers as H
from arcloom.operators import records
from arcloom.session import scratch_path
from arcloom.sources import warc


def test_a_reader_gives_bounded_batches(spark):
    path = scratch_path(spark, "t-bounded")
    n, size = 40, 1 << 19
    payload = F.encode(F.repeat(F.lit("x"), size), "UTF-8")
    made = records.as_records(
        spark.range(0, n, 1, 1), file_path=F.lit("f"), file_seq=F.lit(0), record_seq=F.col("id"), record_id=F.concat(F.lit("urn:"), "id"), rec_type=F.lit("response"),
        content_type=F.lit("application/http; msgtype=response"), warc_date=F.timestamp_seconds(F.lit(1704067200)), http_start_line=F.lit("HTTP/1.1 200 OK"),
        http_headers=F.array(H.header("X-Doc", F.col("id").cast("string"))), payload=payload)
    warc.write_warc(made, path, partitions=1)
    reader = warc.WarcReader({"path": path})
    batches = [b for part in reader.partitions() for b in reader.read(part)]
    assert sum(b.num_rows for b in batches) == n and len(batches) >= n * size // warc.BATCH_BYTES
    assert all(b.nbytes <= warc.BATCH_BYTES + (1 << 16) for b in batches)
    back = warc.read_warc(spark, path).select(
        H.value_of(F.col("http_headers"), "x-doc").cast("int").alias("doc"), F.octet_length("payload").alias("n"), F.unix_seconds("warc_date").alias("t"))
    assert sorted(tuple(r) for r in back.collect()) == [(i, size, 1704067200) for i in range(n)]
