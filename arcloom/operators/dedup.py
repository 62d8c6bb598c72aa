"""Merging archives: duplicate payloads become revisit records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcloom.fixed_values import JSON_MIME
from arcloom.functions import headers as H
from arcloom.functions import text as X
from arcloom.operators.records import as_records
from arcloom.operators.skew import HOT_LIMIT, HOT_MIN_ROWS, lookup_join
from arcloom.schema import NAMES, ORDER, PAYLOAD_TYPES, RECORD_COLUMNS, HeaderNames
from arcloom.session import cut_lineage
from arcloom.sources.warc import write_warc

REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def _digest_key(on_missing_digest: str) -> Column:
    """Digest of payload records, NULL for records that are never compared."""
    digest = F.col("payload_digest")
    if on_missing_digest == "compute":
        digest = F.coalesce(digest, X.base32_sha1(F.col("payload")))
    elif on_missing_digest != "unique":
        raise ValueError("on_missing_digest is 'unique' or 'compute'")
    return F.when(F.col("rec_type").isin(*PAYLOAD_TYPES), digest)


def first_by_digest(records: DataFrame, on_missing_digest: str = "unique") -> DataFrame:
    """First record of every payload in input order, and how many share it.

    A minimum over a struct that starts with the order columns: combined
    map-side, so an empty body shared by a third of all records costs one row
    per map task.
    """
    first = F.min(F.struct("file_seq", "record_seq", "record_id", "target_uri", "warc_date"))
    return (
        records.withColumn("digest_key", _digest_key(on_missing_digest))
        .filter("digest_key is not null")
        .groupBy("digest_key")
        .agg(first.alias("first"), F.count(F.lit(1)).alias("copies"))
    )


def mark_duplicates(records: DataFrame, on_missing_digest: str = "unique") -> DataFrame:
    """Add ``is_revisit`` and ``first`` (struct of the canonical record)."""
    # a digest seen once has no duplicate: only shared ones are looked up
    shared = cut_lineage(first_by_digest(records, on_missing_digest).filter("copies > 1"), "shared-digests")
    # how often each digest occurs is known by now, so no sample has to find the hot ones
    hot = shared.filter(F.col("copies") >= HOT_MIN_ROWS).orderBy(F.desc("copies")).limit(HOT_LIMIT).select("digest_key")
    keyed = records.withColumn("digest_key", _digest_key(on_missing_digest))
    found = lookup_join(keyed, shared.drop("copies"), ["digest_key"], ["file_seq", "record_seq"], hot=hot)
    itself = (F.col("first.file_seq") == F.col("file_seq")) & (F.col("first.record_seq") == F.col("record_seq"))
    return found.withColumn("is_revisit", F.coalesce(~itself, F.lit(False)))


def dedup_report(records: DataFrame, on_missing_digest: str = "unique") -> DataFrame:
    """One row: unique and revisit records and bytes, and the unique shares.

    Records count whatever their type, bytes only for payload records.  No join
    is needed for totals: of ``n`` copies, ``n - 1`` are revisits and the bytes
    of the first are the unique ones.  All buffers have fixed width, so both
    sides of the one shuffle aggregate by hash; records that are not compared
    share the NULL group, which is one row per task.
    """
    place = F.expr("CAST(file_seq AS DECIMAL(12, 0)) * 10000000000000000000BD + record_seq")
    per_payload = records.groupBy(_digest_key(on_missing_digest).alias("digest_key")).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.when(F.col("rec_type").isin(*PAYLOAD_TYPES), F.col("content_length"))), F.lit(0)).alias("bytes"),
        F.min_by("content_length", place).alias("first_bytes"),
    )
    compared = F.col("digest_key").isNotNull()
    sums = {
        "unique_records": F.when(compared, F.lit(1)).otherwise(F.col("n")),
        "unique_bytes": F.when(compared, F.col("first_bytes")).otherwise(F.col("bytes")),
        "revisit_records": F.when(compared, F.col("n") - 1),
        "revisit_bytes": F.when(compared, F.col("bytes") - F.col("first_bytes")),
    }
    total = per_payload.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()])
    ratio = lambda part: F.expr(f"try_divide(unique_{part}, unique_{part} + revisit_{part})")
    return total.select(
        "*", ratio("records").alias("ratio_records"), ratio("bytes").alias("ratio_bytes"),
    )


def replace_duplicates(marked: DataFrame, names: HeaderNames = NAMES, carry: Sequence[str] = (),
                       keep: Sequence[str] = ()) -> DataFrame:
    """Turn the duplicates in ``mark_duplicates`` output into revisit records, in one pass.

    Built fresh from target, digest, the first record and the HTTP headers;
    ``carry`` names record columns (``concurrent_to``, ``ip``, ``request_id``,
    ``warcinfo_id``, ``sub_type``) the duplicate hands on besides.  Columns in
    ``keep`` follow the record columns.
    """
    kept = {c: F.col(c) for c in carry}
    return as_records(
        marked, names,
        H.present(H.header("WARC-Profile", F.lit(REVISIT_PROFILE))),
        unless=~F.col("is_revisit"), keep=keep,
        file_path=F.col("file_path"), file_seq=F.col("file_seq"), record_seq=F.col("record_seq"),
        record_id=X.urn_uuid(F.lit("revisit"), F.col("record_id")),
        rec_type=F.lit("revisit"),
        target_uri=F.col("target_uri"), warc_date=F.col("warc_date"),
        content_type=F.lit("application/http; msgtype=response"),
        payload_digest=F.col("digest_key"),
        refers_to=F.col("first.record_id"), refers_to_uri=F.col("first.target_uri"),
        refers_to_date=F.col("first.warc_date"), truncated=F.lit("length"),
        http_start_line=F.col("http_start_line"), http_headers=F.col("http_headers"),
        **kept,
    )


def provenance_record(spark, tool: str, parameters_json: str, software_json: str = "{}", when=None,
                      names: HeaderNames = NAMES) -> DataFrame:
    """The one ``warcinfo`` row that leads a rewritten archive, ordered before all data."""
    body = f'{{"software": {software_json}, "tool": "{tool}", "parameters": {parameters_json}}}'
    row = spark.range(1).select(F.lit(body).alias("body"))
    date = F.current_timestamp() if when is None else F.lit(when).cast("timestamp")
    payload = F.encode("body", "UTF-8")
    return as_records(
        row, names, file_seq=F.lit(-1), record_seq=F.lit(0), rec_type=F.lit("warcinfo"),
        record_id=X.urn_uuid(F.lit("provenance"), F.col("body"), date.cast("string")), warc_date=date,
        content_type=F.lit(f"{JSON_MIME}; charset=utf-8"),
        payload_digest=X.base32_sha1(payload), payload=payload,
    )


def merge_archives(records: DataFrame, provenance: DataFrame | None = None, names: HeaderNames = NAMES,
                   on_missing_digest: str = "unique", carry: Sequence[str] = ()) -> DataFrame:
    """All records in one set, duplicates replaced by revisits.

    The provenance record comes first in order and is not part of the report.
    """
    merged = replace_duplicates(mark_duplicates(records, on_missing_digest), names, carry)
    return merged if provenance is None else provenance.unionByName(merged)


def merge_plan(index: DataFrame, names: HeaderNames = NAMES, carry: Sequence[str] = ()) -> DataFrame:
    """What a merged archive consists of, from a ``member_index`` of the archives: no payload is read or moved.

    A row with ``copy_path`` stands for a record that is taken over as it is,
    from ``copy_offset`` on; ``copy_length`` is NULL if that has to be cut out
    of a longer member or an uncompressed archive.  The other rows are the
    revisit records that replace duplicates.  Heads of copied records are left
    out, so that only places go through the ordering shuffle.
    """
    places = ["copy_path", "copy_offset", "copy_length"]
    marked = mark_duplicates(index.withColumn("payload", F.lit(None).cast("binary")))
    copied = ~F.col("is_revisit")
    placed = marked.withColumns({
        "copy_path": F.when(copied, F.col("file_path")),
        "copy_offset": F.when(copied, F.col("member_offset")),
        "copy_length": F.when(copied, F.col("member_length")),
    })
    merged = replace_duplicates(placed, names, carry, keep=places)
    heads = [c for c in RECORD_COLUMNS if c not in ORDER]
    return merged.select(*ORDER, *[F.when(F.col("copy_path").isNull(), F.col(c)).alias(c) for c in heads], *places)


def merge_into(index: DataFrame, path: str, provenance: DataFrame | None = None, names: HeaderNames = NAMES,
               carry: Sequence[str] = (), mode: str = "errorifexists", partitions: int | None = None) -> None:
    """Merge indexed archives into a new one: unchanged members are copied as bytes, duplicates become revisit records.

    The provenance record comes first.  Archives are read twice, for their
    heads and for the members to copy; tasks read these from the archives
    themselves.
    """
    plan = merge_plan(index, names, carry)
    if provenance is not None:
        plan = provenance.unionByName(plan, allowMissingColumns=True)
    write_warc(plan, path, mode, partitions)
