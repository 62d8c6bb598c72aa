"""Reproducible shuffle into shards: a Feistel permutation of global row numbers.

A keyed Feistel network permutes 0 .. 4^h - 1; numbers that leave 0 .. n - 1 are
permuted again until they are back inside (cycle walking), which makes it a
permutation of the rows.  Shard and slot follow from the permuted number by
arithmetic, so no shuffle moves a text and any row's place can be recomputed.
DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcloom.llm.ranking import row_numbers
from arcloom.session import cut_lineage

ROUNDS = 6
# at most 3/4 of the numbers are outside, so more than this many steps have a chance below 1e-62
WALK_STEPS = 500


def feistel(number: Column, rows: int, seed: int = 0, rounds: int = ROUNDS) -> Column:
    """``number`` in 0 .. rows - 1, permuted by the key ``seed``; NULL stays NULL."""
    if rows < 2:
        return number.cast("bigint")
    half = max(1, ((rows - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1

    def once(x: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            right = acc.bitwiseAND(F.lit(mask))
            scrambled = F.xxhash64(F.lit(seed).cast("bigint"), i, right).bitwiseAND(F.lit(mask))
            return F.shiftleft(right, half).bitwiseOR(F.shiftright(acc, half).bitwiseXOR(scrambled))
        return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x.cast("bigint"), step)

    size = F.lit(rows).cast("bigint")
    first = once(number)
    walked = F.when(first < size, first).otherwise(F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK_STEPS)), first, lambda acc, _: F.when(acc < size, acc).otherwise(once(acc))))
    return F.when(walked < size, walked).when(
        number.isNotNull(), F.raise_error(F.lit("no way back into the range: choose another seed")).cast("bigint"))


def shard(df: DataFrame, shards: int, id_column: str = "doc_id", text: str = "text", seed: int = 0) -> DataFrame:
    """Deal all rows of ``df`` into ``shards`` shards whose row counts differ by one at most.

    Returns the id, ``size`` (UTF-8 bytes of the text, none for NULL, plus 1),
    ``text_crc32``, ``law`` ('rows'), ``position`` (place in the shuffled order),
    ``shard`` and ``slot`` (0 .. without gaps in each shard).

    Global row numbers count rows by id, then by content; NULL ids come first.
    Rows that repeat in full get neighbouring numbers and places of their own.
    An empty table gives an empty result.  Other columns are not read.
    """
    narrow = cut_lineage(df.select(
        F.col(id_column),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("__content"),
    ), "shard-rows")
    rows = narrow.count()
    numbered = row_numbers(narrow, [F.col(id_column), F.col("size"), F.col("text_crc32"), F.col("__content")],
                           "__row", "shard-order")
    placed = numbered.withColumn("position", feistel(F.col("__row"), rows, seed))
    return placed.select(
        id_column, "size", "text_crc32", F.lit("rows").alias("law"), "position",
        F.expr(f"CAST(position % {shards} AS INT)").alias("shard"),
        F.expr(f"position div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
