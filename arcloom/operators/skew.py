"""Skew-safe building blocks shared by the operators.

Two shapes of work break when one key holds a large share of the rows: a window
that is partitioned by that key, and a shuffle join on it.  ``ordered_scan``
replaces the first, ``lookup_join`` the second.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcloom.schema import SPAN_KEY

SEGMENT_SPAN = 1 << 20  # order values per segment
HOT_LIMIT = 256  # most keys that are ever salted: bounds the broadcast
HOT_MIN_ROWS = 1_000_000  # a key below this fits one task
HOT_SAMPLE = 0.01  # share of rows looked at to find hot keys
FANOUT = 64  # tasks a hot key is spread over
NULL_FANOUT = 1 << 16  # rows without a key match nothing, so they spread freely


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Mapping[str, Column] | None = None,
    previous: Mapping[str, Column] | None = None,
    span: int | None = None,
) -> DataFrame:
    """Running sums and carried values per key, in the order of a BIGINT column.

    ``sums`` adds inclusive running sums; ``previous`` adds the last non-null
    value among strictly earlier rows.  Order values must be unique per key.

    A key is cut into segments of ``span`` order values; without ``span`` the
    order column's metadata tell it (archives carry their own, as their order
    values are byte offsets), else ``SEGMENT_SPAN`` numbers.  Windows run inside
    one segment only; what earlier segments contribute is one small row per
    segment, combined map-side and scanned in a second window.  A key holding a
    third of all rows is thus spread over as many tasks as it has segments.
    """
    sums, previous = dict(sums or {}), dict(previous or {})
    span = span or df.schema[order].metadata.get(SPAN_KEY, SEGMENT_SPAN)
    inputs = [c.alias(f"__s_{n}") for n, c in sums.items()]
    inputs += [c.alias(f"__p_{n}") for n, c in previous.items()]
    # a struct of the keys is never NULL itself and its NULL fields compare equal,
    # so windows and the join share one partitioning, NULL keys included
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    rows = df.select("*", key.alias("__key"), F.expr(f"`{order}` div {span}").alias("__seg"), *inputs)

    totals = rows.groupBy("__key", "__seg").agg(
        *[F.sum(f"__s_{n}").alias(f"__s_{n}") for n in sums],
        *[
            F.max_by(f"__p_{n}", F.when(F.col(f"__p_{n}").isNotNull(), F.col(order))).alias(f"__p_{n}")
            for n in previous
        ],
    )
    across = Window.partitionBy("__key").orderBy("__seg")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        totals.select(
            "__key",
            "__seg",
            F.row_number().over(across).alias("__nth"),
            *[F.sum(f"__s_{n}").over(before).alias(f"__cs_{n}") for n in sums],
            *[F.last(f"__p_{n}", ignorenulls=True).over(before).alias(f"__cp_{n}") for n in previous],
        )
        # the first segment of a key has nothing before it, so for keys that
        # fit one segment this side of the join is empty
        .filter("__nth > 1")
        .drop("__nth")
    )

    inside = Window.partitionBy("__key", "__seg").orderBy(order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = rows.select(
        "*",
        *[F.sum(f"__s_{n}").over(upto).alias(f"__ls_{n}") for n in sums],
        *[F.last(f"__p_{n}", ignorenulls=True).over(earlier).alias(f"__lp_{n}") for n in previous],
    )
    return local.join(carry, ["__key", "__seg"], "left").select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[
            (F.coalesce(f"__ls_{n}", F.lit(0)) + F.coalesce(f"__cs_{n}", F.lit(0))).alias(n)
            for n in sums
        ],
        *[F.coalesce(f"__lp_{n}", f"__cp_{n}").alias(n) for n in previous],
    )


def numbered(df: DataFrame, keys: Sequence[str], order: str, name: str, start: int = 1,
             span: int | None = None) -> DataFrame:
    """Consecutive numbers per key in order, like ``row_number`` but segment-wise."""
    out = ordered_scan(df, keys, order, sums={name: F.lit(1)}, span=span)
    return out.withColumn(name, (F.col(name) + F.lit(start - 1)).cast("bigint"))


def hot_keys(df: DataFrame, keys: Sequence[str], min_rows: int = HOT_MIN_ROWS,
             limit: int = HOT_LIMIT, sample: float = HOT_SAMPLE) -> DataFrame:
    """The heaviest keys, at most ``limit`` of them.

    Only steers salting, never results: a key that is missed here takes the
    ordinary way, so a sample is enough.
    """
    seen = df.select(*keys).dropna()
    if sample < 1.0:
        seen = seen.sample(fraction=sample, seed=7)
    return (
        seen.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n"))
        .filter(F.col("__n") > min_rows * sample)
        .orderBy(F.desc("__n"))
        .limit(limit)
        .select(*keys)
    )


def lookup_join(left: DataFrame, right: DataFrame, keys: Sequence[str], salt_by: Sequence[str],
                how: str = "left", hot: DataFrame | bool | None = None, fanout: int = FANOUT) -> DataFrame:
    """Join many rows to at most one row per key without overloading a task.

    ``right`` is unique on ``keys``.  Rows of a hot key are dealt over
    ``fanout`` salts by ``salt_by`` and only that key's single right row is
    copied ``fanout`` times; the list of hot keys is limited to ``HOT_LIMIT``
    rows, so broadcasting it is safe at any scale.  Rows with a NULL key would
    all land in one task of a left join; they are dealt as well.

    Finding hot keys reads a sample of ``left``, which costs a second scan of
    it; ``hot=False`` skips that where keys are nearly unique by their nature.
    """
    keys = list(keys)
    if hot is False:
        free = F.when(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys]),
                      F.pmod(F.xxhash64(*salt_by), F.lit(NULL_FANOUT)).cast("int")).otherwise(0)
        return left.withColumn("__salt", free).join(
            right.withColumn("__salt", F.lit(0)), [*keys, "__salt"], how).drop("__salt")
    hot = hot_keys(left, keys) if hot is None else hot.select(*keys).limit(HOT_LIMIT)
    hot = F.broadcast(hot.withColumn("__hot", F.lit(True)))
    keyless = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    deal = F.xxhash64(*salt_by)
    dealt = left.join(hot, keys, "left").withColumn(
        "__salt",
        F.when(F.col("__hot"), F.pmod(deal, F.lit(fanout)).cast("int"))
        .when(keyless, F.pmod(deal, F.lit(NULL_FANOUT)).cast("int"))
        .otherwise(0),
    )
    copies = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(fanout - 1))).otherwise(F.array(F.lit(0)))
    copied = right.join(hot, keys, "left").withColumn("__salt", F.explode(copies)).drop("__hot")
    return dealt.drop("__hot").join(copied, [*keys, "__salt"], how).drop("__salt")
