"""Mixing sources to target weights over training time.

Each source has a weight and a schedule that says how its share moves while
training runs.  Per source, the integral of the schedule is its cumulative
demand: at time t it has asked for ``target * W(t) / W(1)`` words.  The source's
words stand in a fixed shuffled order, once and then once more; the word at
place c is needed at the time t at which the demand reaches c, and inverting the
demand gives every use of a document its training position.  Uses are then
range-sorted by position.

Targets: a share of all words by weight, never above ``max_repeats`` times the
source's words; what is above goes to the others by weight until none is above.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from arcloom.llm.ranking import row_numbers
from arcloom.session import cut_lineage, cut_whole

WORDS = r"[^\x20\x09-\x0D]+"
ROWS_PER_BUCKET = 20_000
# by place of the source, repeating: (time, relative weight) knots, linear in between
SCHEDULES: tuple[tuple[tuple[float, float], ...], ...] = (
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
    ((0.0, 1.5), (1.0, 0.5)),
)


def word_count(text: str = "text") -> Column:
    """Words of a text; 0 for NULL."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("bigint")


def invert_demand(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which ``share`` (0 to 1) of a schedule's integral is reached."""
    areas, total = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        if t1 <= t0 or w0 < 0 or w1 < 0:
            raise ValueError("times must rise and weights must not be negative")
        areas.append((t0, t1, w0, w1, total))
        total += (w0 + w1) / 2 * (t1 - t0)
    if total <= 0:
        raise ValueError("a schedule needs some weight")
    out = F.lit(float(knots[-1][0]))
    for t0, t1, w0, w1, before in reversed(areas):
        slope = (w1 - w0) / (t1 - t0)
        need = F.greatest(share * F.lit(total) - F.lit(before), F.lit(0.0))
        # w0 * x + slope * x**2 / 2 = need, in the form that is stable for a small slope
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * need, F.lit(0.0)))
        x = F.when(F.lit(w0) + root > 0, F.lit(2.0) * need / (F.lit(w0) + root)).otherwise(F.lit(0.0))
        reached = F.lit(before + (w0 + w1) / 2 * (t1 - t0))
        out = F.when(share * F.lit(total) <= reached, F.lit(t0) + x).otherwise(out)
    return out


def targets(sources: DataFrame, weights: Sequence[float], share: float, max_repeats: float) -> DataFrame:
    """Add ``target`` to rows (source, source_size, source_rank), one per source.

    Sources at their limit are fixed, the rest share what is left by weight,
    until nothing changes.  Every round reads three sums; at most one round per
    source, in practice a handful.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("source_rank") % len(weights) + 1).cast("int"))
    table = sources.withColumn("__w", weight).withColumn("__limit", F.col("source_size") * F.lit(float(max_repeats)))
    whole = table.agg(F.sum("source_size")).first()[0] or 0
    level, below = 0.0, -1
    while True:
        at_limit = F.col("__w") * F.lit(level) > F.col("__limit")
        capped, n, rest = table.agg(
            F.sum(F.when(at_limit, F.col("source_size"))), F.count(F.when(at_limit, 1)),
            F.sum(F.when(~at_limit, F.col("__w")))).first()
        if n == below or not rest:
            break
        below, level = n, (share * whole - max_repeats * (capped or 0)) / rest
    return table.withColumn("target", F.least("__limit", F.col("__w") * F.lit(float(level)))).drop("__w", "__limit")


def mix(df: DataFrame, weights: Sequence[float], share: float = 1.5, max_repeats: int = 2, source: str = "source",
        id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One narrow row per document: how many words the mix takes of it, and where they stand.

    Columns: id, source, ``size``, ``source_size``, ``source_rank``, ``target``,
    ``before`` (words of the source in front of it) and ``taken``.  The first
    pass takes documents in a shuffled order until the target is reached; if the
    target is beyond the source, a second pass goes on in the same order.  The
    last document of a pass may be taken in part, so a source's taken words are
    its target rounded down.

    NULL sources form one source, ranked last.  NULL texts have size 0 and are
    never taken.  Rows with equal ids are placed by their content; rows equal in
    both share a place in the order one after the other.  A source with a third
    of all rows is cut into buckets of about ``ROWS_PER_BUCKET`` rows.
    """
    narrow = cut_lineage(df.select(
        F.col(id_column), F.col(source), word_count(text).alias("size"),
        F.md5(F.concat_ws("/", F.coalesce(F.col(id_column).cast("string"), F.lit("null")),
                          F.md5(F.coalesce(F.col(text), F.lit(""))))).alias("__order"),
    ), "mix-sizes")
    by_source = narrow.groupBy(source).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("__rows"))
    ranked = row_numbers(by_source, [F.col(source).asc_nulls_last()], "source_rank", "mix-sources")
    goals = cut_lineage(targets(ranked, weights, share, max_repeats), "mix-targets")

    largest = goals.agg(F.max("__rows")).first()[0] or 0
    digits = 1
    while 16 ** digits * ROWS_PER_BUCKET < largest:
        digits += 1
    bucketed = narrow.withColumn("__bucket", F.substring("__order", 1, digits))
    sums = bucketed.groupBy(source, "__bucket").agg(F.sum("size").alias("__words"))
    ahead = Window.partitionBy(source).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(source, "__bucket", F.coalesce(F.sum("__words").over(ahead), F.lit(0)).alias("__start"))
    facts = starts.alias("s").join(goals.alias("g"), F.col(f"s.{source}").eqNullSafe(F.col(f"g.{source}"))).select(
        F.col(f"s.{source}").alias("__source"), F.col("s.__bucket").alias("__in"), "__start", "source_size",
        "source_rank", "target")
    inside = Window.partitionBy(source, "__bucket").orderBy("__order", "size").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = bucketed.withColumn("__inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        facts, F.col(source).eqNullSafe(F.col("__source")) & (F.col("__bucket") == F.col("__in")))
    goal, before = F.floor("target"), F.col("__start") + F.col("__inside")
    taken = F.lit(0)
    for turn in range(max_repeats):
        left = goal - before - F.col("source_size") * F.lit(turn)
        taken = taken + F.least(F.col("size"), F.greatest(left, F.lit(0)))
    return placed.select(id_column, source, "size", "source_size", "source_rank", "target", before.alias("before"),
                         taken.cast("bigint").alias("taken"), "__order")


def uses(mixed: DataFrame, max_repeats: int = 2, schedules: Sequence = SCHEDULES) -> DataFrame:
    """One row per use of a document: ``turn``, ``words`` it gives, and its training ``position`` (0 to 1).

    Of a use that is cut short, the first ``words`` words count.
    """
    rows = mixed.filter("taken > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
    rows = rows.withColumn("words", F.least(F.col("size"), F.col("taken") - F.col("size") * F.col("turn")))
    place = F.col("before") + F.col("source_size") * F.col("turn")
    share = F.least(place / F.col("target"), F.lit(1.0))
    kind = F.col("source_rank") % len(schedules)
    position = F.lit(None).cast("double")
    for i, knots in enumerate(schedules):
        position = F.when(kind == i, invert_demand(share, knots)).otherwise(position)
    return rows.filter("words > 0").withColumn("position", position)


def plan(df: DataFrame, weights: Sequence[float], share: float = 1.5, max_repeats: int = 2, schedules: Sequence = SCHEDULES,
         source: str = "source", id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One narrow row per document with what the mix takes of it, and when.

    The columns of ``mix``, with ``taken`` summed over the document's uses, and
    ``first_position`` and ``last_position`` (training positions of its first
    and last use, 0 to 1) and ``first_rank`` (place of the first use in the
    whole training order, from 0); NULL for documents that are not used.  The
    order is that of ``schedule``: by position, then the fixed shuffle.
    """
    mixed = cut_whole(lambda: mix(df, weights, share, max_repeats, source, id_column, text), df.sparkSession, "mix-rows")
    narrow = uses(mixed, max_repeats, schedules).select("__order", "source_rank", "before", "turn", "words", "position")
    ranked = row_numbers(narrow, [F.col("position"), F.col("__order"), F.col("turn")], "__rank", "mix-order")
    # equal rows of a source stand one after the other, so an order and a place name a document
    key = ["__order", "source_rank", "before"]
    when = ranked.groupBy(*key).agg(F.sum("words").alias("__words"), F.min("position").alias("first_position"),
                                    F.max("position").alias("last_position"), F.min("__rank").alias("first_rank"))
    # documents without words share a place with the next one and are never used
    used = mixed.withColumn("__order", F.when(F.col("taken") > 0, F.col("__order")))
    return used.join(when, key, "left").withColumn("taken", F.coalesce("__words", F.lit(0)).cast("bigint")).drop("__words", "__order")


def schedule(df: DataFrame, weights: Sequence[float], share: float = 1.5, max_repeats: int = 2,
             schedules: Sequence = SCHEDULES, source: str = "source", id_column: str = "doc_id",
             text: str = "text") -> DataFrame:
    """The mixed corpus itself: rows of ``df``, repeated as the mix says, in training order.

    Keeps the columns of ``df``; a use that is cut short keeps the text's first words.
    Sizes are those of the rows of ``df``; the text is moved twice: to meet its
    uses and to be range-sorted by position.
    """
    if clash := {"words", "size", "before", "turn", "position"} & {c.lower() for c in df.columns}:
        df, names = df.select(*[F.col(c).alias(f"__own_{c}" if c.lower() in clash else c) for c in df.columns]), df.columns
        out = schedule(df, weights, share, max_repeats, schedules, source, id_column, text)
        return out.toDF(*names)
    mixed = cut_whole(lambda: uses(mix(df, weights, share, max_repeats, source, id_column, text), max_repeats, schedules)
                      .select("__order", "words", "size", "before", "turn", "position"), df.sparkSession, "mix-uses")
    key = F.md5(F.concat_ws("/", F.coalesce(F.col(id_column).cast("string"), F.lit("null")),
                            F.md5(F.coalesce(F.col(text), F.lit("")))))
    rows, on = df.withColumn("__order", key), ["__order"]
    repeated = mixed.groupBy("__order", "turn").count().filter("count > 1").limit(1).count()
    if repeated:  # ids that repeat with their text: number the rows of each, so that each meets its own uses
        on = ["__order", "__copy"]
        rows = rows.withColumn("__copy", F.row_number().over(
            Window.partitionBy("__order").orderBy(F.xxhash64(*[F.col(c) for c in df.columns]))))
        mixed = mixed.withColumn("__copy", F.row_number().over(
            Window.partitionBy("__order", "turn").orderBy("before")))
    first_words = F.call_function("regexp_extract", F.col(text), F.concat(
        F.lit(r"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+){"), F.col("words").cast("string"),
        F.lit("}+")), F.lit(0))
    out = rows.join(mixed, on).withColumn(text, F.when(F.col("words") < F.col("size"), first_words)
                                          .otherwise(F.col(text)))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (out.repartitionByRange(parts, "position", "__order", "turn")
            .sortWithinPartitions("position", "__order", "turn").select(*df.columns))
