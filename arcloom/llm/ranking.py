"""Dense global row numbers without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcloom.session import cut_lineage

ROWS_PER_RANGE = 1_000_000


def row_numbers(df: DataFrame, order: Sequence[Column], name: str, label: str) -> DataFrame:
    """Add the 0-based position of each row in the total order ``order``.

    Rows are range-partitioned and sorted; a row's id then holds its partition
    and its place in it.  What is broadcast is one count per partition.  Rows
    that tie in ``order`` take adjacent numbers; the place of a row in the
    input is the last range key, so many equal rows spread over partitions.

    The result is read back from a written table, so its numbers stay as they
    are however often a lost task is run again.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("__tie", F.monotonically_increasing_id())
    placed = (
        keyed.repartitionByRange(parts, *order, "__tie")
        .sortWithinPartitions(*order, "__tie")
        .drop("__tie")
        .withColumn("__place", F.monotonically_increasing_id())
    )
    placed = cut_lineage(placed, label)
    part, within = F.expr("shiftright(__place, 33)"), F.expr("__place & 8589934591L")
    counts = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__rows"))
    # as many rows as there are partitions: a running sum on the driver is bounded by the setting
    counted = counts.orderBy("__part").toArrow()
    rows = counted.column("__rows").to_numpy()
    # from Arrow, as a list of rows would pass through Python processes of the executors
    bases = spark.createDataFrame(pa.table({"__part": counted.column("__part"), "__base": pa.array(np.cumsum(rows) - rows, pa.int64())}))
    return (
        placed.withColumn("__part", part)
        .join(F.broadcast(bases), "__part")
        .withColumn(name, F.col("__base") + within)
        .drop("__part", "__base", "__place")
    )
