"""Bounded samples of labelled rows, the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcloom.session import cut_lineage

WARY = 1.25  # the hash threshold aims this far above the bound; the exact cut follows


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, bound: int, name: str,
                    id_column: str = "doc_id", text: str = "text", per_label: bool = False) -> DataFrame:
    """At most ``bound`` rows (text, label), of each label if ``per_label``, chosen by a hash of the id.

    ``train`` is a condition on the id.  Labels that are neither 0 nor 1, NULL
    ids and ids with both labels are not used.
    """
    usable = (
        labels.select(F.col(id_column).alias("__id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1) & F.col("__id").isNotNull())
        .groupBy("__id").agg(F.min("label").alias("label"), F.max("label").alias("__other"))
        .filter("label = __other").drop("__other")
    )
    keyed = cut_lineage(usable.withColumnRenamed("__id", id_column).filter(train)
                        .withColumn("__h", F.xxhash64(F.col(id_column), F.lit(5))), f"{name}-labels")
    # top-n by hash: each task keeps ``bound`` rows at most before anything is shuffled
    parts = [keyed.filter(F.col("label") == v).orderBy("__h", id_column).limit(bound) for v in (0, 1)] \
        if per_label else [keyed.orderBy("__h", id_column).limit(bound)]
    picked = parts[0].unionByName(parts[1]) if per_label else parts[0]
    chosen = cut_lineage(picked.select(F.col(id_column).alias("__id"), "label"), f"{name}-chosen")
    return cut_lineage(
        docs.select(F.col(id_column).alias("__id"), F.col(text).alias("text"))
        .join(F.broadcast(chosen), "__id").select(F.col("__id").alias("id"), "text", "label"), f"{name}-sample")
