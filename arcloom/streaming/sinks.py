"""Micro-batch output that may be repeated: one folder per batch, and how to read it back."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """A batch that is run again after a failure overwrites what it wrote before."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_batches(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("basePath", path).parquet(path)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str,
                  mode: str = "append") -> StreamingQuery:
    """Process everything there is in micro-batches and stop."""
    q = (
        stream.writeStream.foreachBatch(each).outputMode(mode)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return q


def newest_per_key(batches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """State after all updates: the row of the latest batch per key."""
    values = [c for c in batches.columns if c not in keys and c != "batch_id"]
    return batches.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("s")).select(*keys, "s.*")
