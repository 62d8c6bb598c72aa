"""Log records on a stream: lines batched by bytes, whatever the borders of micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcloom.fixed_values import LOG_FLUSH_BYTES
from arcloom.operators.log_batches import exact_cuts
from arcloom.operators.skew import SEGMENT_SPAN
from arcloom.session import cut_lineage, remove, scratch_scope
from arcloom.streaming.sinks import read_batches, write_batch

LINE_SCHEMA = "file_path STRING, file_seq BIGINT, seq BIGINT, line STRING"
NUMBER_SCHEMA = "file_seq BIGINT, next_batch BIGINT"
BATCH_SCHEMA = "file_path STRING, file_seq BIGINT, batch BIGINT, record_seq BIGINT, body STRING"


class LogBatcher:
    """``foreachBatch`` consumer: ``out`` gets one folder per micro-batch with the log batches that are full.

    The lines of a file's last batch, which is not full yet, are carried to the
    next micro-batch and begin its first batch there, so cuts fall where they
    fall in one pass over the whole log.  What is carried is at most the limit
    per file, and the number of its next batch.  Lines must arrive in ``seq``
    order per file across micro-batches.
    """

    def __init__(self, out: str, state: str, limit: int = LOG_FLUSH_BYTES, span: int = SEGMENT_SPAN) -> None:
        self.out, self.state, self.limit, self.span = out, state, limit, span

    def __call__(self, lines: DataFrame, batch_id: int) -> None:
        with scratch_scope():
            self._take(lines, batch_id)
        # a batch that is run again needs the state before it, and no earlier one
        for part in ("lines", "numbers"):
            remove(f"{self.state}/{part}/batch_id={batch_id - 2}")

    def _carried(self, spark: SparkSession, batch_id: int) -> tuple[DataFrame, DataFrame]:
        if batch_id < 0:
            return spark.createDataFrame([], LINE_SCHEMA), spark.createDataFrame([], NUMBER_SCHEMA)
        return (spark.read.schema(LINE_SCHEMA).parquet(f"{self.state}/lines/batch_id={batch_id}"),
                spark.read.schema(NUMBER_SCHEMA).parquet(f"{self.state}/numbers/batch_id={batch_id}"))

    def _take(self, lines: DataFrame, batch_id: int) -> None:
        held, numbers = self._carried(lines.sparkSession, batch_id - 1)
        columns = [c.split()[0] for c in LINE_SCHEMA.split(", ")]
        new = lines.select(*[F.col(c).cast(t) for c, t in (x.split() for x in LINE_SCHEMA.split(", "))])
        rows = cut_lineage(held.unionByName(new), "log-lines")
        sized = rows.select("file_seq", "seq", (F.octet_length("line") + 1).cast("bigint").alias("size"))
        cuts = cut_lineage(exact_cuts(sized, self.limit, self.span).join(sized, ["file_seq", "seq"]), "log-cuts")
        # a batch is full with the line that takes it over the limit; the last one of a file may not be
        sums = cut_lineage(cuts.groupBy("file_seq", "batch").agg(F.sum("size").alias("bytes"))
                           .withColumn("full", F.col("bytes") > self.limit), "log-sums")
        placed = rows.join(cuts.select("file_seq", "seq", "batch"), ["file_seq", "seq"]).join(
            sums.select("file_seq", "batch", "full"), ["file_seq", "batch"])
        write_batch(self._bodies(placed.filter("full"), numbers), self.out, batch_id)
        write_batch(placed.filter("NOT full").select(*columns), f"{self.state}/lines", batch_id)
        closed = sums.groupBy("file_seq").agg(F.count_if("full").alias("n"))
        after = closed.join(numbers, "file_seq", "full").select(
            "file_seq", (F.coalesce("n", F.lit(0)) + F.coalesce("next_batch", F.lit(0))).alias("next_batch"))
        write_batch(after, f"{self.state}/numbers", batch_id)

    @staticmethod
    def _bodies(placed: DataFrame, numbers: DataFrame) -> DataFrame:
        lines = F.array_sort(F.collect_list(F.struct("seq", "line")))
        return placed.groupBy("file_seq", "batch").agg(
            F.first("file_path").alias("file_path"), F.max("seq").alias("record_seq"), lines.alias("m")).join(
                numbers, "file_seq", "left").select(
                    "file_path", "file_seq", (F.col("batch") + F.coalesce("next_batch", F.lit(0))).alias("batch"), "record_seq",
                    F.concat(F.array_join(F.transform("m", lambda x: x["line"]), "\n"), F.lit("\n")).alias("body"))

    def batches(self, spark: SparkSession, last_batch_id: int | None = None) -> DataFrame:
        """All full batches so far; with the id of the last micro-batch also the begun ones, as at the end of the log."""
        full = read_batches(spark, self.out, BATCH_SCHEMA + ", batch_id INT").drop("batch_id")
        if last_batch_id is None:
            return full
        held, numbers = self._carried(spark, last_batch_id)
        return full.unionByName(self._bodies(held.withColumn("batch", F.lit(0).cast("bigint")), numbers))
