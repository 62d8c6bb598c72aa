"""Live log feed, its tail, replay for late subscribers, and link discovery on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcloom.fixed_values import FEED_TAIL
from arcloom.operators import crawl_log, frontier
from arcloom.session import cut_lineage, remove, scratch_scope
from arcloom.streaming.sinks import read_batches, write_batch

FEED_SCHEMA = "seq BIGINT, line STRING"


class FeedWriter:
    """``foreachBatch`` consumer: cleaned lines go to ``out``, the newest ``n`` also to ``tail``.

    Tails of the last ``keep`` batches stay, for those who show the newest lines
    again and again; ``replay`` finds the tail of any batch in ``out``.
    """

    def __init__(self, out: str, tail: str, n: int = FEED_TAIL, keep: int = 16) -> None:
        self.out, self.tail, self.n, self.keep = out, tail, n, max(keep, 2)

    def __call__(self, lines: DataFrame, batch_id: int) -> None:
        spark = lines.sparkSession
        write_batch(crawl_log.feed(crawl_log.parse(lines)).select("seq", "line"), self.out, batch_id)
        newest = spark.read.schema(FEED_SCHEMA).parquet(f"{self.out}/batch_id={batch_id}")
        if batch_id > 0:
            newest = newest.unionByName(spark.read.schema(FEED_SCHEMA).parquet(f"{self.tail}/batch_id={batch_id - 1}"))
        write_batch(crawl_log.tail(newest, n=self.n), self.tail, batch_id)
        remove(f"{self.tail}/batch_id={batch_id - self.keep}")


def replay(spark: SparkSession, writer: FeedWriter, upto_batch: int) -> tuple[DataFrame, DataFrame]:
    """For a subscriber that comes late: the tail as of a batch, however long ago, and the stream of all later lines.

    The tail is a top-n over the batches up to that one: each task keeps ``n`` lines.
    """
    past = read_batches(spark, writer.out, FEED_SCHEMA + ", batch_id INT").filter(F.col("batch_id") <= upto_batch)
    history = crawl_log.tail(past.drop("batch_id"), n=writer.n).orderBy("seq")
    live = (
        spark.readStream.schema(FEED_SCHEMA + ", batch_id INT").parquet(writer.out)
        .filter(F.col("batch_id") > upto_batch).drop("batch_id")
    )
    return history, live


VISITED_SCHEMA = "url STRING, parent_url STRING"


class LinkDiscovery:
    """``foreachBatch`` consumer: links nobody saw before, one folder per batch in ``visited``.

    ``edges`` of a batch: ``(src_url, dst_url)``.  Exact for any age of the
    earlier link, which a watermark could not be.
    """

    def __init__(self, visited: str) -> None:
        self.visited = visited

    def __call__(self, edges: DataFrame, batch_id: int) -> None:
        spark = edges.sparkSession
        candidates = edges.select(F.col("dst_url").alias("url"), F.col("src_url").alias("parent_url"))
        if batch_id == 0:
            found = candidates.groupBy("url").agg(F.min("parent_url").alias("parent_url"))
        else:
            seen = read_batches(spark, self.visited, VISITED_SCHEMA + ", batch_id INT")
            found = frontier.new_links(candidates, seen.filter(F.col("batch_id") < batch_id))
        with scratch_scope():  # the batch reads the folder that it adds to
            write_batch(cut_lineage(found, "links"), self.visited, batch_id)


def first_sightings(edges: DataFrame) -> DataFrame:
    """Links nobody saw before, as a stream: ``(url, parent_url)`` once per URL, exact for any age.

    ``edges`` is a stream of ``(src_url, dst_url)``.  The URLs seen are state,
    keyed by URL: a micro-batch looks up its own URLs only and reads no earlier
    output.  The parent is one of the pages of that micro-batch.  URLs known
    from elsewhere come as edges of an early batch without a source page; they
    are taken note of and not reported.  Start the stream with the RocksDB
    state store, whose keys need not fit in memory.
    """
    once = edges.select(F.col("dst_url").alias("url"), F.col("src_url").alias("parent_url")).dropDuplicates(["url"])
    return once.filter(F.col("parent_url").isNotNull())


def new_links_within(edges: DataFrame, ts: str, horizon: str) -> DataFrame:
    """Stateful variant with bounded state: a link counts as new again after ``horizon``."""
    return edges.withWatermark(ts, horizon).dropDuplicatesWithinWatermark(["dst_url"])
