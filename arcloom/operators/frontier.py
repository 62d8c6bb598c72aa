"""Crawl frontier: what a recursive crawl reaches over a link graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcloom.functions.urls import is_web, normalize
from arcloom.operators.skew import hot_keys
from arcloom.session import cut_lineage, remove, scratch_path, scratch_scope

LEVEL_DDL = "url STRING, parent_url STRING, status STRING"


def new_links(candidates: DataFrame, visited: DataFrame) -> DataFrame:
    """Candidate URLs nobody visited yet, one row each (``url``, ``parent_url``).

    Candidates are folded per URL map-side first, so a URL that every page
    links to reaches the join as one row.
    """
    once = candidates.groupBy("url").agg(F.min("parent_url").alias("parent_url"))
    return once.join(visited.select("url"), "url", "left_anti")


def crawl(edges: DataFrame, seeds: DataFrame, policy: Column | Callable[[DataFrame], DataFrame] | None = None,
          max_levels: int | None = None, buckets: int | None = None) -> DataFrame:
    """Breadth-first reach: ``(url, depth, parent_url, status)`` with least depths.

    ``edges``: ``(src_url, dst_url)``; ``seeds``: ``(url)``.  The policy, a
    predicate over ``url`` and ``depth`` or a function of the candidate rows,
    is not applied to seeds.  Pages are told apart by their normalised URL.  URLs of
    other schemes are listed as ``ignored`` and not followed.

    One job per level.  The link graph is stored once, bucketed by source page,
    and what is reached is a table bucketed by URL that each level adds a
    partition to: a level moves its own pages and the links found on them, and
    neither the graph nor what was reached before.  Hot pages (many out-links)
    stand apart and meet the level by a broadcast of at most ``HOT_LIMIT`` pages.
    """
    found = CrawlStore(edges.sparkSession, edges, buckets)
    try:
        return found.reach(seeds, policy, max_levels)
    finally:
        found.close()


class CrawlStore:
    """The tables of one crawl: bucketed links, links of hot pages, and what is reached."""

    def __init__(self, spark: SparkSession, edges: DataFrame, buckets: int | None = None) -> None:
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.base = scratch_path(spark, "frontier")
        name = self.base.rpartition("-")[2]
        self.links_table, self.reached_table = f"crawl_links_{name}", f"crawl_reached_{name}"
        with scratch_scope():  # links as they come, and which pages are hot
            links = cut_lineage(
                edges.select("src_url", normalize("dst_url").alias("dst_url"))
                .withColumn("src_url", normalize("src_url"))
                .filter("src_url <> dst_url"), "edges")
            hot = cut_lineage(hot_keys(links, ["src_url"]), "hot-sources")
            self.any_hot = not hot.isEmpty()
            if self.any_hot:
                hot = F.broadcast(hot)  # HOT_LIMIT rows at most
                links.join(hot, "src_url").write.parquet(f"{self.base}-hot")
                links = links.join(hot, "src_url", "left_anti")
            self._save(links, self.links_table, f"{self.base}-links", "src_url")

    def _save(self, rows: DataFrame, table: str, path: str, key: str, mode: str = "error") -> None:
        # rows of a bucket come together first, so that a task writes few files
        rows.repartition(self.buckets, key).write.mode(mode).format("parquet").bucketBy(self.buckets, key).sortBy(key).option(
            "path", path).saveAsTable(table)

    def candidates(self, level: DataFrame) -> DataFrame:
        """Links on the pages of a level: ``(url, parent_url)``.  Only the level's own rows are exchanged."""
        sources = level.filter("status = 'visited'").select(F.col("url").alias("src_url"))
        found = self.spark.table(self.links_table).join(sources, "src_url")
        if self.any_hot:
            hot = self.spark.read.schema("src_url STRING, dst_url STRING").parquet(f"{self.base}-hot")
            pages = sources.join(F.broadcast(hot.select("src_url").distinct()), "src_url", "left_semi")
            found = found.unionByName(hot.join(F.broadcast(pages), "src_url"))
        return found.select(F.col("dst_url").alias("url"), F.col("src_url").alias("parent_url"))

    def reached(self) -> DataFrame:
        return self.spark.table(self.reached_table)

    def add(self, level: DataFrame, depth: int) -> DataFrame:
        """Add a level to what is reached and read it back; its files are the level's partition."""
        status = F.when(is_web("url"), "visited").otherwise("ignored")
        rows = level.select("url", "parent_url", status.alias("status"), F.lit(depth).alias("depth"))
        writer = rows.repartition(self.buckets, "url").write.mode("append").format("parquet").partitionBy("depth").bucketBy(
            self.buckets, "url").sortBy("url").option("path", self.base)
        writer.saveAsTable(self.reached_table)
        return self.reached().filter(F.col("depth") == depth)

    def reach(self, seeds: DataFrame, policy: Column | Callable[[DataFrame], DataFrame] | None,
              max_levels: int | None) -> DataFrame:
        start = seeds.select(normalize("url").alias("url")).distinct()
        level = self.add(start.withColumn("parent_url", F.lit(None).cast("string")), 0)
        depth = 0
        while (max_levels is None or depth < max_levels) and not level.isEmpty():
            depth += 1
            found = self.candidates(level).withColumn("depth", F.lit(depth))
            if policy is not None:
                found = policy(found) if callable(policy) else found.filter(policy)
            level = self.add(new_links(found, self.reached()), depth)
        return self.spark.read.schema(LEVEL_DDL + ", depth INT").parquet(self.base).select(
            "url", "depth", "parent_url", "status")

    def close(self) -> None:
        """Drop the tables; the files of what is reached stay."""
        for table in (self.links_table, self.reached_table):
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        for part in ("links", "hot"):
            remove(f"{self.base}-{part}")


def progress(reached: DataFrame) -> DataFrame:
    """After each level: URLs done, URLs found for the next one, and the done share.

    The window runs over one row per level.
    """
    per_level = reached.groupBy("depth").agg(F.count(F.lit(1)).alias("n"))
    levels = Window.orderBy("depth")
    have = F.sum("n").over(levels.rowsBetween(Window.unboundedPreceding, 0))
    pending = F.coalesce(F.lead("n").over(levels), F.lit(0))
    return per_level.select(
        "depth", have.alias("have"), pending.alias("pending"), F.lit(0).cast("bigint").alias("running"),
        F.try_divide(have, have + pending).alias("done_share"),
    )


def next_batch(pending: DataFrame, n: int) -> DataFrame:
    """The next ``n`` pages to fetch, nearest first; a top-n, not a full sort."""
    return pending.orderBy("depth", "url").limit(n)
