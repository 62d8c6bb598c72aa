"""Crawl frontier over the page table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcloom.functions.urls import host, strip_fragment
from arcloom.operators import frontier, policies
from arcloom.operators.skew import numbered
from arcloom.plans.base import query, table


def page_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Edges from each page to the next two of its host; seeds are each host's first page."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", host("url").alias("host"))
    n = numbered(p, ["host"], "page_id", "nth")
    sources = n.select("host", F.col("url").alias("src_url"),
                       F.explode(F.array(F.col("nth") + 1, F.col("nth") + 2)).alias("nth"))
    targets = n.select("host", "nth", F.col("url").alias("dst_url"))
    edges = sources.join(targets, ["host", "nth"]).select("src_url", "dst_url")
    return edges, n.filter("nth = 1").select("url")


SQL_GRAPH = r"""p AS (
  SELECT page_id, split_part(url, '#', 1) AS url, url AS raw,
         regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages),
w AS (SELECT *, row_number() OVER h AS nth, lead(url, 1) OVER h AS n1, lead(url, 2) OVER h AS n2 FROM p
      WINDOW h AS (PARTITION BY host ORDER BY page_id)),
edges AS (SELECT url AS src, n1 AS dst FROM w WHERE n1 IS NOT NULL UNION ALL
          SELECT url, n2 FROM w WHERE n2 IS NOT NULL)"""


@query("frontier_depth", rf"""
WITH RECURSIVE {SQL_GRAPH},
reach(url, depth) AS (
  SELECT url, 0 FROM w WHERE nth = 1
  UNION
  SELECT e.dst, r.depth + 1 FROM reach r JOIN edges e ON e.src = r.url WHERE r.depth < 3)
SELECT url, min(depth) AS depth FROM reach GROUP BY url""")
def frontier_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, seeds = page_graph(spark, sf_dir)
    return frontier.crawl(edges, seeds, policies.parse_policy("3", "")).select("url", "depth")


@query("frontier_prefix", rf"""
WITH RECURSIVE {SQL_GRAPH},
reach(url) AS (
  SELECT url FROM w WHERE nth = 1
  UNION
  SELECT e.dst FROM reach r JOIN edges e ON e.src = r.url WHERE starts_with(e.dst, 'https://'))
SELECT url FROM reach""")
def frontier_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, seeds = page_graph(spark, sf_dir)
    return frontier.crawl(edges, seeds, policies.parse_policy("prefix", "https://")).select("url")


@query("frontier_progress", rf"""
WITH RECURSIVE {SQL_GRAPH},
reach(url, depth) AS (
  SELECT url, 0 FROM w WHERE nth = 1
  UNION
  SELECT e.dst, r.depth + 1 FROM reach r JOIN edges e ON e.src = r.url WHERE r.depth < 4),
least AS (SELECT url, min(depth) AS depth FROM reach GROUP BY url),
n AS (SELECT depth, count(*) AS n FROM least GROUP BY depth)
SELECT depth, CAST(sum(n) OVER (ORDER BY depth) AS BIGINT) AS have,
       CAST(coalesce(lead(n) OVER (ORDER BY depth), 0) AS BIGINT) AS pending,
       round(sum(n) OVER (ORDER BY depth) / (sum(n) OVER (ORDER BY depth) + coalesce(lead(n) OVER (ORDER BY depth), 0)), 6)
         AS done_share FROM n""")
def frontier_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, seeds = page_graph(spark, sf_dir)
    reached = frontier.crawl(edges, seeds, policies.depth_limit(4))
    return frontier.progress(reached).select("depth", "have", "pending", F.round("done_share", 6).alias("done_share"))


@query("frontier_batch", r"""
SELECT split_part(url, '#', 1) AS url, page_id % 3 AS depth FROM pages ORDER BY depth, url LIMIT 25""")
def frontier_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next 25 pages to fetch; the limit is the feature."""
    pending = table(spark, sf_dir, "pages").select(strip_fragment("url").alias("url"), (F.col("page_id") % 3).alias("depth"))
    return frontier.next_batch(pending, 25)
