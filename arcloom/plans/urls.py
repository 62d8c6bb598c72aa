"""URLs, links, policies and per-site rules over the page table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcloom.functions import urls as U
from arcloom.operators import outlinks, policies, site_rules
from arcloom.plans.base import query, table

# configuration of the rule queries
BLOCKLIST = [
    (r"^https?://([^/]+\.)?intra(net)?\.", "Private network"),
    (r"^https?://spam-farm\.", "Spam"),
    (r"^HTTP://(www|m)\.", "Plain http"),
    (r"^https?://[^/]+/de/", "Not this language"),
]
SITE_RULES = [
    {"match": r"example\.net$", "selector": [
        {"description": "Show more comments.", "selector": "a.more", "urls": ["https://www.example.net/a"]},
        {"description": "Expand threads.", "selector": "div.thread > a", "multi": True, "throttle": 500},
    ]},
    {"match": r"^(www|blog)\.", "selector": [
        {"description": "Load more.", "selector": "button.load", "urls": ["http://blog.example.org/x", "http://www.example.com/"]},
    ]},
    {"match": r"^m\.", "selector": [{"description": "Close banner.", "selector": "#close"}]},
]


@query("url_parts", r"""
SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS scheme,
       regexp_extract(url, '^https?://([^/?#]+)', 1) AS host,
       regexp_extract(url, '^https?://[^/?#]+([^#]*)', 1) AS target,
       split_part(url, '#', 1) AS no_fragment
FROM pages""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", U.scheme("url").alias("scheme"), U.host("url").alias("host"),
        U.request_target("url").alias("target"), U.strip_fragment("url").alias("no_fragment"))


@query("url_filter", r"""
WITH v AS (
  SELECT page_id, 0 AS variant, url AS u FROM pages UNION ALL
  SELECT page_id, 1, 'ftp' || substr(url, 5) FROM pages UNION ALL
  SELECT page_id, 2, regexp_extract(url, '^https?://[^/]+(.*)$', 1) FROM pages UNION ALL
  SELECT page_id, 3, 'mailto:' || page_id || '@x.example' FROM pages UNION ALL
  SELECT page_id, 4, upper(substr(url, 1, 5)) || substr(url, 6) FROM pages)
SELECT page_id, variant, regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]') AS absolute,
       regexp_matches(u, '(?i)^https?:') AS web,
       regexp_matches(u, '(?i)^https?://[^/?#]') AS valid FROM v""")
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    variants = F.array(
        F.col("url"), F.concat(F.lit("ftp"), F.substr(F.col("url"), F.lit(5))),
        F.regexp_extract("url", r"^https?://[^/]+(.*)$", 1),
        F.concat(F.lit("mailto:"), F.col("page_id"), F.lit("@x.example")),
        F.concat(F.upper(F.substring("url", 1, 5)), F.substr(F.col("url"), F.lit(6))),
    )
    return p.select("page_id", F.posexplode(variants).alias("variant", "u")).select(
        "page_id", "variant", U.is_absolute("u").alias("absolute"), U.is_web("u").alias("web"),
        U.is_valid_web_url("u").alias("valid"))


SQL_HREFS = r"""hrefs AS (
  SELECT DISTINCT page_id, url, unnest(regexp_extract_all(html, '(?i)<(?:a|area)\s[^>]*?href\s*=\s*"([^"]*)"', 1)) AS link
  FROM pages)"""


@query("link_edges", rf"""
WITH {SQL_HREFS}
SELECT page_id, link, regexp_extract(url, '^(https?://[^/?#]+)', 1) || link AS dst_url FROM hrefs""")
def link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outlinks.link_edges_native(table(spark, sf_dir, "pages")).select("page_id", "link", "dst_url")


@query("link_edges_html", rf"""
WITH {SQL_HREFS}
SELECT page_id, count(*) AS n_links FROM hrefs GROUP BY page_id""")
def link_edges_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tag walker; agrees with the pattern on how many distinct links a page has."""
    edges = outlinks.link_edges(table(spark, sf_dir, "pages"))
    return edges.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links"))


@query("link_batches", rf"""
WITH {SQL_HREFS},
n AS (SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY link) - 1 AS pos FROM hrefs)
SELECT page_id, pos // 4 AS batch, string_agg(link, ' ' ORDER BY link) AS links, count(*) AS n_links
FROM n GROUP BY page_id, pos // 4""")
def link_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = outlinks.link_batches(table(spark, sf_dir, "pages"), outlinks.hrefs("html"), size=4)
    return batches.select("page_id", F.col("batch").cast("bigint").alias("batch"),
                          F.array_join("links", " ").alias("links"), F.size("links").alias("n_links"))


@query("text_link_lines", r"""
WITH lists AS (
  SELECT page_id, unnest([url, ' ' || url, 'see ' || url, 'ftp://x.example/' || page_id,
         'https://list.example/' || page_id || '?q=1', '']) AS line FROM pages)
SELECT page_id, line AS link FROM lists WHERE regexp_matches(line, '^https?://')""")
def text_link_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(
        "\n", F.col("url"), F.concat(F.lit(" "), F.col("url")), F.concat(F.lit("see "), F.col("url")),
        F.concat(F.lit("ftp://x.example/"), F.col("page_id")),
        F.concat(F.lit("https://list.example/"), F.col("page_id"), F.lit("?q=1")), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(outlinks.text_links(text)).alias("link"))


@query("policy_filter", r"""
WITH d AS (SELECT page_id, url, page_id % 4 AS depth FROM pages),
p AS (SELECT 'none' AS policy, * FROM d WHERE depth <= 0 UNION ALL
      SELECT '2', * FROM d WHERE depth <= 2 UNION ALL
      SELECT 'prefix', * FROM d WHERE starts_with(url, 'https://www.'))
SELECT policy, page_id, depth FROM p""")
def policy_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "pages").select("page_id", "url", (F.col("page_id") % 4).alias("depth"))
    # one pass: every row lists the policies that accept it
    accepted = F.array_compact(F.array(*[
        F.when(policies.parse_policy(text, "https://www."), F.lit(text or "none"))
        for text in (None, "2", "prefix")]))
    return d.select(F.explode(accepted).alias("policy"), "page_id", "depth")


@query("blocklist", r"""
SELECT page_id, CASE WHEN regexp_matches(url, '(?i)^https?://([^/]+\.)?intra(net)?\.') THEN 'Private network'
  WHEN regexp_matches(url, '(?i)^https?://spam-farm\.') THEN 'Spam'
  WHEN regexp_matches(url, '(?i)^http://(www|m)\.') THEN 'Plain http'
  WHEN regexp_matches(url, '(?i)^https?://[^/]+/de/') THEN 'Not this language' ELSE 'accepted' END AS verdict
FROM pages""")
def blocklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.coalesce(policies.blocked_by(F.col("url"), BLOCKLIST), F.lit("accepted"))
    return table(spark, sf_dir, "pages").select("page_id", verdict.alias("verdict"))


@query("site_rules", r"""
WITH r(ordinal, pos, pattern, selector, multi, throttle) AS (VALUES
  (0, 0, 'example\.net$', 'a.more', false, 0), (0, 1, 'example\.net$', 'div.thread > a', true, 500),
  (1, 0, '^(www|blog)\.', 'button.load', false, 0), (2, 0, '^m\.', '#close', false, 0)),
p AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY ordinal, pos) - 1 AS nth, selector, multi, throttle
FROM p JOIN r ON regexp_matches(host, '(?i)' || pattern)""")
def site_rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = site_rules.selectors_for("url", SITE_RULES)
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("nth", "s")).select(
        "page_id", F.col("nth").cast("bigint").alias("nth"), "s.selector", "s.multi",
        F.coalesce("s.throttle", F.lit(0)).alias("throttle"))


@query("rule_catalogue", r"""
WITH r(ordinal, pattern, title, descriptions) AS (VALUES
  (0, 'example\.net$', 'www.example.net', 'Show more comments. / Expand threads.'),
  (1, '^(www|blog)\.', 'blog.example.org, www.example.com', 'Load more.'),
  (2, '^m\.', '^m\.', 'Close banner.')),
p AS (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages)
SELECT ordinal, title, descriptions, count(host) AS n_pages
FROM r LEFT JOIN p ON regexp_matches(host, '(?i)' || pattern) GROUP BY ALL""")
def rule_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue of the rules, with the number of pages each applies to."""
    catalogue = site_rules.rule_catalogue(site_rules.rules_frame(spark, SITE_RULES))
    hit = F.array_compact(F.array(*[
        F.when(F.rlike(U.host("url"), F.lit(f"(?i){r['match']}")), F.lit(i)) for i, r in enumerate(SITE_RULES)]))
    used = table(spark, sf_dir, "pages").select(F.explode(hit).alias("ordinal")).groupBy("ordinal").count()
    return catalogue.join(used, "ordinal", "left").select(
        "ordinal", "title", F.array_join("descriptions", " / ").alias("descriptions"),
        F.coalesce("count", F.lit(0)).alias("n_pages"))
