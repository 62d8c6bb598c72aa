import json

import pytest
from pyspark.sql import functions as F

from arcloom.operators import frontier, policies, site_rules
from arcloom.operators.skew import hot_keys


def reach(spark, edges, seeds, policy=None, **kw):
    out = frontier.crawl(spark.createDataFrame(edges, "src_url STRING, dst_url STRING"),
                         spark.createDataFrame([(s,) for s in seeds], "url STRING"), policy, **kw)
    return {(r.url, r.depth, r.status) for r in out.collect()}


H = "http://h/"


def test_crawl_gives_least_depths_and_ends_on_cycles(spark):
    edges = [(H + "a", H + "b"), (H + "b", H + "c"), (H + "a", H + "c#x"), (H + "c", H + "a"), (H + "c", H + "d#1"),
             (H + "c", H + "d#2"), (H + "b", "mailto:m"), ("mailto:m", H + "never"), (H + "z", H + "y")]
    want = {(H + "a", 0, "visited"), (H + "b", 1, "visited"), (H + "c", 1, "visited"), (H + "d", 2, "visited"), ("mailto:m", 2, "ignored")}
    assert reach(spark, edges, [H + "a#seed"]) == want
    assert reach(spark, edges, [H + "a"], policies.depth_limit(0)) == {(H + "a", 0, "visited")}
    assert {u for u, _, _ in reach(spark, edges, [H + "a"], policies.depth_limit(1))} == {H + "a", H + "b", H + "c"}
    assert reach(spark, edges, [H + "a"], max_levels=1) == {w for w in want if w[1] < 2}


def test_policy_is_not_applied_to_the_seed(spark):
    edges = [(H + "s", "http://example.com/foo"), ("http://example.com/foo", "http://example.com/foobar"),
             ("http://example.com/foo", "http://example.com/foo/bar"), ("http://example.com/foo", "http://example.com/bar"),
             ("http://example.com/foo", "http://offsite.example/foo")]
    got = {u for u, _, _ in reach(spark, edges, [H + "s"], policies.parse_policy("prefix", "http://example.com/foo"))}
    assert got == {H + "s", "http://example.com/foo", "http://example.com/foobar", "http://example.com/foo/bar"}


def test_hot_page_is_salted(spark, monkeypatch):
    monkeypatch.setattr(frontier, "hot_keys", lambda df, keys: hot_keys(df, keys, min_rows=50, sample=1.0))
    edges = [(H + "hub", f"{H}{i}") for i in range(200)] + [(f"{H}{i}", H + "sink") for i in range(200)]
    got = reach(spark, edges, [H + "hub"])
    assert len(got) == 202 and (H + "sink", 2, "visited") in got


def test_progress_and_next_batch(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1), ("c", 1), ("d", 2)], "url STRING, depth INT")
    rows = frontier.progress(df).orderBy("depth").collect()
    assert [(r.have, r.pending) for r in rows] == [(1, 2), (3, 1), (4, 0)] and rows[-1].done_share == 1.0
    assert [r.url for r in frontier.next_batch(df, 3).collect()] == ["a", "b", "c"]


def test_policy_texts(spark):
    df = spark.createDataFrame([("http://h/a", 0), ("http://h/b", 2), ("http://x/", 1)], "url STRING, depth INT")
    keep = lambda text: [r.url for r in df.filter(policies.parse_policy(text, "http://h/")).orderBy("url").collect()]
    assert keep(None) == ["http://h/a"] and keep("1") == ["http://h/a", "http://x/"]
    assert keep("prefix") == ["http://h/a", "http://h/b"]
    with pytest.raises(ValueError):
        policies.parse_policy("everything", "http://h/")


def test_blocklist_first_rule_wins_at_the_start_of_the_url(spark):
    rules = {r"^https?://([^/]+\.)?intra(net)?\.": "Private network", "http://h": "second", "h/": "never, not at the start"}
    df = spark.createDataFrame([("http://INTRANET.test/x",), ("https://a.intra.test/",), ("http://h/",), ("https://h/",)], "url STRING")
    got = df.select("url", policies.blocked_by(F.col("url"), rules).alias("m")).collect()
    assert [r.m for r in got] == ["Private network", "Private network", "second", None]
    assert [r.url for r in policies.not_blocked(df, rules).collect()] == ["https://h/"]
    with pytest.raises(Exception):
        policies.blocked_by(F.col("url"), {"(": "x"})


RULES = [
    {"match": r"^www\.a\.example$", "selector": [{"description": "d1", "selector": "s1", "urls": ["https://www.a.example/x"]}]},
    {"match": r"a\.example", "selector": [{"description": "d2", "selector": "s2", "multi": True, "throttle": 500},
                                          {"description": "d3", "selector": "s3"}]},
]


def test_site_rules(spark):
    df = spark.createDataFrame([("http://WWW.A.example/",), ("http://a.example",), ("http://b.example/a.example",), ("nope",)], "url STRING")
    got = df.select(site_rules.selectors_for("url", RULES).alias("s")).collect()
    assert [[x.selector for x in r.s] for r in got] == [["s1", "s2", "s3"], ["s2", "s3"], [], []]
    assert got[1].s[0].multi and got[1].s[0].throttle == 500
    frame = site_rules.rules_frame(spark, RULES)
    assert [(r.title, r.descriptions) for r in site_rules.rule_catalogue(frame).orderBy("ordinal").collect()] == [
        ("www.a.example", ["d1"]), (r"a\.example", ["d2", "d3"])]
    assert site_rules.examples_match(frame).count() == 0


def test_rules_from_files(tmp_path):
    yaml_file, json_file = tmp_path / "r.yaml", tmp_path / "r.jsonl"
    yaml_file.write_text("match: ^a$\nselector:\n  - selector: s\n---\nmatch: ^b$\nselector:\n  - selector: t\n    multi: True\n")
    json_file.write_text("\n".join(json.dumps(r) for r in RULES))
    pytest.importorskip("yaml")
    assert [r["match"] for r in site_rules.load_rules(str(yaml_file))] == ["^a$", "^b$"]
    assert site_rules.load_rules(str(json_file)) == RULES


def test_policy_may_be_a_function_and_rules_a_file(spark, tmp_path):
    edges = [(H + "a", H + "b"), (H + "a", H + "c")]
    assert {u for u, _, _ in reach(spark, edges, [H + "a"], lambda rows: rows.filter(~F.endswith(F.col("url"), F.lit("c"))))} == {H + "a", H + "b"}
    (tmp_path / "b.json").write_text('{"^x": "one", "^a": "two"}')
    assert policies.load_blocklist(str(tmp_path / "b.json")) == [("^x", "one"), ("^a", "two")]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans_below_exchanges(df):
    """Scans that stand below an exchange."""
    found, open_at = [], []
    for line in plan_of(df).splitlines():
        depth = len(line) - len(line.lstrip(" :+-*(0123456789)"))
        open_at = [d for d in open_at if d < depth]
        if "Exchange" in line and "Reused" not in line:
            open_at.append(depth)
        if "FileScan" in line and open_at:
            found.append(line)
    return found


def test_a_level_moves_neither_the_graph_nor_what_was_reached(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large for it
    edges = spark.createDataFrame([(f"{H}{i}", f"{H}{j}") for i in range(60) for j in (2 * i, 2 * i + 1)], "src_url STRING, dst_url STRING")
    store = frontier.CrawlStore(spark, edges, buckets=4)
    try:
        level = store.add(spark.createDataFrame([(H + "1", None)], "url STRING, parent_url STRING"), 0)
        for depth in range(1, 4):
            found = store.candidates(level)
            # the level has the buckets of the graph: nothing is moved to join them
            assert "Exchange" not in plan_of(found) and plan_of(found).count("Bucketed: true") == 2
            new = frontier.new_links(found, store.reached())
            # what is exchanged are links on the level's pages; all that was reached is read where it is
            whole = [x for x in plan_of(new).splitlines() if store.reached_table in x and "PartitionFilters: []" in x]
            assert len(whole) == 1 and "Bucketed: true" in whole[0] and whole[0] not in scans_below_exchanges(new)
            assert len(scans_below_exchanges(new)) == 2
            level = store.add(new, depth)
        assert store.reached().count() == 1 + 2 + 4 + 8
    finally:
        store.close()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not spark.catalog.tableExists(store.links_table)
