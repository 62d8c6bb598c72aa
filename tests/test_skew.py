from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arcloom.operators.skew import hot_keys, lookup_join, numbered, ordered_scan

SCHEMA = "k STRING, o BIGINT, x BIGINT, y STRING"
row = st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 60), st.integers(-3, 3),
                st.sampled_from(["p", "q", None]))


@settings(max_examples=8, deadline=None)
@given(st.lists(row, max_size=40, unique_by=lambda r: (r[0], r[1])))
def test_ordered_scan_is_a_sequential_fold_for_any_segment_size(spark, rows):
    want, total, last = set(), defaultdict(int), {}
    for k, o, x, y in sorted(rows, key=lambda r: r[1]):
        total[k] += x
        want.add((k, o, total[k], last.get(k)))
        if y is not None:
            last[k] = y
    df = spark.createDataFrame(rows, SCHEMA)
    for span in (3, 1000):
        out = ordered_scan(df, ["k"], "o", sums={"total": F.col("x")}, previous={"before": F.col("y")}, span=span)
        assert {(r.k, r.o, r.total, r.before) for r in out.collect()} == want


def test_numbered_is_consecutive_over_segments(spark):
    df = spark.range(50).select((F.col("id") % 2).alias("k"), F.col("id").alias("o"))
    out = numbered(df, ["k"], "o", "n", start=0, span=7)
    assert {(r.k, r.o, r.n) for r in out.collect()} == {(i % 2, i, i // 2) for i in range(50)}


def test_a_hot_key_is_spread_and_keeps_all_rows(spark):
    left = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"), "id")
    right = spark.createDataFrame([("hot", 1), ("k2", 2), ("unused", 3)], "k STRING, v INT")
    hot = hot_keys(left, ["k"], min_rows=500, sample=1.0)
    assert "hot" in {r.k for r in hot.collect()}
    out = lookup_join(left, right, ["k"], ["id"], hot=hot, fanout=8)
    assert out.count() == 3000
    assert out.filter("v = 1").count() == 1000
    assert [r.id for r in out.filter("v = 2").collect()] == [2]
    assert out.filter("k is null and v is null").count() == 1000
    inner = lookup_join(left, right, ["k"], ["id"], how="inner", hot=hot, fanout=8)
    assert inner.count() == 1001
    plain = lookup_join(left, right, ["k"], ["id"], hot=False)
    assert plain.exceptAll(out).count() == 0 and plain.count() == 3000
