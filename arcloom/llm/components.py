"""Connected components of a distributed edge list."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcloom.session import cut_lineage, cut_whole


def connected_components(edges: DataFrame, label: str) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): component is the smallest node reachable.

    Alternates two steps until no edge changes: each node's larger neighbours
    are linked with the smallest node near it (large star), then its smaller
    neighbours are (small star).  Both are an aggregate with a map-side combine
    and a join, so a node with very many neighbours is no group of its own.
    Rounds grow with the logarithm of the longest path.  Each round's edges are
    written to the shared folder; nothing but two numbers reaches the driver.
    """
    return cut_whole(lambda: _stars(edges, label), edges.sparkSession, f"{label}-components")  # the rounds go, the result stays


def _stars(edges: DataFrame, label: str) -> DataFrame:
    links = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = cut_lineage(links, f"{label}-links")
    before = _digest(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: neighbours above a node move to the smallest node near it
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut_lineage(large, f"{label}-large")
        # small star: a node and its neighbours below it move to the smallest of these
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")
        ).select("e.*").filter("a <> b").distinct()
        links = cut_lineage(small, f"{label}-small")
        after = _digest(links)
        if after == before:
            break
        before = after
    # every edge now points at the smallest node of its component
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _digest(links: DataFrame) -> tuple[int, int]:
    n, total = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return n, int(total or 0)


def star(yes: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The first row of the part that each row and each column of a link matrix is connected with by links; -1 without a link."""
    if same:
        yes = yes | yes.T
    none = len(yes)
    row = np.where(yes.any(axis=1), np.arange(none), none)
    while True:
        column = np.where(yes, row[:, None], none).min(axis=0, initial=none)
        if same:
            column = np.minimum(column, row)
        after = np.minimum(row, np.where(yes, column[None, :], none).min(axis=1, initial=none))
        if (after == row).all():
            break
        row = after
    return np.where(row < none, row, -1), np.where(column < none, column, -1)
