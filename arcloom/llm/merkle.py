"""Merkle manifest of a table: a tree of digests per group, one tree over the groups' roots, a proof for every row.

Each row is a leaf, the digest of its values.  The leaves of a group, in the
order of their id, are cut into superblocks of ``2**SUPER`` places:

1. Every superblock is reduced to one node.  These nodes are the leaves of a
   smaller tree that is reduced the same way, until each group is one node; the
   groups' roots then make the last tree.  No task sees more than one
   superblock, and nothing but row counts reaches the driver.
2. On the way back down each superblock is given the nodes outside it that its
   rows' proofs need, one for each higher level at most.
3. Leaves and outer nodes are cogrouped by superblock.  In one go a task
   reduces the superblock, joins the inner and outer halves of each proof and
   folds each proof over the presented leaf.

Digests are lowercase hex sha256; a node is the digest of its children's
digests as text.  Two neighbours make a node, an odd last one makes one alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcloom.llm.ranking import row_numbers
from arcloom.operators.skew import lookup_join
from arcloom.session import cut_lineage

SUPER = 8  # levels of a superblock
GROUPS_BROADCAST = 100_000  # groups up to which their table is broadcast; beyond, hot groups are salted


def leaf(values: Sequence[Column]) -> Column:
    """Digest of values in order: ``-`` for NULL, else the UTF-8 byte count, ``:`` and the value as text."""
    def field(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def _join(*nodes: str) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def _levels(nodes: list[str], height: int) -> list[list[str]]:
    """The levels of a block from its leaves up to its one node, ``height`` levels above them."""
    out = [nodes]
    for _ in range(height):
        below = out[-1]
        out.append([_join(*below[i:i + 2]) for i in range(0, len(below), 2)])
    return out


def fold(digest: str, proof: Sequence[str], places: Sequence[int]) -> str:
    """The root that a leaf and its proof lead to.

    ``places`` has an entry a level: -1 for a sibling on the left, 1 for one on the right, 0 for none.
    """
    at = iter(proof)
    for side in places:
        digest = _join(next(at), digest) if side < 0 else _join(digest, next(at)) if side else _join(digest)
    return digest


def _height(count: int) -> int:
    """Levels above ``count`` leaves."""
    return max(count - 1, 0).bit_length()


def _block_height(count: int, super_levels: int) -> int:
    """Levels inside a superblock of a tree of ``count`` leaves: all of them if it is the only one."""
    return min(_height(count), super_levels)


def _reduce(nodes: DataFrame, super_levels: int) -> DataFrame:
    """One row (tree, place, node, n) per superblock of ``nodes``: its node, its place, and how many there are."""
    schema = "tree bigint, place bigint, node string, n bigint"

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("place")
        n = int(block["n"].iloc[0])
        top = _levels(block["node"].tolist(), _block_height(n, super_levels))[-1][0]
        return pd.DataFrame({"tree": [block["tree"].iloc[0]], "place": [int(block["place"].iloc[0]) >> super_levels],
                             "node": [top], "n": [-(-n >> super_levels)]})

    keyed = nodes.select("tree", "place", "node", "n", F.shiftright("place", super_levels).alias("__block"))
    return keyed.groupBy("tree", "__block").applyInPandas(run, schema)


def _paths(nodes: DataFrame, above: DataFrame | None, super_levels: int) -> DataFrame:
    """(tree, place, path) of each node: siblings from its level up to the root, and their sides.

    ``above`` has the paths of the superblocks of ``nodes``; None if each tree is one superblock.
    """
    schema = "tree bigint, place bigint, proof array<string>, sides array<int>"

    def walk(block: pd.DataFrame, proof: list[str], sides: list[int]) -> pd.DataFrame:
        block = block.sort_values("place")
        height = _block_height(int(block["n"].iloc[0]), super_levels)
        levels = _levels(block["node"].tolist(), height)
        found = [_inner(levels, i) for i in range(len(block))]
        return pd.DataFrame({"tree": block["tree"], "place": block["place"],
                             "proof": [p + proof for p, _ in found], "sides": [s + sides for _, s in found]})

    keyed = nodes.withColumn("__block", F.shiftright("place", super_levels))
    if above is None:
        return keyed.groupBy("tree", "__block").applyInPandas(lambda block: walk(block, [], []), schema)

    def joined(block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        return walk(block, list(outer["proof"].iloc[0]), list(outer["sides"].iloc[0]))

    return keyed.groupBy("tree", "__block").cogroup(
        above.withColumnRenamed("place", "__block").groupBy("tree", "__block")).applyInPandas(joined, schema)


def _inner(levels: list[list[str]], i: int) -> tuple[list[str], list[int]]:
    """Siblings of the i-th leaf of a block, and their sides, up to the block's node."""
    proof, sides = [], []
    for level in levels[:-1]:
        other = i ^ 1
        if other < len(level):
            proof.append(level[other])
        sides.append((-1 if other < i else 1) if other < len(level) else 0)
        i >>= 1
    return proof, sides


def _tree_paths(nodes: DataFrame, super_levels: int, label: str) -> tuple[DataFrame, DataFrame]:
    """(tree, root) and the paths of all ``nodes`` (tree, place, node, n) to their tree's root.

    One pass up for each superblock level and one down; each pass is a written table.
    """
    floors = [nodes]
    while floors[-1].filter("n > 1").limit(1).count():
        floors.append(cut_lineage(_reduce(floors[-1], super_levels), f"{label}-up"))
    paths = None
    for floor in reversed(floors[:-1] if len(floors) > 1 else floors):
        paths = cut_lineage(_paths(floor, paths, super_levels), f"{label}-down")
    return floors[-1].select("tree", F.col("node").alias("root")), paths


def manifest(df: DataFrame, columns: Sequence[str], group: str, id_column: str, presented: Mapping[str, Column] | None = None,
             super_levels: int = SUPER) -> DataFrame:
    """Leaf, roots and proof of each row of ``df``.

    ``columns`` are the values that make a leaf, in order; rows are leaves of
    their ``group``'s tree in the order of ``id_column``.  ``presented``
    replaces columns by other expressions for the check only: the proof is
    folded over the leaf of these values, ``folded_root`` is what comes out and
    ``verified`` whether it is the root.

    Returns the id, ``leaf``, ``subroot`` (of the group), ``root``, ``proof``
    (siblings from the leaf up, through the group's root to the root),
    ``sides`` (-1, 0 or 1 a level), ``folded_root`` and ``verified``.

    NULL groups are a group and come first, groups are ordered bytewise as
    text; NULL ids come first, rows of one id are ordered by their leaf, and
    rows that repeat in full have a leaf each.  An empty table gives an empty
    result.  Other columns are not read.  A group may hold any share of the
    rows: rows are ranked by range, and a task sees one superblock.
    """
    shown = {**{c: F.col(c) for c in columns}, **(presented or {})}
    rows = df.select(F.col(group).cast("string").alias("__group"), F.col(id_column).alias("__id"),
                     leaf([F.col(c) for c in columns]).alias("node"), leaf([shown[c] for c in columns]).alias("__shown"))
    rows = rows.withColumn("__shown", F.when(F.col("__shown") != F.col("node"), F.col("__shown")))
    ranked = row_numbers(rows, [F.col("__group"), F.col("__id"), F.col("node")], "__row", "merkle-order")

    sizes = ranked.groupBy("__group").agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("n"))
    groups = cut_lineage(row_numbers(sizes, [F.col("__group")], "tree", "merkle-groups").withColumn(
        "__key", F.coalesce(F.concat(F.lit("="), "__group"), F.lit("-"))).drop("__group"), "merkle-sizes")
    keyed = ranked.withColumn("__key", F.coalesce(F.concat(F.lit("="), "__group"), F.lit("-"))).drop("__group")
    if groups.count() <= GROUPS_BROADCAST:
        placed = keyed.join(F.broadcast(groups), "__key")
    else:
        placed = lookup_join(keyed, groups, ["__key"], ["__row"], how="inner")
    leaves = cut_lineage(placed.select(
        "tree", (F.col("__row") - F.col("__first")).alias("place"), "node", "n", F.col("__id").cast("string"), "__shown"), "merkle-leaves")

    # up: superblocks of leaves to the groups' roots, these to the root
    blocks = cut_lineage(_reduce(leaves, super_levels), "merkle-blocks")
    subroots, block_paths = _tree_paths(blocks, super_levels, "merkle-group")
    count = subroots.count()
    tops = subroots.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("place"), F.col("root").alias("node"),
                           F.lit(count).cast("bigint").alias("n"))
    roots, top_paths = _tree_paths(tops, super_levels, "merkle-top")
    root = F.lit(next((r["root"] for r in roots.collect()), None)).cast("string")  # one row, or none of an empty table

    # down: what each superblock needs of the nodes outside it
    above = top_paths.select(F.col("place").alias("tree"), F.col("proof").alias("__more"), F.col("sides").alias("__sides"))
    known = subroots.join(above, "tree")
    if count <= GROUPS_BROADCAST:
        outer = block_paths.join(F.broadcast(known), "tree")
    else:
        outer = lookup_join(block_paths, known, ["tree"], ["place"], how="inner")
    outer = outer.select("tree", F.col("place").alias("__block"), F.concat("proof", "__more").alias("proof"),
                         F.concat("sides", "__sides").alias("sides"), "root", root.alias("__root"))

    schema = ("__id string, leaf string, subroot string, root string, proof array<string>, sides array<int>, "
              "folded_root string, verified boolean")

    def finish(block: pd.DataFrame, outside: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("place")
        levels = _levels(block["node"].tolist(), _block_height(int(block["n"].iloc[0]), super_levels))
        o = outside.iloc[0]
        out = list(_finished(levels, block["__shown"].tolist(), list(o["proof"]), list(o["sides"])))
        return pd.DataFrame({
            "__id": block["__id"], "leaf": block["node"], "subroot": o["root"], "root": o["__root"],
            "proof": [x[0] for x in out], "sides": [x[1] for x in out], "folded_root": [x[2] for x in out],
            "verified": [x[2] == o["__root"] for x in out]})

    by_block = leaves.withColumn("__block", F.shiftright("place", super_levels)).groupBy("tree", "__block")
    found = by_block.cogroup(outer.groupBy("tree", "__block")).applyInPandas(finish, schema)
    names = ["leaf", "subroot", "root", "proof", "sides", "folded_root", "verified"]
    return found.select(F.col("__id").cast(df.schema[id_column].dataType).alias(id_column), *names)


def _finished(levels: list[list[str]], shown: list[str | None], proof: list[str],
              sides: list[int]) -> Iterator[tuple[list[str], list[int], str]]:
    """Whole proof, sides and folded root of each leaf of a superblock; ``shown`` has presented leaves that differ."""
    for i, node in enumerate(levels[0]):
        inner, inner_sides = _inner(levels, i)
        whole, all_sides = inner + proof, inner_sides + sides
        yield whole, all_sides, fold(shown[i] if isinstance(shown[i], str) else node, whole, all_sides)
