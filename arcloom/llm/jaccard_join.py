"""N-gram Jaccard join in the metric space of shingle sets, and the components its links form.

Jaccard distance is a metric.  Links are pairs within ``RADIUS`` (similarity of
0.75 or more).  Unrelated texts are all at distance 1 from each other, so free
pivots would put nearly everything into one region; pivots are therefore
chosen where sets meet:

1. Equal sets fold into one class.
2. Every class keeps the shingles among which two linked sets must share one (the
   first quarter of the set in a global order that puts very common shingles
   last).  All classes that share such a shingle have the smallest of them as
   pivot; a pivot with its classes is a region.  Linked classes share a region.
   Signatures, half a byte to a byte per shingle, rule out most of those that share but a passage.
3. A region with few classes is joined by one task: pivots split it into Voronoi
   cells, classes near a boundary (by the triangle inequality) also visit the
   cells beyond it, and cells are joined recursively until they are small.
4. A larger region is cut into blocks of a bounded number of classes and shingles.  All its
   classes are compared whose distances to the pivot differ by no more than the radius;
   block against block, no task holds more than two blocks.
5. A link may lie in several regions; the one with the smallest pivot has it.  So regions
   yield numbers of links, times the copies, and no lists of them.
6. Components, by repeated aggregates and joins, of a spanning set of each task's links.

Every step is exact; the list of common shingles and the bit maps have a fixed
size and only steer the amount of work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcloom.llm import tasks
from arcloom.llm.components import connected_components, star
from arcloom.session import cut_lineage, cut_whole, share

WIDTH = 5
LEAST, OF = 75, 100  # similarity of a link: LEAST / OF
RADIUS = 1 - LEAST / OF
HOT_TOKENS = 400_000  # most shingles that are ordered by how common they are
HOT_COUNT = 4
MAP_BITS = 1 << 25
BLOCK = 256  # classes of a region that one task splits into cells; larger regions are cut into blocks
BLOCK_CLASSES = 1024  # of a larger region: classes and shingles of a block, of which a task holds two at most
BLOCK_SHINGLES = 1 << 19
STRIP = 128  # classes of a block that are compared at a time
LEAF = 48
SET_BYTES = 1 << 18  # of texts whose shingles are made together; hashing takes some 50 times as much
PIVOTS = 6


# -- shingle sets ---------------------------------------------------------------------------------------------------

def _sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row, sorted: (hash, row, shingles per row)."""
    rows = len(offsets) - 1
    words, row, _, _ = tasks.word_hashes(tasks.LOWER[data], offsets)
    hashed, row = tasks.shingle_hashes(words, row, rows, WIDTH)
    order = np.lexsort((hashed, row))
    hashed, row = hashed[order], row[order]
    new = np.ones(len(hashed), bool)
    new[1:] = (hashed[1:] != hashed[:-1]) | (row[1:] != row[:-1])
    hashed, row = hashed[new], row[new]
    return hashed, row, np.bincount(row, minlength=rows)


def _set_keys(hashed: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One 64-bit key per set, whatever the order of its members."""
    sums = np.zeros(len(hashed) + 1, np.uint64)
    np.cumsum(tasks.mix(hashed + np.uint64(0x51ED270B)), out=sums[1:])
    ends = np.cumsum(sizes)
    total = sums[ends] - sums[ends - sizes]
    return tasks.mix(total + sizes.astype(np.uint64)).view(np.int64)


def _classes(docs: DataFrame) -> DataFrame:
    """(id, n, cls) of each text, and (token, count) of shingles that a task saw more than once."""
    schema = "id bigint, content bigint, n bigint, cls bigint, token bigint, seen bigint"
    names = ["id", "content", "n", "cls", "token", "seen"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        amount, counted = 0, set()  # copies of a set say nothing about how common its shingles are

        def repeated() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts > 1
            n = int(often.sum())
            return pa.RecordBatch.from_arrays(
                [*[pa.nulls(n, pa.int64())] * 4, pa.array(values[often].view(np.int64)),
                 pa.array(counts[often].astype(np.int64))], names=names)
        for batch in batches:
            for part, data, offsets in tasks.chunks(batch, "text", SET_BYTES):
                hashed, row, sizes = _sets(data, offsets)
                none, keys = pa.nulls(part.num_rows, pa.int64()), _set_keys(hashed, sizes)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("content"), pa.array(sizes.astype(np.int64)),
                     pa.array(keys), none, none], names=names)
                fresh = np.zeros(len(keys), bool)
                for i, key in enumerate(keys.tolist()):
                    if key not in counted:
                        counted.add(key)
                        fresh[i] = True
                held.append(hashed[fresh[row]])
                amount += len(held[-1])
                if amount >= 2 << 20:
                    yield repeated()
                    held, amount, counted = [], 0, set()
        if amount:
            yield repeated()

    return docs.withColumn("content", F.xxhash64("text")).mapInArrow(tasks.lean(run), schema)


# -- bit maps of a fixed size ---------------------------------------------------------------------------------------

def _bit_map(df: DataFrame, column: str) -> np.ndarray:
    """Bit map of the values of a BIGINT column: MAP_BITS bits, whatever their number."""
    words = df.select(_place(column).alias("bit")).selectExpr("bit div 64 AS w", "shiftleft(1L, CAST(bit % 64 AS INT)) AS b").groupBy(
        "w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(MAP_BITS // 64, np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out


def _place(key: str) -> Column:
    """The bit of a BIGINT."""
    return F.pmod(F.xxhash64(key), F.lit(MAP_BITS)).cast("bigint")


def _in_map(bits: np.ndarray, places: pa.Array) -> pa.Array:
    at = places.to_numpy()
    return pa.array(((bits[at >> 6] >> (at & 63)) & 1).astype(bool))


def _mark(df: DataFrame, key: str, bits: np.ndarray, name: str) -> DataFrame:
    """Add whether the BIGINT ``key`` may be in the map: false only if it is not.

    A function that works on the rows in Python anyway asks ``_in_map`` itself:
    two Python steps of one stage are two processes for each core.
    """
    shared = share(df.sparkSession, bits)

    @F.arrow_udf("boolean")  # only the places of the bits go through Python, not the rows
    def inside(places: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tasks.drop_built()
        for place in places:
            yield _in_map(shared.value, place)
        tasks.give_back()

    return df.withColumn(name, inside(_place(key)))


# -- candidate regions ----------------------------------------------------------------------------------------------

def _signatures(hashed: np.ndarray, row: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Per set, how many members have each value of their top bits, in cells that hold one or two members on average.

    Two sets share at most the sum of the smaller counts of all cells.  A set
    with a count that a byte can't hold gets an empty signature: nothing is known.
    """
    bits = np.clip(np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64) - 1, 6, 16)
    width = np.where(sizes > 0, 1 << bits, 0)
    starts = np.concatenate([[0], np.cumsum(width)])
    cell = (hashed >> (np.uint64(64) - bits[row].astype(np.uint64))).astype(np.int64)
    counts = np.bincount(starts[row] + cell, minlength=int(starts[-1]))
    raw = np.minimum(counts, 255).astype(np.uint8)
    out = [raw[a:b].tobytes() for a, b in zip(starts.tolist(), starts[1:].tolist())]
    for r in np.unique(np.searchsorted(starts, np.flatnonzero(counts > 255), side="right") - 1).tolist():
        out[r] = b""
    return out


def _may_link(n: np.ndarray, signatures: list[bytes]) -> np.ndarray:
    """Which of some sets may link with another of them, by their sizes and signatures."""
    out = np.array([not s for s in signatures])
    cells = np.array([len(s) for s in signatures])
    grids: dict[tuple[int, int], np.ndarray] = {}
    groups = {int(c): np.flatnonzero(cells == c) for c in np.unique(cells) if c}

    def grid(group: int, width: int) -> np.ndarray:
        """Signatures of one width, folded to ``width`` cells; counts keep two bytes."""
        if (group, width) not in grids:
            full = np.stack([np.frombuffer(signatures[i], np.uint8) for i in groups[group]]).astype(np.uint16)
            grids[group, width] = full.reshape(len(full), width, -1).sum(axis=2, dtype=np.uint16)
        return grids[group, width]

    for width in groups:  # linked sets differ in size by a third at most, so their widths by one step
        for other in {width, 2 * width} & set(groups):
            a, b = groups[width], groups[other]
            x, y = grid(width, width), grid(other, width)
            for k, i in enumerate(a):
                fits = (LEAST * np.maximum(n[b], n[i]) <= OF * np.minimum(n[b], n[i])) & (b != i)
                if fits.any():
                    most = np.minimum(y[fits], x[k]).sum(axis=1, dtype=np.int64)
                    yes = _linked(np.minimum(most, np.minimum(n[b[fits]], n[i])), n[b[fits]], n[i])
                    out[i] |= bool(yes.any())
                    out[b[fits][yes]] = True
    # where nothing is known of one, all may link with it
    return out | bool((cells == 0).any())


def _prefixes(docs: DataFrame, hot: tuple[np.ndarray, np.ndarray], spare: np.ndarray) -> DataFrame:
    """(id, cls, tokens, n, signature, suspect): the shingles of which two linked sets share at least one.

    ``suspect`` tells whether the id may be in the map ``spare``.
    """
    shared = share(docs.sparkSession, (hot, spare))
    schema = "id bigint, cls bigint, tokens array<bigint>, n bigint, signature binary, suspect boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (values, counts), bits = shared.value
        for batch in batches:
            for part, data, offsets in tasks.chunks(batch, "text", SET_BYTES):
                hashed, row, sizes = _sets(data, offsets)
                common = np.zeros(len(hashed), np.int64)
                if len(values):
                    at = np.minimum(np.searchsorted(values, hashed), len(values) - 1)
                    found = values[at] == hashed
                    common[found] = counts[at[found]]
                ordered = hashed[np.lexsort((hashed, common, row))]
                # at least ceil(LEAST * n / OF) members are shared, so one of the first n - that + 1 is
                keep = np.where(sizes > 0, sizes - -(-LEAST * sizes // OF) + 1, 0)
                starts = np.cumsum(sizes) - sizes
                mask = np.arange(len(ordered)) - np.repeat(starts, sizes) < np.repeat(keep, sizes)
                ends = np.concatenate([[0], np.cumsum(keep)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(_set_keys(hashed, sizes)),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(ordered[mask].view(np.int64))),
                     pa.array(sizes.astype(np.int64)), pa.array(_signatures(hashed, row, sizes), pa.binary()),
                     _in_map(bits, part.column("place"))],
                    names=["id", "cls", "tokens", "n", "signature", "suspect"])

    return docs.withColumn("place", _place("id")).mapInArrow(tasks.lean(run), schema)


def _chosen_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, n, shingles): the sets of the classes, each once."""
    shared = share(docs.sparkSession, _bit_map(classes, "rep"))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, tasks.CHUNK_ROWS):
                part = batch.slice(at, tasks.CHUNK_ROWS)
                yield part.filter(_in_map(shared.value, part.column("place")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in likely(batches):
            for part, data, offsets in tasks.chunks(batch, "text", SET_BYTES):
                hashed, _, sizes = _sets(data, offsets)
                ends = np.concatenate([[0], np.cumsum(sizes)]).tolist()
                raw = hashed.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(_set_keys(hashed, sizes)),
                     pa.array([raw[8 * a:8 * b] for a, b in zip(ends, ends[1:])], pa.binary()),
                     pa.array(sizes.astype(np.int64))], names=["id", "cls", "shingles", "n"])

    found = docs.select("id", "text", _place("id").alias("place")).mapInArrow(
        tasks.lean(run), "id bigint, cls bigint, shingles binary, n bigint")
    # one exchange: the join by class also brings equal classes together
    exact = found.join(classes.select("cls", "rep"), "cls").filter("id = rep")
    return exact.select("cls", "n", "shingles").dropDuplicates(["cls"])


# -- regions --------------------------------------------------------------------------------------------------------

def _linked(shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return OF * shared >= LEAST * (a + b - shared)


class _Space:
    """Some sets, with the sizes of their intersections."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets], np.int64)
        values, where = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        often = np.bincount(where, minlength=len(values)) > 1  # what only one set has is in no intersection
        number = np.cumsum(often) - 1
        keep = often[where]
        order = np.argsort(number[where[keep]], kind="stable")
        self._token, self._owner = number[where[keep]][order], owner[keep][order]
        self._tokens = int(often.sum())

    def shared(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Intersection sizes of ``rows`` x ``columns``; exact, as they are far below 2**24."""
        out = np.zeros((len(rows), len(columns)), np.float32)
        at_row, at_column = np.full(len(self.sizes), -1), np.full(len(self.sizes), -1)
        at_row[rows], at_column[columns] = np.arange(len(rows)), np.arange(len(columns))
        step = 8192
        for low in range(0, self._tokens, step):
            a, b = np.searchsorted(self._token, [low, low + step])
            token, owner = self._token[a:b] - low, self._owner[a:b]
            x, y = at_row[owner], at_column[owner]
            if not (x >= 0).any() or not (y >= 0).any():
                continue
            used = np.zeros(step, bool)
            used[token[x >= 0]] = True
            place = np.cumsum(used) - 1
            left, right = np.zeros((len(rows), int(used.sum())), np.float32), np.zeros((len(columns), int(used.sum())), np.float32)
            left[x[x >= 0], place[token[x >= 0]]] = 1
            both = (y >= 0) & used[token]
            right[y[both], place[token[both]]] = 1
            out += left @ right.T
        return np.rint(out).astype(np.int64)

    def distance(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        common = self.shared(rows, columns)
        return 1 - common / np.maximum(self.sizes[rows][:, None] + self.sizes[columns][None, :] - common, 1)

    def links(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        common = self.shared(rows, columns)
        return _linked(common, self.sizes[rows][:, None], self.sizes[columns][None, :])


_ROUNDING = 1e-9


def _join_cell(space: _Space, members: np.ndarray, out: set[tuple[int, int]]) -> None:
    """Add all links among ``members``: pivots, Voronoi cells with visitors, recursion."""
    todo = [members]
    while todo:
        cell = todo.pop()
        if len(cell) < 2:
            continue
        parts: list[np.ndarray] = []
        if len(cell) > LEAF:
            pivots = [cell[0]]
            d = space.distance(cell, cell[:1])
            while len(pivots) < PIVOTS:  # the farthest from all pivots so far
                far = int(d.min(axis=1).argmax())
                if d[far].min() <= 0:
                    break
                pivots.append(cell[far])
                d = np.concatenate([d, space.distance(cell, cell[far:far + 1])], axis=1)
            home = d.min(axis=1)
            # y within the radius of x, at home with q: d(x, q) <= d(x, home) + 2 * radius
            parts = [cell[d[:, q] <= home + 2 * RADIUS + _ROUNDING] for q in range(len(pivots))]
            if len(pivots) == 1 or max(map(len, parts)) > 0.9 * len(cell):
                parts = []  # closer together than the window is wide: splitting would not help
        if parts:
            todo += parts
            continue
        for at in range(0, len(cell), BLOCK):
            yes = space.links(cell[at:at + BLOCK], cell)
            i, j = np.nonzero(yes)
            later = j > at + i
            out.update(zip(cell[at + i[later]].tolist(), cell[j[later]].tolist()))


def _spanning(pairs: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """A forest with the same components."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    kept = []
    for a, b in sorted(pairs):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


_LINKS = "a bigint, linked bigint, tree array<bigint>"


def _first_here(group: pa.Table) -> list[np.ndarray]:
    """Of each class the regions with a smaller pivot than this one: classes that share one of them have met there."""
    pivot = group.column("pivot")[0].as_py()
    pivots = group.column("pivots").combine_chunks()
    ends = pivots.offsets.to_numpy()
    every = pivots.values.to_numpy()
    return [own[own < pivot] for own in (every[a:b] for a, b in zip(ends, ends[1:]))]


def _new_links(yes: np.ndarray, earlier: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """``yes`` without the links of ``rows`` x ``columns`` that an earlier region has."""
    if not yes.any():
        return yes
    i, j = np.flatnonzero(yes.any(axis=1)), np.flatnonzero(yes.any(axis=0))
    met = _Space([earlier[k] for k in rows[i]] + [earlier[k] for k in columns[j]]).shared(
        np.arange(len(i)), len(i) + np.arange(len(j))) > 0
    out = yes.copy()
    out[np.ix_(i, j)] &= ~met
    return out


def _link_rows(cls: np.ndarray, linked: np.ndarray, edges: set[tuple[int, int]]) -> pa.Table:
    """A row for each class with links: the copies of the classes it links with, and edges that span the links of all."""
    tree: dict[int, list[int]] = {}
    for x, y in _spanning(edges):
        tree.setdefault(x, []).append(y)
    heads = cls[linked > 0]
    return pa.table({
        "a": pa.array(heads, pa.int64()), "linked": pa.array(linked[linked > 0], pa.int64()),
        "tree": pa.array([tree.get(h, []) for h in heads.tolist()], pa.list_(pa.int64()))})


def _unpack(group: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    return group.column("cls").to_numpy(), [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]


def _join_region(group: pa.Table) -> pa.Table:
    """Links of a region of at most ``BLOCK`` classes."""
    group = group.sort_by("cls")
    cls, sets = _unpack(group)
    copies, everyone = group.column("copies").to_numpy(), np.arange(len(sets))
    pairs: set[tuple[int, int]] = set()
    _join_cell(_Space(sets), everyone, pairs)
    yes = np.zeros((len(sets), len(sets)), bool)
    i, j = np.array(sorted(pairs), np.int64).reshape(-1, 2).T
    yes[i, j] = True
    yes = _new_links(yes, _first_here(group), everyone, everyone)
    i, j = np.nonzero(yes)
    return _link_rows(cls, yes @ copies + yes.T @ copies, set(zip(cls[i].tolist(), cls[j].tolist())))


def _from_pivot(group: pa.Table) -> pa.Table:
    """Distance to the pivot of each class of a block; the pivot comes with every block."""
    cls, sets = _unpack(group)
    pivot = group.column("pivot")[0].as_py()
    at = int(np.flatnonzero(cls == pivot)[0])
    space = _Space(sets)
    everyone = np.arange(len(sets))
    d = space.distance(everyone, np.array([at]))[:, 0]
    mine = cls != pivot
    return pa.table({"pivot": pa.array([pivot] * int(mine.sum()), pa.int64()), "cls": cls[mine], "d": d[mine]})


def _join_blocks(group: pa.Table) -> pa.Table:
    """Links between the classes of one block and those of another (or the same), strip against strip in order of the distance."""
    group = group.sort_by([("d", "ascending"), ("cls", "ascending")])
    cls, sets = _unpack(group)
    d, copies = group.column("d").to_numpy(), group.column("copies").to_numpy()
    earlier, linked = _first_here(group), np.zeros(len(cls), np.int64)
    same = group.column("i")[0].as_py() == group.column("j")[0].as_py()
    first = group.column("row_side").to_numpy(zero_copy_only=False)
    rows, columns = np.flatnonzero(first), np.flatnonzero(first if same else ~first)
    edges: set[tuple[int, int]] = set()
    for at in range(0, len(rows), STRIP):
        x = rows[at:at + STRIP]
        for to in range(at if same else 0, len(columns), STRIP):
            y = columns[to:to + STRIP]
            if max(d[y[0]] - d[x[-1]], d[x[0]] - d[y[-1]]) > RADIUS + _ROUNDING:
                continue
            diagonal = same and at == to
            space = _Space([sets[k] for k in x] + ([] if diagonal else [sets[k] for k in y]))
            i, j = np.arange(len(x)), np.arange(len(y)) + (0 if diagonal else len(x))
            yes = space.links(i, j) & (np.abs(d[x][:, None] - d[y][None, :]) <= RADIUS + _ROUNDING)
            yes = _new_links(np.triu(yes, 1) if diagonal else yes, earlier, x, y)
            if not yes.any():
                continue
            linked[x] += yes @ copies[y]
            linked[y] += yes.T @ copies[x]
            for side, to_row in zip((x, y), star(yes, diagonal)):
                has = to_row >= 0
                a, b = cls[x[to_row[has]]], cls[side[has]]
                edges.update((u, v) for u, v in zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist()) if u < v)
    return _link_rows(cls, linked, edges)


def _filter_region(group: pa.Table) -> pa.Table:
    """The classes of a small region that may link with another of it."""
    keep = _may_link(group.column("n").to_numpy(), group.column("signature").to_pylist())
    return group.select(["pivot", "cls"]).filter(pa.array(keep))


def _promising(member: DataFrame, facts: DataFrame) -> DataFrame:
    """(pivot, cls) without classes whose signature rules out every partner in a small region; large ones stay whole."""
    sizes = cut_lineage(member.groupBy("pivot").agg(F.count(F.lit(1)).alias("m")), "region-members")
    small = member.join(sizes.filter(F.col("m").between(2, BLOCK)).select("pivot"), "pivot", "left_semi")
    left = small.join(facts, "cls").groupBy("pivot").applyInArrow(tasks.lean_groups(_filter_region), "pivot bigint, cls bigint")
    return left.unionByName(member.join(sizes.filter(F.col("m") > BLOCK).select("pivot"), "pivot", "left_semi"))


def _region_links(member: DataFrame, sets: DataFrame) -> DataFrame:
    """All links as (a, linked, tree), a class in as many rows as groups have links of it.  ``member``: (pivot, cls), pivots included."""
    sizes = cut_lineage(member.join(sets.select("cls", "n"), "cls").groupBy("pivot").agg(
        F.count(F.lit(1)).alias("m"), F.sum("n").alias("n")), "region-sizes")
    homes = member.groupBy("cls").agg(F.collect_list("pivot").alias("pivots"))
    sets = sets.drop("n").join(homes, "cls")
    small = member.join(sizes.filter(F.col("m").between(2, BLOCK)).select("pivot"), "pivot", "left_semi")
    found = small.join(sets, "cls").groupBy("pivot").applyInArrow(tasks.lean_groups(_join_region), _LINKS)
    blocks = F.ceil(F.greatest(F.col("m") / F.lit(BLOCK_CLASSES), F.col("n") / F.lit(BLOCK_SHINGLES))).cast("bigint")
    large = cut_lineage(sizes.filter(F.col("m") > BLOCK).select("pivot", blocks.alias("blocks")), "large-regions")
    if not large.limit(1).count():
        return found
    found = cut_lineage(found, "small-links")
    dealt = member.join(large, "pivot").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    with_pivot = dealt.filter("cls <> pivot").select("pivot", "block", "cls").unionByName(
        large.select("pivot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"), F.col("pivot").alias("cls")))
    # of the sets only those of large regions move
    needed = cut_lineage(with_pivot.select("cls").distinct(), "large-members")
    sets = cut_lineage(_mark(sets, "cls", _bit_map(needed, "cls"), "__may").filter("__may").drop("__may"), "large-sets")
    measured = with_pivot.join(sets.select("cls", "shingles"), "cls").groupBy("pivot", "block").applyInArrow(
        tasks.lean_groups(_from_pivot), "pivot bigint, cls bigint, d double")
    measured = cut_lineage(measured, "pivot-distances")
    # the radius is the window: a class meets the classes whose distance to the pivot is no more than that from its own
    placed = measured.unionByName(large.select("pivot", F.col("pivot").alias("cls"), F.lit(0.0).alias("d"))).join(
        large.select("pivot", "blocks"), "pivot").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    row = placed.withColumn("i", F.col("block")).withColumn(
        "j", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1))).withColumn("row_side", F.lit(True))
    # a block that meets itself comes once
    column = placed.filter("block > 0").withColumn("j", F.col("block")).withColumn(
        "i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("block") - 1))).withColumn("row_side", F.lit(False))
    fields = ["pivot", "i", "j", "cls", "d", "row_side"]
    cells = row.select(*fields).unionByName(column.select(*fields)).join(sets, "cls")
    return found.unionByName(cells.groupBy("pivot", "i", "j").applyInArrow(tasks.lean_groups(_join_blocks), _LINKS))


def _regions(kept: DataFrame, spare: DataFrame, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(pivot, cls): the regions, without classes that surely link with none of theirs."""
    prefixes = cut_lineage(_prefixes(kept, hot, _bit_map(spare, "id")), "jaccard-prefixes")

    def single(column: str) -> DataFrame:
        # copies go: what the map of their ids lets through is checked by a join
        return prefixes.filter("NOT suspect").select("cls", column).unionByName(
            prefixes.filter("suspect").join(spare, ["id", "cls"], "left_anti").select("cls", column))

    tokens = single("tokens").select("cls", F.explode("tokens").alias("token"))
    repeated = cut_lineage(tokens.groupBy("token").agg(F.min("cls").alias("pivot"), F.max("cls").alias("other")).filter(
        "pivot <> other").select("token", "pivot"), "jaccard-pivots")
    member = _mark(tokens, "token", _bit_map(repeated, "token"), "__may").filter("__may").join(
        repeated, "token").select("pivot", "cls").distinct()
    member = cut_lineage(member, "jaccard-members")
    asked = member.select("cls").distinct()
    signed = _mark(prefixes.select("cls", "n", "signature"), "cls", _bit_map(asked, "cls"), "__may").filter("__may").drop("__may")
    facts = asked.join(signed, "cls").dropDuplicates(["cls"])
    return _promising(member, facts)


def _links(kept: DataFrame, classes: DataFrame, spare: DataFrame, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The links of all regions; tables behind the regions go before sets move."""
    member = cut_whole(lambda: _regions(kept, spare, hot), kept.sparkSession, "jaccard-regions")
    sets = cut_lineage(_chosen_sets(kept, classes.join(member.select("cls").distinct(), "cls", "left_semi")), "jaccard-chosen")
    return _region_links(member, sets.join(classes.select("cls", "copies"), "cls"))


def components(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: id, ``n_shingles``, ``component_id`` (the smallest id reachable by links) and ``n_links``.

    ``n_links`` is the number of other rows within the radius, copies included.

    Words are runs of bytes other than white space, A-Z lower-cased; a text of 1
    to 4 words is one shingle.  ``component`` tells apart components that share an
    id because rows repeat it, ``content`` is a hash of the text.  A text without words, or NULL, has an empty set
    and links with nothing, not even another empty one.  A row without an id
    links with nothing and has no component.  Rows that repeat an id take part
    with each of their texts and may get different components.  Other columns
    are not read.  An empty table gives an empty result.
    """
    docs = df.select(F.col(id_column).cast("bigint").alias("id"), F.col(text).alias("text"))
    noted = cut_lineage(_classes(docs), "jaccard-sets")
    rows = noted.filter("n IS NOT NULL").select("id", "content", "n", "cls")
    usable = rows.filter("n > 0 AND id IS NOT NULL")
    common = noted.filter("token IS NOT NULL").groupBy("token").agg(F.sum("seen").alias("c")).filter(
        F.col("c") >= HOT_COUNT).orderBy(F.desc("c"), "token").limit(HOT_TOKENS).toArrow()
    values = common.column("token").to_numpy().view(np.uint64)
    order = np.argsort(values)
    hot = (values[order], common.column("c").to_numpy()[order])

    classes = cut_lineage(usable.groupBy("cls").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "jaccard-classes")
    spare = cut_lineage(usable.join(classes.filter("copies > 1"), "cls").filter("id <> rep").select("id", "cls"), "jaccard-copies")
    links = cut_whole(lambda: _links(docs.filter("id IS NOT NULL"), classes, spare, hot), df.sparkSession, "jaccard-links")
    edges = cut_lineage(links.select("a", F.explode("tree").alias("b")), "jaccard-edges")
    counted = links.groupBy(F.col("a").alias("cls")).agg(F.sum("linked").alias("linked"))
    parts = connected_components(edges, "jaccard")
    named = classes.join(parts.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    label = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    labels = named.select("cls", "component", "copies").join(label, "component").join(counted, "cls", "left").withColumn(
        "n_links", F.coalesce("linked", F.lit(0).cast("bigint")) + F.col("copies") - 1)
    linked = usable.join(labels, "cls").select("id", "content", "n", "component_id", "component", "n_links")
    rest = rows.filter("n = 0 OR id IS NULL").select(
        "id", "content", "n", F.col("id").alias("component_id"), F.lit(None).cast("bigint").alias("component"),
        F.lit(0).cast("bigint").alias("n_links"))
    return linked.unionByName(rest).select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"), "component_id", "component", "content", "n_links")


def keep_one(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` without all but one of each component: the row whose id names it stays.

    Of rows that share that id, the one with the least text hash stays, and of
    rows equal in both any one.  Rows without an id or without words all stay.
    Texts that stay are not shuffled, except those whose id a fixed-size map of
    the ids to drop takes for one of them.
    """
    # the sets and links behind the components have done their work when these are written
    found = cut_whole(lambda: components(df, id_column, text).withColumnRenamed(id_column, "__id").filter(
        "__id IS NOT NULL AND n_shingles > 0"), df.sparkSession, "jaccard-found")
    stays = found.filter("__id = component_id").groupBy("component").agg(F.min("content").alias("best"))
    listed = found.groupBy("component", "__id", "content", "component_id").agg(F.count(F.lit(1)).alias("copies")).join(
        stays, "component").withColumn("drop", (F.col("__id") != F.col("component_id")) | (F.col("content") != F.col("best")))
    # ids to look at: of rows to drop, and of rows that stay but repeat
    doubtful = cut_lineage(listed.filter("drop OR copies > 1").select("__id", "content", "drop"), "jaccard-doubtful")
    own = [c for c in df.columns]
    spot = df.select(F.struct(*[F.col(c) for c in own]).alias("__row"), F.col(id_column).cast("bigint").alias("__id"),
                     F.xxhash64(text).alias("content"))
    marked = _mark(spot, "__id", _bit_map(doubtful, "__id"), "__suspect")
    sure = marked.filter("NOT __suspect").select("__row.*")
    checked = marked.filter("__suspect").join(doubtful, ["__id", "content"], "left")
    plain = checked.filter("drop IS NULL").select("__row.*")
    once = checked.filter("NOT drop").dropDuplicates(["__id", "content"]).select("__row.*")
    return sure.unionByName(plain).unionByName(once)
