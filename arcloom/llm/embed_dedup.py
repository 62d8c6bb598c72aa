"""Near-duplicate vectors by cosine: int8 tile products with error bounds, then full precision where it matters.

* Equal vectors fold into one representative first, with its number of copies.
* Representatives are scaled to unit length, rounded to int8 and packed into
  blocks of ``BLOCK_ROWS``; each vector keeps the norm of its rounding error.
* Every pair of blocks is one tile: a product of small integers, exact in
  single precision.  By Cauchy-Schwarz the true cosine differs from it by at
  most ``e_x * |q_y| + |x| * e_y``.  Pairs surely below the threshold are done,
  all others are computed again from the original components in double precision.
* A tile gives per vector the number of its links and one edge to the first
  vector of its part of a strip; links themselves are never written.

The tiles are all pairs of blocks, so time grows with the square of the number
of distinct vectors.  Blocks are written once, and tasks read those they need
from the shared folder: nothing is moved or written per tile.  A task goes
through squares of tiles, and holds the blocks of one side, one block of the other and
a strip of one tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from arcloom.llm.components import connected_components, star
from arcloom.session import cut_lineage, cut_whole, write_parts
from arcloom.sources.files import locate

BLOCK_ROWS = 2048
STRIP = 256  # rows of a tile multiplied at a time
SIDE = 8  # blocks of one side of a square of tiles, fewer if there are few or long ones
SIDE_BYTES = 64 << 20
_SLACK = 1e-6  # covers single-precision rounding of scales and bounds


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale, error norm) of unit vectors: ``|x - scale * code| <= error``."""
    scale = np.abs(vectors).max(axis=1) / 127.0
    codes = np.rint(vectors / scale[:, None]).astype(np.int8)
    error = np.sqrt(((vectors - scale[:, None] * codes) ** 2).sum(axis=1))
    return codes, scale, error


def _unit(raw: np.ndarray) -> np.ndarray:
    raw = raw.astype(np.float64)
    unit = raw / np.abs(raw).max(axis=1, keepdims=True)  # first to a size whose squares neither vanish nor overflow
    return unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True))


_BLOCK = "dims int, block bigint, ids binary, copies binary, raw binary, codes binary, scale binary, error binary"


def _pack(group: pa.Table) -> pa.Table:
    """One row per block; a block has at most a few times ``BLOCK_ROWS`` vectors."""
    flat = group.column("v").combine_chunks()
    ids = group.column("rep").to_numpy()
    order = np.argsort(ids)
    dims = len(flat[0])
    raw = np.asarray(flat.flatten()).reshape(len(ids), dims)[order]
    codes, scale, error = quantise(_unit(raw))
    return pa.table({
        "dims": pa.array([dims], pa.int32()), "block": pa.array([group.column("block")[0].as_py()], pa.int64()),
        "ids": [ids[order].astype(np.int64).tobytes()],
        "copies": [group.column("copies").to_numpy()[order].astype(np.int64).tobytes()],
        "raw": [raw.tobytes()], "codes": [codes.tobytes()], "scale": [scale.tobytes()], "error": [error.tobytes()]})


class _Block:
    """A block as it is written; its vectors in full are read when a pair needs them."""

    def __init__(self, path: str, dims: int, number: int) -> None:
        self._folder, self._unit = f"{path}/dims={dims}/block={number}", None
        kinds = {"ids": np.int64, "copies": np.int64, "codes": np.int8, "scale": np.float64, "error": np.float64}
        row = self._read(list(kinds))
        found = {k: np.frombuffer(row.get(k, b""), t) for k, t in kinds.items()}
        self.ids, self.copies, self.scale, self.error = (found[k] for k in ("ids", "copies", "scale", "error"))
        self.codes = found["codes"].reshape(len(self.ids), dims)
        self.near = self.codes.astype(np.float32) * self.scale.astype(np.float32)[:, None]
        self.length = self.scale * np.sqrt((self.codes.astype(np.float64) ** 2).sum(axis=1))

    def _read(self, columns: list[str]) -> dict:
        """The block's row; no vector may have fallen to it."""
        system, folder = locate(self._folder)
        for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if info.type == fs.FileType.File and info.base_name.endswith(".parquet"):
                with system.open_input_file(info.path) as source:
                    return {k: v[0] for k, v in pq.ParquetFile(source).read(columns).to_pydict().items()}
        return {}

    def unit(self) -> np.ndarray:
        if self._unit is None:
            raw = self._read(["raw"])["raw"]
            kind = np.float32 if len(raw) == 4 * self.codes.size else np.float64
            self._unit = _unit(np.frombuffer(raw, kind).reshape(self.codes.shape))
        return self._unit


def _may_pass(x: _Block, y: _Block, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs the int8 products, exact, leave in doubt or pass."""
    about = np.einsum("ij,ij->i", x.codes[i].astype(np.float64), y.codes[j].astype(np.float64)) * x.scale[i] * y.scale[j]
    return about + x.error[i] * y.length[j] + y.error[j] + _SLACK >= threshold


def _strip_links(x: _Block, y: _Block, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The linked pairs of a tile, strip by strip; of a block with itself each pair once."""
    if not len(x.ids) or not len(y.ids):
        return
    # what the product of scaled codes in single precision must reach for any vector of y: a bound per row
    rounding = _SLACK + x.codes.shape[1] * 2.0 ** -22
    least = (threshold - x.error * y.length.max() - y.error.max() - 2 * _SLACK - rounding).astype(np.float32)
    for at in range(0, len(x.ids), STRIP):
        s = slice(at, at + STRIP)
        i, j = np.divmod(np.flatnonzero(x.near[s] @ y.near.T >= least[s, None]), len(y.ids))
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        kept = []
        for part in range(0, len(i), 1 << 16):
            a, b = i[part:part + (1 << 16)], j[part:part + (1 << 16)]
            may = _may_pass(x, y, a, b, threshold)
            a, b = a[may], b[may]
            if len(a):
                yes = np.einsum("ij,ij->i", x.unit()[a], y.unit()[b]) >= threshold
                kept.append((a[yes], b[yes]))
        if any(len(a) for a, _ in kept):
            yield np.concatenate([a for a, _ in kept]), np.concatenate([b for _, b in kept])


def _edges(x: _Block, y: _Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Pairs of ids that span the linked pairs of a strip."""
    if len(i) <= 64:
        return np.stack([y.ids[j], x.ids[i]], axis=1)
    (rows, a), (columns, b) = np.unique(i, return_inverse=True), np.unique(j, return_inverse=True)
    links = np.zeros((len(rows), len(columns)), bool)
    links[a, b] = True
    of_row, of_column = star(links, False)
    heads = x.ids[rows]
    return np.concatenate([np.stack([x.ids[rows], heads[of_row]], axis=1), np.stack([y.ids[columns], heads[of_column]], axis=1)])


class _Squares:
    """Numbers of the squares of tiles of all lengths of vectors."""

    def __init__(self, blocks: dict[int, int]) -> None:
        self._kinds, self.count = [], 0
        for dims, count in sorted(blocks.items()):
            side = max(1, min(SIDE, count // 24, SIDE_BYTES // (13 * BLOCK_ROWS * dims)))
            groups = -(-count // side)
            n = np.arange(groups, dtype=np.int64)
            self._kinds.append((self.count, dims, count, side, groups, n * groups - n * (n - 1) // 2))
            self.count += groups * (groups + 1) // 2

    def __getitem__(self, number: int) -> tuple[int, range, range]:
        """(dims, blocks of the rows, blocks of the columns) of a square on or above the diagonal."""
        start, dims, count, side, groups, firsts = next(k for k in reversed(self._kinds) if k[0] <= number)
        row = int(np.searchsorted(firsts, number - start, side="right")) - 1
        column = row + number - start - int(firsts[row])
        return dims, *(range(g * side, min((g + 1) * side, count)) for g in (row, column))


def _square(path: str, dims: int, xs: dict[int, _Block], columns: range, threshold: float) -> pa.RecordBatch:
    """(id, n, low): copies of the vectors that each vector of a square links with, and, with 0, edges that span the links."""
    numbers = {i: np.zeros(len(x.ids), np.int64) for i, x in xs.items()}
    ids, ns, edges = [], [], []
    for j in columns:
        y = xs[j] if j in xs else _Block(path, dims, j)
        own = numbers[j] if j in xs else np.zeros(len(y.ids), np.int64)
        for i, x in xs.items():
            if i > j:
                continue
            for a, b in _strip_links(x, y, i == j, threshold):
                np.add.at(numbers[i], a, y.copies[b])
                np.add.at(own, b, x.copies[a])
                edges.append(_edges(x, y, a, b))
        if j not in xs:
            ids.append(y.ids)
            ns.append(own)
    every, n = np.concatenate([*ids, *(x.ids for x in xs.values())]), np.concatenate([*ns, *numbers.values()])
    pairs = np.unique(np.concatenate(edges), axis=0) if edges else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([every[n > 0], pairs[:, 0]])), pa.array(np.concatenate([n[n > 0], np.zeros(len(pairs), np.int64)])),
         pa.array(np.concatenate([every[n > 0], pairs[:, 1]]))], names=["id", "n", "low"])


def _tile_links(reps: DataFrame, sizes: dict[int, int], threshold: float) -> DataFrame:
    """(id, n, low) of all tiles, as of ``_square``."""
    spark = reps.sparkSession
    counts = {dims: max(1, -(-n // BLOCK_ROWS)) for dims, n in sizes.items()}
    blocks = None
    for dims, count in sorted(counts.items()):
        dealt = reps.filter(F.size("v") == dims).select(
            "v", "rep", "copies", F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(count)).alias("block"))
        packed = dealt.groupBy("block").applyInArrow(_pack, _BLOCK)
        blocks = packed if blocks is None else blocks.unionByName(packed)
    path, squares = write_parts(blocks, "vector-blocks", "dims", "block"), _Squares(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, xs = None, {}
        for batch in batches:
            for number in batch.column("id").to_pylist():
                dims, rows, columns = squares[number]
                if (dims, rows) != held:  # squares in a row share the blocks of their rows
                    held, xs = (dims, rows), {i: _Block(path, dims, i) for i in rows}
                yield _square(path, dims, xs, columns, threshold)

    tasks = min(squares.count, max(8 * spark.sparkContext.defaultParallelism, squares.count // 64))
    return spark.range(0, squares.count, 1, tasks).mapInArrow(run, "id bigint, n bigint, low bigint")


def near_duplicates(df: DataFrame, threshold: float = 0.95, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per row of ``df``: id, ``n_links``, ``component_id`` and ``kept``.

    ``n_links`` counts the other rows whose cosine with this one is at least
    ``threshold`` (in double precision); copies link with each other.
    ``component_id`` is the smallest id reachable by links, itself included;
    ``kept`` marks the row that stays of each component.

    Vectors that are NULL, empty or zero or hold NULL or non-finite components
    link with nothing, and so do rows without an id, whose component is NULL.
    Vectors of different lengths never link.  Rows that repeat an id count as
    rows.  Other columns are not read.
    """
    spark = df.sparkSession
    of = df.schema[vector].dataType
    single = isinstance(of, ArrayType) and isinstance(of.elementType, FloatType)  # takes half the room of double precision
    rows = df.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector).cast(f"array<{'float' if single else 'double'}>").alias("v"))
    usable = F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (
        F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0.0)
    good = rows.filter(usable)
    # ids may repeat with other vectors, so a representative gets a number of its own, fixed by writing it
    reps = cut_lineage(good.groupBy("v").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies")).withColumn(
        "rep", F.monotonically_increasing_id()), "vectors")
    seen = reps.groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n"), F.max("copies").alias("most")).collect()
    member = reps.filter("copies = 1").select(F.col("least").alias("id"), "rep", "copies")
    if any(r["most"] > 1 for r in seen):  # only rows of vectors that repeat are looked up by their vector
        repeated = cut_lineage(reps.filter("copies > 1").select("v", "rep", "copies"), "vector-copies")
        member = member.unionByName(good.join(repeated, "v").select("id", "rep", "copies"))
    rest = rows.filter(~F.coalesce(usable, F.lit(False))).select(
        "id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    if not seen:
        return rest.withColumnRenamed("id", id_column)
    per_tile = cut_whole(lambda: _tile_links(reps, {r["dims"]: r["n"] for r in seen}, threshold), spark, "tile-links")
    linked = per_tile.groupBy("id").agg(F.sum("n").alias("n")).withColumnRenamed("id", "rep")
    parts = connected_components(per_tile.select(F.col("id").alias("a"), F.col("low").alias("b")), "vector").withColumnRenamed(
        "node", "rep")
    named = cut_lineage(reps.select("rep", "least").join(parts, "rep", "left").withColumn(
        "component", F.coalesce("component", "rep")), "vector-parts")
    label = named.groupBy("component").agg(F.min("least").alias("component_id"))
    facts = named.select("rep", "component").join(label, "component").join(linked, "rep", "left").select(
        "rep", "component_id", F.coalesce("n", F.lit(0)).alias("n"))
    found = member.join(facts, "rep").select("id", (F.col("n") + F.col("copies") - 1).alias("n_links"), "component_id")
    found = found.withColumn("kept", F.col("id") == F.col("component_id"))
    return found.unionByName(rest).withColumnRenamed("id", id_column)
