"""All-pairs work on vectors, tile against tile.

Rows are hashed to tiles of bounded size, tiles to strips. Every two tiles meet in one task, where the
block of their similarities is one matrix product. The block never leaves the task: what it says about
its rows (counts, minima, a few nearest, a spanning forest) is kept in a state while the task goes
through all tiles of its two strips, and leaves it once for each row. A dense group of near-copies costs
arithmetic but no rows, and no task ever holds more than two strips of tiles.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE_BYTES = 4 << 20
MIN_TILE_ROWS = 512
MAX_TASKS = 20_000
# Rows of sparse tiles are short, so the block of two tiles bounds them.
SPARSE_ROWS = 2048
# Session setting for the bytes of a strip, two of which are in a task's memory, and its default. Each
# tile is copied once per strip: larger executors take longer strips and shuffle less.
STRIP_SETTING, STRIP_BYTES = "topiclake.strip.bytes", 32 << 20
# Rows of a tile that are compared at once: the block of their similarities takes 8 MB, however narrow
# the vectors and however many rows a tile holds.
BLOCK_ROWS = 1024


@dataclass
class Sparse:
    """Rows of (key, value) entries: those of row i lie between ``ends[i]`` and ``ends[i + 1]``."""

    ends: np.ndarray
    keys: np.ndarray
    values: np.ndarray

    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self.ends) - 1), np.diff(self.ends))

    def columns(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(column, row, value) of the entries whose key is among ``keys``, by ascending column."""
        at = np.minimum(np.searchsorted(keys, self.keys), len(keys) - 1)
        held = np.flatnonzero(keys[at] == self.keys)
        held = held[np.argsort(at[held], kind="stable")]
        return at[held], self.rows()[held], self.values[held]


def sparse_products(a: Sparse, b: Sparse, step: int = 1024) -> np.ndarray:
    """Inner products of all rows, or, of one table with itself, of all different rows.

    Only keys that two rows may share are looked at, ``step`` at a time.
    """
    shape = len(a.ends) - 1, len(b.ends) - 1
    out = np.zeros(shape)
    if a is b:
        common, times = np.unique(a.keys, return_counts=True)
        common = common[times > 1]
    else:
        common = np.intersect1d(a.keys, b.keys)
    if not len(common):
        return out
    sides = [x.columns(common) for x in (a, b)]
    for i in range(0, len(common), step):
        blocks = []
        for (column, row, value), n in zip(sides, shape):
            lo, hi = np.searchsorted(column, (i, i + step))
            block = np.zeros((n, min(step, len(common) - i)))
            block[row[lo:hi], column[lo:hi] - i] = value[lo:hi]
            blocks.append(block)
        out += blocks[0] @ blocks[1].T
    return out


@dataclass
class Tile:
    ids: np.ndarray
    x: "np.ndarray | Sparse"
    extra: dict[str, np.ndarray] = field(default_factory=dict)
    # Tells the tiles of a task apart.
    name: tuple = ()

    def parts(self, rows: int) -> "list[Tile]":
        """The tile in pieces of at most ``rows`` rows, without a copy; sparse tiles are bounded already."""
        if isinstance(self.x, Sparse) or len(self.ids) <= rows:
            return [self]
        return [
            Tile(self.ids[i:i + rows], self.x[i:i + rows], {n: v[i:i + rows] for n, v in self.extra.items()},
                 (*self.name, i))
            for i in range(0, len(self.ids), rows)
        ]


Kernel = Callable[[Tile, Tile, bool], "dict[str, np.ndarray] | None"]


class State:
    """What a task learns from the tiles of two strips; ``rows`` is asked once, at the end.

    ``lo`` and ``hi`` are the numbers of the strips.
    """

    def add(self, a: Tile, b: Tile, same: bool) -> None:
        raise NotImplementedError

    def rows(self, lo: int, hi: int) -> "dict[str, np.ndarray] | None":
        raise NotImplementedError


class RowState(State):
    """A state of arrays with one entry for each row, kept tile by tile.

    ``meet`` returns the arrays that a block gives for the rows of its first tile, ``merged`` joins
    them with those of earlier blocks. With ``both`` False only the rows of the first table count.
    """

    both = True

    def __init__(self):
        self.held: dict[int, tuple[np.ndarray, tuple]] = {}

    def meet(self, mine: Tile, others: Tile, block: np.ndarray) -> tuple:
        raise NotImplementedError

    def merged(self, old: tuple, new: tuple) -> tuple:
        raise NotImplementedError

    def block(self, a: Tile, b: Tile, same: bool) -> np.ndarray:
        raise NotImplementedError

    def add(self, a: Tile, b: Tile, same: bool) -> None:
        block = self.block(a, b, same)
        self._put(a, self.meet(a, b, block))
        if self.both and not same:
            self._put(b, self.meet(b, a, block.T))

    def _put(self, tile: Tile, new: tuple) -> None:
        name = tile.name or int(tile.ids[0])
        if name in self.held:
            new = self.merged(self.held[name][1], new)
        self.held[name] = tile.ids, new

    def joined(self) -> tuple[np.ndarray, list]:
        """Ids and arrays of all rows seen."""
        ids = np.concatenate([i for i, _ in self.held.values()])
        return ids, [np.concatenate(x) for x in zip(*(s for _, s in self.held.values()))]


def is_sparse(df: DataFrame, vec: str) -> bool:
    """Whether the vectors are lists of (key, value) entries."""
    return df.schema[vec].dataType.simpleString() == "array<struct<key:bigint,value:double>>"


def entries(column: pa.ChunkedArray, order: np.ndarray | None = None) -> Sparse:
    """The rows of a column of (key, value) lists, in the given order."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if order is not None:
        arr = arr.take(pa.array(order))
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks)
    flat = arr.flatten()
    sizes = np.asarray(arr.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    return Sparse(
        np.append(0, np.cumsum(sizes)),
        np.asarray(flat.field(0).to_numpy(zero_copy_only=False), np.int64),
        np.asarray(flat.field(1).to_numpy(zero_copy_only=False), np.float64),
    )


def _matrix(column: pa.ChunkedArray, dtype) -> np.ndarray:
    arr = column.combine_chunks()
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks)
    if pa.types.is_list(arr.type):
        return np.asarray(arr.flatten().to_numpy(zero_copy_only=False), dtype).reshape(len(arr), -1)
    return np.asarray(arr.to_numpy(zero_copy_only=False), dtype)


def _pack(
    df: DataFrame, key: str, vec: str, extra: dict[str, str], tiles: int, place: F.Column | None = None
) -> DataFrame:
    """One row per tile: ids, vectors and extra columns as binary arrays, ids ascending.

    ``place`` is the tile of a row; without it keys are hashed."""
    names = list(extra)
    sparse = is_sparse(df, vec)

    def vectors(column: pa.ChunkedArray, order: np.ndarray) -> bytes:
        if not sparse:
            return _matrix(column, np.float64)[order].tobytes()
        rows = entries(column, order)
        return rows.ends.tobytes() + rows.keys.tobytes() + rows.values.tobytes()

    def pack(table: pa.Table) -> pa.Table:
        ids = _matrix(table.column(key), np.int64)
        order = np.argsort(ids, kind="stable")
        out = {
            "tile": pa.array([table.column("tile")[0].as_py()], pa.int64()),
            "ids": pa.array([ids[order].tobytes()], pa.binary()),
            "x": pa.array([vectors(table.column(vec), order)], pa.binary()),
        }
        for name in names:
            values = _matrix(table.column(name), extra[name])[order]
            out[name] = pa.array([np.ascontiguousarray(values).tobytes()], pa.binary())
        return pa.table(out)

    hashed = F.pmod(F.xxhash64(key), F.lit(tiles))
    rows = df.select(
        (hashed if place is None else place).cast("long").alias("tile"),
        F.col(key).cast("long").alias(key), vec, *names,
    )
    schema = "tile long, ids binary, x binary" + "".join(f", {n} binary" for n in names)
    return rows.groupBy("tile").applyInArrow(pack, schema)


def _unpack(table: pa.Table, i: int, extra: dict[str, str], sparse: bool) -> Tile:
    ids = np.frombuffer(table.column("ids")[i].as_buffer(), np.int64)

    def shaped(name, dtype):
        a = np.frombuffer(table.column(name)[i].as_buffer(), dtype)
        return a if a.size == ids.size else a.reshape(ids.size, -1)

    raw = table.column("x")[i].as_buffer()
    if sparse:
        ends = np.frombuffer(raw, np.int64, ids.size + 1)
        n, at = int(ends[-1]), ends.nbytes
        x = Sparse(ends, np.frombuffer(raw, np.int64, n, at), np.frombuffer(raw, np.float64, n, at + 8 * n))
    else:
        x = np.frombuffer(raw, np.float64).reshape(ids.size, -1)
    name = table.column("side")[i].as_py(), table.column("tile")[i].as_py()
    return Tile(ids, x, {n: shaped(n, t) for n, t in extra.items()}, name)


def tile_count(df: DataFrame, vec: str, tile_rows: int | None = None) -> int:
    """Tiles small enough for a task's memory, and enough of them to keep the cores busy."""
    sparse = is_sparse(df, vec)
    n, width = df.agg(F.count("*"), (F.avg if sparse else F.max)(F.size(vec))).first()
    if not n:
        return 1
    if tile_rows:
        return math.ceil(n / tile_rows)
    if sparse:
        return max(math.ceil(n * (width + 1) * 16 / TILE_BYTES), math.ceil(n / SPARSE_ROWS))
    cores = df.sparkSession.sparkContext.defaultParallelism
    by_memory = math.ceil(n * max(width or 1, 1) * 8 / TILE_BYTES)
    by_cores = min(math.ceil(math.sqrt(2 * cores)), math.ceil(n / MIN_TILE_ROWS))
    return max(by_memory, by_cores, 1)


def strip_tiles(tiles: int, cores: int, strip_bytes: int = STRIP_BYTES) -> int:
    """Tiles in a strip: as many as a task's memory takes, and few enough to keep the cores busy.

    With s strips there are s (s + 1) / 2 tasks, four for each core at least, so s grows with the root
    of the number of tasks; each tile is copied s times and each row leaves s tasks.
    """
    return max(1, min(strip_bytes // TILE_BYTES, tiles // math.ceil(math.sqrt(8 * cores))))


def tile_join(
    df: DataFrame,
    kernel: Kernel | None,
    schema: str,
    key: str,
    vec: str,
    extra: dict[str, str] | None = None,
    right: DataFrame | None = None,
    tile_rows: int | None = None,
    strip: int | None = None,
    state: Callable[[], State] | None = None,
    in_order: bool = False,
) -> DataFrame:
    """Run ``kernel(a, b, same)`` on every two tiles of ``df``, or on every tile of ``df`` against
    every tile of ``right``. ``extra`` names further columns and their numpy types. Vectors are arrays of
    numbers or, sparse, arrays of (key, value) entries.

    A task takes two strips of tiles and looks at their tiles two by two, so a tile is copied once
    for each strip and not for each tile. A ``state`` in place of a kernel sees all of them and answers
    once a task.

    With ``in_order`` the keys of ``right`` count from zero without gaps, and its tiles and their rows keep
    that order: neighbours lie in one tile or in the next one, and a task sees them in a row."""
    extra = extra or {}
    sparse = is_sparse(df, vec)
    tiles = tile_count(df, vec, tile_rows)
    cores = df.sparkSession.sparkContext.defaultParallelism
    held = int(df.sparkSession.conf.get(STRIP_SETTING, str(STRIP_BYTES)))
    size = strip or strip_tiles(tiles, cores, held)
    strips = math.ceil(tiles / size)
    one = _pack(df, key, vec, extra, tiles).withColumn(
        "strip", F.floor(F.col("tile") / F.lit(size)).cast("long")
    )
    symmetric = right is None

    def meet(packed: DataFrame, others: int) -> DataFrame:
        """A copy of each tile for every strip on the other side."""
        numbers = F.sequence(F.lit(0), F.lit(others - 1)).cast("array<long>")
        return packed.withColumn("other", F.explode(numbers))

    if symmetric:
        lo, hi = F.least("strip", "other"), F.greatest("strip", "other")
        met = meet(one, strips).withColumn("pair", lo * strips + hi).withColumn("side", F.lit(0))
        other_strips, n_pairs = strips, strips * (strips + 1) // 2
    else:
        other = tile_count(right, vec, tile_rows)
        other_size = strip or strip_tiles(other, cores, held)
        other_strips = math.ceil(other / other_size)
        place = F.floor(F.col(key) / math.ceil(max(right.count(), 1) / other)) if in_order else None
        two = _pack(right, key, vec, extra, other, place).withColumn(
            "strip", F.floor(F.col("tile") / F.lit(other_size)).cast("long")
        )
        left_met = meet(one, other_strips).withColumn(
            "pair", F.col("strip") * other_strips + F.col("other")
        )
        right_met = meet(two, strips).withColumn(
            "pair", F.col("other") * other_strips + F.col("strip")
        )
        met = left_met.withColumn("side", F.lit(0)).unionByName(
            right_met.withColumn("side", F.lit(1))
        )
        n_pairs = strips * other_strips
    met = met.drop("other")

    def blocks(table: pa.Table):
        """Every two tiles that meet in a task; the lower one of a single table comes first."""
        tile, side, own = (table.column(c).to_pylist() for c in ("tile", "side", "strip"))
        rows = sorted(range(table.num_rows), key=lambda i: (side[i], tile[i]))
        if not symmetric:
            left = [i for i in rows if side[i] == 0]
            yield from ((i, j, False) for i in left for j in rows if side[j] == 1)
            return
        within = table.column("pair")[0].as_py()
        within = within // other_strips == within % other_strips
        for i in rows:
            for j in rows:
                if tile[i] <= tile[j] and (within or own[i] != own[j]):
                    yield i, j, i == j

    def pieces(table: pa.Table):
        for i, j, same in blocks(table):
            a = _unpack(table, i, extra, sparse).parts(BLOCK_ROWS)
            b = a if same else _unpack(table, j, extra, sparse).parts(BLOCK_ROWS)
            for p, x in enumerate(a):
                for q in range(p if same else 0, len(b)):
                    yield x, b[q], same and p == q

    def run(table: pa.Table) -> pa.Table:
        out = []
        work, met = state() if state else None, False
        for a, b, same in pieces(table):
            met = True
            if work is not None:
                work.add(a, b, same)
                continue
            found = kernel(a, b, same)
            if found is not None:
                out.append(pa.table(found))
        # Hashing may leave a strip of one side empty; its tasks have met no rows.
        if work is not None and met:
            lo, hi = divmod(table.column("pair")[0].as_py(), other_strips)
            found = work.rows(lo, hi)
            if found is not None:
                out.append(pa.table(found))
        if not out:
            return pa.table({n: [] for n in names}).cast(empty)
        return pa.concat_tables(out, promote_options="permissive")

    types = {"long": pa.int64(), "double": pa.float64(), "int": pa.int32()}
    fields = [f.split() for f in schema.split(", ")]
    names = [f[0] for f in fields]
    empty = pa.schema(
        [
            (n, types[t] if t in types else pa.list_(types[t.removeprefix("array<")[:-1]]))
            for n, t in fields
        ]
    )
    # A fixed number of partitions: the blocks are small in bytes but heavy in arithmetic, so they
    # must not be merged by size.
    spread = met.repartition(min(max(2 * n_pairs, 1), MAX_TASKS), "pair")
    return spread.groupBy("pair").applyInArrow(run, schema)


# ------------------------------------------------------------ distances


def unit(vec) -> F.Column:
    """Vector scaled to length one; a zero vector stays zero."""
    col = F.col(vec) if isinstance(vec, str) else vec
    norm = F.sqrt(F.aggregate(col, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(col, lambda x: x / norm)).otherwise(col)


def with_metric(df: DataFrame, vec: str, metric: str) -> DataFrame:
    if metric == "cosine":
        return df.withColumn(vec, unit(vec))
    if metric == "euclidean":
        return df
    raise ValueError(f"unknown metric {metric}")


def distances(a: Tile, b: Tile, same: bool, metric: str) -> np.ndarray:
    if metric == "cosine":
        d = np.maximum(1.0 - a.x @ b.x.T, 0.0)
    else:
        # Around a common centre, squares are as small as the spread and keep their digits.
        centre = a.x.mean(0) if len(a.x) else 0.0
        x, y = a.x - centre, b.x - centre
        d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2.0 * (x @ y.T)
        d = np.sqrt(np.maximum(d, 0.0))
    if same:
        np.fill_diagonal(d, 0.0)
    return d
