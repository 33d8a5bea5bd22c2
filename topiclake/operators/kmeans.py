"""K-means for many runs at once: one scan per iteration serves every k, start and restart.

The driver holds the centres only, whose number depends on the runs and not on the rows. Tasks add
up sums per centre, so one row per task and centre is shuffled. k-means++ tries several rows for each next
centre and takes the one that leaves the least cost; the pass that weighs these trials draws the rows to
try after each of them, so a centre costs one pass. A centre without rows moves to the row that is farthest
from its own centre.

A table whose counted size is small is copied to the tasks instead, and each takes some of the runs from their
start to their end: the same steps over all rows, without a job for each of hundreds of iterations.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topiclake.operators.tiles import TILE_BYTES, _matrix, _pack
from topiclake.session import stage

# Largest table, in bytes of its vectors, of which tasks take copies; and its rows that are looked at together.
SMALL_BYTES, BLOCK_ROWS = 64 << 20, 8192


@dataclass(frozen=True)
class Run:
    k: int
    init: str = "k-means++"
    seed: int = 42


@dataclass
class Fitted:
    run: Run
    centers: np.ndarray
    inertia: float


@dataclass
class Held:
    """All rows, in the memory of a task."""

    ids: np.ndarray
    x: np.ndarray

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i in range(0, len(self.ids), BLOCK_ROWS):
            yield self.ids[i:i + BLOCK_ROWS], self.x[i:i + BLOCK_ROWS]


Rows = DataFrame | Held


def _uniform(ids: np.ndarray, seed: int, step: int) -> np.ndarray:
    """Reproducible numbers in (0, 1) per row id, by the finalizer of splitmix64."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64) + np.uint64((seed * 1_000_003 + step + 1) % (1 << 63)) * np.uint64(
            0x9E3779B97F4A7C15
        )
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    middle = c.mean(0)
    x, c = x - middle, c - middle
    d = (x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2.0 * (x @ c.T)
    return np.maximum(d, 0.0)


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    ids = _matrix(pa.chunked_array([batch.column(0)]), np.int64)
    return ids, _matrix(pa.chunked_array([batch.column(1)]), np.float64)


def _blocks(batches) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    return (_columns(batch) for batch in batches if batch.num_rows)


def _least(rows: Rows, take: list[int], rank) -> list[list]:
    """For each run the rows of the least ranks: (rank, id, x), as many as ``take``.

    ``rank(run, ids, x)`` ranks the rows of a batch; infinite ranks do not count.
    """

    def least(blocks):
        best: list = [[] for _ in take]
        for ids, x in blocks:
            for r, n in enumerate(take):
                if not n:
                    continue
                ranks = rank(r, ids, x)
                first = np.lexsort((ids, ranks))[:n]
                found = list(zip(ranks[first], ids[first], x[first]))
                best[r] = sorted(best[r] + found, key=lambda t: t[:2])[:n]
        return [[f for f in b if f[0] < np.inf] for b in best]

    if isinstance(rows, Held):
        return least(rows.blocks())

    def candidates(batches):
        flat = [(r, p, i, v) for r, b in enumerate(least(_blocks(batches))) for p, i, v in b]
        yield pa.RecordBatch.from_pydict({
            "run": pa.array([f[0] for f in flat], pa.int32()),
            "rank": pa.array([float(f[1]) for f in flat], pa.float64()),
            "id": pa.array([int(f[2]) for f in flat], pa.int64()),
            "x": pa.array([f[3] for f in flat], pa.list_(pa.float64())),
        })

    found = rows.mapInArrow(candidates, "run int, rank double, id long, x array<double>")
    order = Window.partitionBy("run").orderBy("rank", "id")
    found = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= max(take))
    out: list = [[] for _ in take]
    for row in found.orderBy("run", "place").toLocalIterator():
        # Every task may offer as many rows as the run takes in all.
        if row["place"] <= take[row["run"]]:
            out[row["run"]].append((row["rank"], row["id"], np.array(row["x"])))
    return out


def _try(rows: Rows, runs: list[Run], chosen: list, tried: list, step: int) -> dict:
    """(cost, rows to try next) by run and trial, in one pass.

    ``tried`` has the rows under trial of each run, none before the first trial. The cost is the sum of
    squared distances to the nearest centre with the trial among the centres; the least of −log(u) / weight
    over all rows is a draw in proportion to the weight, here what the row itself costs.
    """

    def weighed(blocks):
        cost, best = {}, {}
        for ids, x in blocks:
            for r, run in enumerate(runs):
                if chosen[r] is None:
                    continue
                near = _squared(x, chosen[r]).min(1)
                trials = _squared(x, tried[r]) if len(tried[r]) else np.full((len(x), 1), np.inf)
                for t in range(trials.shape[1]):
                    left = np.minimum(near, trials[:, t])
                    cost[r, t] = cost.get((r, t), 0.0) + float(left.sum())
                    for j in range(_trials(run.k)):
                        with np.errstate(divide="ignore"):
                            rank = -np.log(_uniform(ids, run.seed, 64 * step + j)) / left
                        i = np.flatnonzero(rank == rank.min())
                        i = i[ids[i].argmin()]
                        new = (float(rank[i]), int(ids[i]), x[i])
                        if rank[i] < np.inf and new[:2] < best.get((r, t, j), (np.inf,))[:2]:
                            best[r, t, j] = new
        return cost, best

    if isinstance(rows, Held):
        cost, best = weighed(rows.blocks())
        draws = {(r, t): [best.get((r, t, j)) for j in range(_trials(runs[r].k))] for r, t in cost}
        return {k: (cost[k], [new[2] for new in found if new]) for k, found in draws.items()}

    def weigh(batches):
        cost, best = weighed(_blocks(batches))
        keys = [(r, t, j) for r, t in cost for j in range(_trials(runs[r].k))]
        found = [best.get(k) for k in keys]
        yield pa.RecordBatch.from_pydict({
            "run": pa.array([k[0] for k in keys], pa.int32()),
            "trial": pa.array([k[1] for k in keys], pa.int32()),
            "draw": pa.array([k[2] for k in keys], pa.int32()),
            "cost": pa.array([cost[k[:2]] for k in keys], pa.float64()),
            "rank": pa.array([f and f[0] for f in found], pa.float64()),
            "id": pa.array([f and f[1] for f in found], pa.int64()),
            "x": pa.array([f and f[2] for f in found], pa.list_(pa.float64())),
        })

    schema = "run int, trial int, draw int, cost double, rank double, id long, x array<double>"
    first = F.min(F.when(F.col("rank").isNotNull(), F.struct("rank", "id", "x"))).alias("first")
    parts = rows.mapInArrow(weigh, schema).groupBy("run", "trial", "draw").agg(F.sum("cost").alias("cost"), first)
    out: dict = {}
    for row in sorted(parts.collect(), key=lambda r: (r.run, r.trial, r.draw)):
        cost, following = out.setdefault((row.run, row.trial), (row.cost, []))
        if row.first is not None:
            following.append(np.array(row.first.x))
    return out


def _trials(k: int) -> int:
    """Rows tried for each next centre."""
    return 2 + int(np.log(k))


def _starts(rows: Rows, runs: list[Run]) -> list[np.ndarray]:
    take = [r.k if r.init == "random" else 1 for r in runs]
    drawn = _least(rows, take, lambda r, ids, x: -np.log(_uniform(ids, runs[r].seed, 0)))
    centers = [np.array([x for _, _, x in d]) for d in drawn]
    tried: list = [[] for _ in runs]
    for step in range(1, max(r.k for r in runs) + 1):
        open_ = [
            c if r.init != "random" and len(c) and len(c) < r.k and (step == 1 or len(t)) else None
            for r, c, t in zip(runs, centers, tried)
        ]
        if all(c is None for c in open_):
            break
        weighed = _try(rows, runs, open_, tried, step)
        for r, c in enumerate(open_):
            if c is None:
                continue
            options = [(weighed[r, t][0], t) for t in range(max(len(tried[r]), 1))]
            best = min(options)[1]
            if len(tried[r]):
                centers[r] = np.vstack([c, tried[r][best]])
            # No row is left to try where every row is a centre already.
            tried[r] = np.array(weighed[r, best][1])
    return centers


def _relocated(
    rows: Rows, centers: list[np.ndarray], found: list[tuple]
) -> list[tuple[np.ndarray, np.ndarray]]:
    """(size, total) per run; a centre without rows takes the row farthest from its own centre."""
    out = [(size.copy(), total.copy()) for size, total, _ in found]
    take = [int((size == 0).sum()) for size, _ in out]
    if not any(take):
        return out

    def far(r, ids, x):
        cost = _squared(x, centers[r]).min(1)
        return np.where(cost > 0, -cost, np.inf)

    for r, moved in enumerate(_least(rows, take, far)):
        size, total = out[r]
        for slot, (_, _, x) in zip(np.flatnonzero(size == 0), moved):
            owner = int(_squared(x[None, :], centers[r]).argmin())
            size[owner], total[owner] = size[owner] - 1, total[owner] - x
            size[slot], total[slot] = 1, x
    return out


def _pass(rows: Rows, centers: list[np.ndarray]):
    """Assign every row in every run: (sizes, sums, cost) per centre of the stacked centres."""
    stacked = np.vstack(centers)
    ends = np.cumsum([0] + [len(c) for c in centers])

    def added_up(blocks):
        size = np.zeros(len(stacked), np.int64)
        cost = np.zeros(len(stacked))
        total = np.zeros_like(stacked)
        for _, x in blocks:
            d = _squared(x, stacked)
            at = np.arange(len(x))
            member = np.zeros(d.shape)
            for lo, hi in zip(ends[:-1], ends[1:]):
                near = lo + d[:, lo:hi].argmin(1)
                member[at, near] = 1.0
                size += np.bincount(near, minlength=len(stacked))
                cost += np.bincount(near, d[at, near], len(stacked))
            total += member.T @ x
        return size, cost, total

    if isinstance(rows, Held):
        size, cost, total = added_up(rows.blocks())
        return [(size[lo:hi], total[lo:hi], float(cost[lo:hi].sum())) for lo, hi in zip(ends[:-1], ends[1:])]

    def sums(batches):
        size, cost, total = added_up(_blocks(batches))
        full = np.nonzero(size)[0]
        yield pa.RecordBatch.from_pydict({
            "slot": pa.array(full, pa.int64()), "size": size[full], "cost": cost[full],
            "total": pa.array(list(total[full]), pa.list_(pa.float64())),
        })

    parts = rows.mapInArrow(sums, "slot long, size long, cost double, total array<double>")
    added = parts.groupBy("slot").agg(
        F.sum("size").alias("size"), F.sum("cost").alias("cost"),
        Summarizer.sum(array_to_vector(F.col("total"))).alias("total"),
    )
    size, cost = np.zeros(len(stacked), np.int64), np.zeros(len(stacked))
    total = np.zeros_like(stacked)
    for row in added.toLocalIterator():
        size[row["slot"]], cost[row["slot"]] = row["size"], row["cost"]
        total[row["slot"]] = row["total"].toArray()
    return [
        (size[lo:hi], total[lo:hi], float(cost[lo:hi].sum()))
        for lo, hi in zip(ends[:-1], ends[1:])
    ]


def _settled(rows: Rows, runs: list[Run], limit: float, max_iter: int) -> list[Fitted]:
    """The runs from their first centres until these stand still."""
    centers = _starts(rows, runs)
    active = list(range(len(runs)))
    inertia = [0.0] * len(runs)
    for _ in range(max_iter):
        still = []
        found = _pass(rows, [centers[i] for i in active])
        sums = _relocated(rows, [centers[i] for i in active], found)
        for i, (size, total), (_, _, cost) in zip(active, sums, found):
            new = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centers[i])
            shift = float(((new - centers[i]) ** 2).sum())
            centers[i], inertia[i] = new, cost
            if shift > limit:
                still.append(i)
        active = still
        if not active:
            break
    for i, (_, _, cost) in enumerate(_pass(rows, centers)):
        inertia[i] = cost
    return [Fitted(r, c, v) for r, c, v in zip(runs, centers, inertia)]


def _dealt(
    rows: DataFrame, key: str, vec: str, runs: list[Run], limit: float, max_iter: int, size: int
) -> list[Fitted]:
    """``_settled`` with the runs dealt to tasks, each of which takes a copy of the small table."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tasks = min(len(runs), 2 * cores)
    tiles = _pack(rows, key, vec, {}, math.ceil(size / TILE_BYTES))
    groups = F.sequence(F.lit(0), F.lit(tasks - 1))
    copies = tiles.withColumn("group", F.explode(groups)).repartitionByRange(tasks, "group")

    def work(table: pa.Table) -> pa.Table:
        mine = list(range(table.column("group")[0].as_py(), len(runs), tasks))
        ids = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table.column("ids")])
        x = np.concatenate([np.frombuffer(x.as_buffer(), np.float64) for x in table.column("x")])
        order = np.argsort(ids, kind="stable")
        held = Held(ids[order], x.reshape(len(ids), -1)[order])
        found = _settled(held, [runs[i] for i in mine], limit, max_iter)
        return pa.table({
            "run": pa.array(mine, pa.int32()), "inertia": pa.array([f.inertia for f in found], pa.float64()),
            "k": pa.array([len(f.centers) for f in found], pa.int32()),
            "centers": pa.array([f.centers.ravel() for f in found], pa.list_(pa.float64())),
        })

    found = copies.groupBy("group").applyInArrow(work, "run int, inertia double, k int, centers array<double>")
    # Centres only, whose number depends on the runs and not on the rows.
    rows_of = sorted(found.collect(), key=lambda r: r.run)
    return [Fitted(runs[r.run], np.array(r.centers).reshape(r.k, -1), r.inertia) for r in rows_of]


def fit_kmeans(
    df: DataFrame, key: str, vec: str, runs: list[Run], max_iter: int = 300, tol: float = 1e-4
) -> list[Fitted]:
    """Lloyd's iterations of all runs side by side; a run leaves when its centres stand still.

    A centre that loses all its rows takes the row that is farthest from its own centre; it stays where
    it is if every row lies on a centre.
    """
    rows = stage(df.select(F.col(key).cast("long").alias(key), vec), "points")
    var = Summarizer.variance(array_to_vector(F.col(vec)))
    found = rows.agg(var.alias("v"), F.count("*").alias("n"), F.max(F.size(vec)).alias("width")).first()
    limit = tol * float(found["v"].toArray().mean())
    size = 8 * found["n"] * max(found["width"] or 1, 1)
    if 0 < size <= SMALL_BYTES and runs:
        return _dealt(rows, key, vec, runs, limit, max_iter, size)
    return _settled(rows, runs, limit, max_iter)


def assign(df: DataFrame, key: str, vec: str, models: list[Fitted]) -> DataFrame:
    """(setting, key, label): nearest centre of every row in every model."""
    centers = [m.centers for m in models]

    def nearest(batches):
        for batch in batches:
            ids, x = _columns(batch)
            labels = [_squared(x, c).argmin(1).astype(np.int32) for c in centers]
            yield pa.RecordBatch.from_pydict({
                "setting": np.repeat(np.arange(len(centers), dtype=np.int32), len(ids)),
                key: np.tile(ids, len(centers)),
                "label": np.concatenate(labels) if labels else np.zeros(0, np.int32),
            })

    rows = df.select(F.col(key).cast("long").alias(key), vec)
    return rows.mapInArrow(nearest, f"setting int, {key} long, label int")


def best_of(models: list[Fitted], k: int, init: str, restarts: int, seed: int = 42) -> Fitted:
    """Cheapest of the first restarts; more restarts reuse the runs of fewer."""
    wanted = {seed + i for i in range(restarts)}
    mine = [m for m in models if (m.run.k, m.run.init) == (k, init) and m.run.seed in wanted]
    return min(mine, key=lambda m: (m.inertia, m.run.seed))


def inertia_curve(df: DataFrame, key: str, vec: str, ks: list[int]) -> DataFrame:
    """(k, inertia) for the elbow plot; all ks share their scans."""
    models = fit_kmeans(df, key, vec, [Run(k) for k in ks])
    return df.sparkSession.createDataFrame(
        [(m.run.k, m.inertia) for m in models], "k int, inertia double"
    )
