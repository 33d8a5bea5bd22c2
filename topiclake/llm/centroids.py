"""Centroid clustering of integer vectors with a table of pivot distances (LAESA).

Every vector's distances to a few fixed pivots are computed once and written down. By the triangle
inequality the difference between a vector's and a centroid's distance to the same pivot is a lower
bound of their own distance. In each round a vector is first measured against the centroid with the
least bound; only centroids whose bound does not exceed what is known then are measured too. The
distances that decide are exact integers, bounds carry a slack for their rounding, so the result is that
of measuring everything.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topiclake.session import stage

# Vectors, those of the least hash, among which pivots are chosen; and pivots.
CANDIDATES, PIVOTS = 256, 16
# Components are below this, so that squared distances of up to 64 components fit 63 bits.
LARGEST = 1 << 27
# Vectors of a step inside a task.
STEP = 8192


@dataclass
class Clustering:
    """``rows``: (_id, cluster, distance); ``centroids``: integer matrix; ``measured``: exact
    distances computed per round, starting with the first one."""

    rows: DataFrame
    centroids: np.ndarray
    measured: list[int]


def whole_vectors(df: DataFrame, vec: str, width: int, scale: int) -> DataFrame:
    """The rows whose vector has ``width`` components, none null or not finite, as ``_q``: floor(scale * x)."""
    x = F.col(vec).cast("array<double>")
    kept = df.filter(
        (F.size(x) == width)
        & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    )
    too_large = F.exists(x, lambda v: F.abs(v) * scale >= LARGEST)
    value = F.when(
        too_large, F.raise_error(F.lit(f"components of {LARGEST / scale:g} or more have no exact distance")).cast("array<int>")
    ).otherwise(F.transform(x, lambda v: F.floor(v * scale).cast("int")))
    return kept.withColumn("_q", value)


def choose_pivots(candidates: np.ndarray, n: int) -> np.ndarray:
    """Pivots far apart: each has the greatest sum of distances to those before, the first to row 0."""
    if not len(candidates):
        return candidates
    x = candidates.astype(np.float64)
    total = np.sqrt(((x - x[0]) ** 2).sum(1))
    chosen: list[int] = []
    while len(chosen) < min(n, len(x)):
        total[chosen] = -1
        new = int(total.argmax())
        chosen.append(new)
        total += np.sqrt(((x - x[new]) ** 2).sum(1))
    return candidates[chosen]


def pivot_distances(q: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of integer rows to the pivots; the squares are exact, the roots rounded once."""
    out = np.empty((len(q), len(pivots)))
    for i, p in enumerate(pivots):
        d = q - p
        out[:, i] = np.sqrt((d * d).sum(1).astype(np.float64))
    return out


def nearest(
    q: np.ndarray, table: np.ndarray, centroids: np.ndarray, to_pivots: np.ndarray
) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (of equal ones the smallest number), squared distance, and how many were measured.

    ``table`` are the vectors' distances to the pivots, ``to_pivots`` those of the centroids.
    """
    n, k = len(q), len(centroids)
    bound = np.zeros((n, k))
    for i in range(table.shape[1]):
        np.maximum(bound, np.abs(table[:, i, None] - to_pivots[None, :, i]), out=bound)
    # Roots below 2^32 are off by less than 2^-20; a bound is lowered by more than both.
    bound = np.maximum(bound - 1e-5, 0.0) ** 2 * (1 - 1e-12)
    first = bound.argmin(1)
    d = q - centroids[first]
    best, cluster = (d * d).sum(1), first
    measured = n
    for c in range(k):
        left = np.flatnonzero((bound[:, c] <= best) & (first != c))
        if len(left):
            d = q[left] - centroids[c]
            found = (d * d).sum(1)
            better = (found < best[left]) | ((found == best[left]) & (c < cluster[left]))
            best[left[better]], cluster[left[better]] = found[better], c
            measured += len(left)
    return cluster, best, measured


def _ints(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width).astype(np.int64)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            yield batch.slice(at, STEP)


def cluster(
    df: DataFrame, key: str, vec: str, order: Column, k: int = 8, rounds: int = 10,
    width: int = 64, scale: int = 1024, pivots: int = PIVOTS,
) -> Clustering:
    """k-means on floor(scale * x) in exact arithmetic, started from the ``k`` rows least in ``order``.

    Rows without ``width`` components, or with a null, NaN or infinite one, are left out; components of
    2^27 / scale or more are refused, because their distances do not fit a long. Ties go to the smaller
    number; a centroid is replaced by the floor of its vectors' mean; an empty one stays. Rows with equal
    ``order`` start in the order of their vectors. With fewer than ``k`` rows there are as many
    centroids as rows, with none an empty result. Repeated rows count as often as they come.
    """
    spark = df.sparkSession
    name = F.col(f"`{key}`")
    whole = whole_vectors(df.select(name.alias("_id"), F.col(f"`{vec}`").alias("_v"), order.alias("_o")), "_v", width, scale)
    whole = whole.select("_id", "_o", "_q")
    least = whole.orderBy("_o", "_q").limit(max(k, CANDIDATES)).collect()  # bounded, documented
    sample = np.array([r._q for r in least], np.int64).reshape(-1, width)
    centroids, fixed = sample[:k].copy(), choose_pivots(sample, pivots)
    id_type = whole.schema["_id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            found = pivot_distances(_ints(batch.column(1), width), fixed)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, found.size + 1, max(found.shape[1], 1))[: len(found) + 1], pa.int32()), pa.array(found.ravel())
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["_id", "_q", "_d"])

    table = stage(
        whole.select("_id", "_q").mapInArrow(measure, f"_id {id_type}, _q array<int>, _d array<double>"), "pivots"
    )
    if not len(centroids):
        empty = table.select("_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return Clustering(empty, centroids, [])

    def assigned(centroids: np.ndarray):
        to_pivots = pivot_distances(centroids, fixed)

        def run(batch: pa.RecordBatch, q: np.ndarray):
            d = batch.column(batch.schema.get_field_index("_d"))
            return nearest(q, d.flatten().to_numpy().reshape(len(q), -1), centroids, to_pivots)

        return run

    measured = []
    for _ in range(rounds):
        assign = assigned(centroids)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """One row per centroid and task: rows, sums, distances that were computed."""
            total = np.zeros((len(centroids), width + 2), np.int64)
            for batch in _steps(batches):
                q = _ints(batch.column(0), width)
                own, _, cost = assign(batch, q)
                hit = np.flatnonzero(np.bincount(own, minlength=len(centroids)))
                for c in hit.tolist():
                    mine = own == c
                    total[c, :width] += q[mine].sum(0)
                    total[c, width] += mine.sum()
                total[0, width + 1] += cost
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.int64()))], ["c", "t"]
            )

        partial = table.select("_q", "_d").mapInArrow(sums, "c int, t array<long>")
        total = partial.groupBy("c").agg(F.array(*(F.sum(F.get("t", F.lit(i))) for i in range(width + 2))).alias("t"))
        measured.append(0)
        centroids = centroids.copy()
        for row in total.collect():  # k rows
            *sum_, count, cost = row.t
            measured[-1] += cost
            if count:
                centroids[row.c] = [s // count for s in sum_]

    assign = assigned(centroids)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            own, distance, _ = assign(batch, _ints(batch.column(1), width))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(own.astype(np.int32)), pa.array(distance)], ["_id", "cluster", "distance"]
            )

    rows = stage(table.mapInArrow(label, f"_id {id_type}, cluster int, distance long"), "clusters")
    return Clustering(rows, centroids, measured)


def with_inertia(found: Clustering, key: str) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) per clustered row."""
    spark = found.rows.sparkSession
    per = {r.cluster: r.n for r in found.rows.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}  # k rows
    facts = spark.createDataFrame(
        [(c, n, sum(per.values()), ",".join(map(str, found.centroids[c].tolist()))) for c, n in per.items()],
        "cluster int, cluster_inertia long, inertia long, _text string",
    ).withColumn("centroid_sha256", F.sha2("_text", 256))
    return found.rows.join(F.broadcast(facts), "cluster").select(
        F.col("_id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
