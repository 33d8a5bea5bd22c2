"""Tiles of one task: empty strips, bounded blocks, and what tasks say about them."""

import numpy as np

from pyspark.sql import functions as F

from topiclake.operators import tiles
from topiclake.operators import metrics
from topiclake.operators.dbscan import Dbscan, dbscan
from topiclake.operators.tiles import tile_join


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")


def test_a_strip_that_hashing_leaves_empty_has_no_border_rows(spark):
    """One core among many rows: most strips of cores hold no row, and their tasks return none."""
    x = np.array([[0.0, 0.0], [1.0, 0.0], [-1.0, 0.0], [0.0, 1.0]] + [[50.0 + 9 * i, 0.0] for i in range(20)])
    wanted = [0] * 4 + [-1] * 20
    for rows in (1, 2, None):
        found = dbscan(frame(spark, x), "id", "vec", [Dbscan(1.1, 4)], tile_rows=rows)
        assert [r.label for r in found.orderBy("id").collect()] == wanted


def test_an_empty_strip_of_cores(spark):
    """Two rows of the right table in twelve tiles."""
    left = frame(spark, np.arange(24.0).reshape(12, 2))
    right = frame(spark, np.arange(24.0).reshape(12, 2) + 0.5)

    class First(tiles.RowState):
        both = False

        def block(self, a, b, same):
            return tiles.distances(a, b, same, "euclidean")

        def meet(self, mine, others, block):
            return (block.min(1),)

        def merged(self, old, new):
            return (np.minimum(old[0], new[0]),)

        def rows(self, lo, hi):
            ids, (near,) = self.joined()
            return {"id": ids, "near": near}

    out = tile_join(left, None, "id long, near double", "id", "vec", right=right, tile_rows=1, strip=1, state=First)
    best = {}
    for r in out.collect():
        best[r.id] = min(r.near, best.get(r.id, np.inf))
    assert len(best) == 12 and np.allclose(list(best.values()), np.sqrt(0.5))


def test_blocks_are_bounded_however_many_rows_a_tile_has(spark):
    n = 2500
    df = frame(spark, np.arange(2.0 * n).reshape(n, 2))

    def seen(a, b, same):
        pairs = len(a.ids) * (len(a.ids) - 1) // 2 if same else len(a.ids) * len(b.ids)
        return {"rows": np.array([max(len(a.ids), len(b.ids))]), "pairs": np.array([pairs])}

    out = tile_join(df, seen, "rows long, pairs long", "id", "vec", tile_rows=n).collect()
    assert max(r["rows"] for r in out) <= tiles.BLOCK_ROWS
    assert sum(r["pairs"] for r in out) == n * (n - 1) // 2


def test_undefined_settings_compare_no_rows(spark, monkeypatch):
    """One cluster and noise: -1 without a pass over pairs; among others, only defined settings are compared."""
    x = np.random.default_rng(4).normal(size=(40, 3))
    df = frame(spark, x)
    passes = []
    real = metrics.silhouettes
    monkeypatch.setattr(metrics, "silhouettes", lambda rows, *a: passes.append(rows) or real(rows, *a))
    labels = [(s, i, [0 if i else -1, i % 3 - 1, i % 2][s]) for s in range(3) for i in range(40)]
    table = spark.createDataFrame(labels, "setting int, id long, label int")
    alone = metrics.evaluate_many(df, "id", "vec", table.filter("setting = 0")).first()
    assert not passes and alone.n_clusters == 1 and alone.silhouette_avg == -1
    found = {r.setting: r for r in metrics.evaluate_many(df, "id", "vec", table).collect()}
    assert passes[0].first().sets is not None and len(passes[0].first().sets) == 2
    assert found[0].silhouette_avg == found[0].davies_bouldin == -1 and found[0].n_clusters == 1
    for s, own in ((1, [i % 3 - 1 for i in range(40)]), (2, [i % 2 for i in range(40)])):
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        values = []
        for i in range(40):
            if own[i] == -1:
                continue
            mean = {c: d[i, [j for j in range(40) if own[j] == c and j != i]].mean() for c in set(own) - {-1}}
            a, b = mean.pop(own[i]), min(mean.values())
            values.append((b - a) / max(a, b))
        assert abs(found[s].silhouette_avg - np.mean(values)) < 1e-9


def test_silhouettes_of_many_clusters(spark):
    """Members in order of their clusters, over tiles and strips of any size: the sums of all clusters do not leave."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(90, 3))
    x[7] = x[8]
    sets = np.stack([np.arange(90) % 30, rng.integers(-1, 4, 90), np.where(np.arange(90) < 70, 3, rng.integers(-1, 20, 90))], 1)
    rows = [(1000 + i, v.tolist(), s.tolist()) for i, (v, s) in enumerate(zip(x, sets))]
    df = spark.createDataFrame(rows, "id long, vec array<double>, sets array<long>")
    expected = {(r.setting, r.id): r.silhouette for r in metrics.silhouettes(df, "id", "vec", 7).collect()}
    assert len(expected) == (sets != -1).sum()
    for many, size in (([0, 1, 2], 7), ([0, 2], 11), ([1], 200)):
        found = {(r.setting, r.id): r.silhouette for r in metrics.silhouettes(df, "id", "vec", size, many).collect()}
        assert found.keys() == expected.keys()
        assert max(abs(found[k] - v) for k, v in expected.items()) < 1e-9
    # A row leaves each of 9 strips of members with its own cluster, the nearest one and those cut at the ends.
    sums = metrics._cluster_sums(df.withColumn("sets", F.slice("sets", 1, 1)), "id", "vec", [0], 10)
    assert sums.count() <= 90 * 9 * 4 < 90 * 9 * 30
