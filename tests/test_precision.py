"""Distances far from the origin, and what runs leave in the lake."""

import numpy as np

from topiclake.operators.kmeans import _squared
from topiclake.operators.tiles import Tile, distances, strip_tiles, tile_join
from topiclake.plans import sweep
from topiclake.sources.catalog import Catalog


def test_distances_keep_their_digits_far_from_the_origin():
    rng = np.random.default_rng(1)
    x = 1e4 + rng.normal(0, 1e-3, (40, 64))
    y = np.vstack([x[:3], 1e4 + rng.normal(0, 1e-3, (20, 64))])
    exact = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
    a, b = Tile(np.arange(40), x), Tile(np.arange(23) + 100, y)
    assert np.allclose(distances(a, b, False, "euclidean"), exact, rtol=1e-6, atol=1e-8)
    assert np.allclose(_squared(x, y), exact**2, rtol=1e-6, atol=1e-13)


def test_runs_and_labels_are_kept(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    runs = [{"name": "Kmeans-1", "params": {"k": 3}, "metrics": {"silhouette": 0.5}}]
    sweep.record(catalog, runs)
    sweep.record(catalog, runs)
    rows = catalog.load("results", "runs").collect()
    assert len(rows) == 2 and rows[0].params == {"k": "3"} and len({r.run_id for r in rows}) == 2
    posts = spark.createDataFrame([(1, "a"), (2, "b")], "SK_post long, post string")
    fitted = spark.createDataFrame([(1, 0), (2, -1)], "SK_post long, labels int")
    sweep.record_labels(catalog, posts, fitted)
    assert {tuple(r) for r in catalog.load("results", "labels").collect()} == {(1, "a", 0), (2, "b", -1)}


def test_strips_give_the_blocks_of_single_tiles(spark):
    """Any strip size sees every two rows once, and copies a tile once per strip."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    other = spark.createDataFrame(rows[:23], "id long, v array<double>")

    def pairs(a, b, same):
        i, j = np.triu_indices(len(a.ids), 1) if same else map(np.ravel, np.indices((len(a.ids), len(b.ids))))
        return {"a": a.ids[i], "b": b.ids[j]}

    def listed(strip, right=None):
        out = tile_join(df, pairs, "a long, b long", "id", "v", right=right, tile_rows=6, strip=strip)
        return sorted((r.a, r.b) if right is not None else (min(r.a, r.b), max(r.a, r.b)) for r in out.collect())

    every = sorted((i, j) for i in range(60) for j in range(i + 1, 60))
    crossed = sorted((i, j) for i in range(60) for j in range(23))
    for strip in (1, 3, 50):
        assert listed(strip) == every
        assert listed(strip, other) == crossed
    assert strip_tiles(10_000, 8) == 8 and strip_tiles(5, 8) == 1
