"""Vector operators against plain numpy on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import brute
from topiclake.operators import ensemble, kmeans, metrics, pairs, scaling, tiles
from topiclake.operators.components import connected_components
from topiclake.operators.dbscan import Dbscan, dbscan, spanning_forest
from topiclake.operators.forests import EdgePool, reduced
from topiclake.operators.hdbscan import Hdbscan, hdbscan
from topiclake.operators.hdbscan import reachability_edges as hdbscan_edges
from topiclake.operators.keys import assign_keys, index_within


def frame(spark, x, **cols):
    rows = [
        (i, [float(v) for v in row], *[int(c[i]) for c in cols.values()]) for i, row in enumerate(x)
    ]
    extra = "".join(f", {c} int" for c in cols)
    return spark.createDataFrame(rows, "id long, vec array<double>" + extra).repartition(3)


def blobs(seed, n=120, d=4, k=4, noise=0.15):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(k, d)) * 3
    x = centers[rng.integers(0, k, n)] + rng.normal(size=(n, d)) * 0.5
    loose = rng.random(n) < noise
    x[loose] = rng.normal(size=(loose.sum(), d)) * 5
    return x


def labels_of(df, n, setting=None, label="label"):
    if setting is not None:
        df = df.filter(F.col("setting") == setting)
    got = {r["id"]: r[label] for r in df.collect()}
    assert sorted(got) == list(range(n))
    return np.array([got[i] for i in range(n)])


def same_partition(a, b):
    assert ((a == -1) == (b == -1)).all()
    pairs_ = set(zip(a.tolist(), b.tolist()))
    assert len(pairs_) == len({p[0] for p in pairs_}) == len({p[1] for p in pairs_})


@pytest.mark.parametrize("seed,t", [(0, 0.9), (1, 0.6), (2, 0.3)])
def test_near_duplicates(spark, seed, t):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(150, 3))
    x[40:90] = x[3]                       # a third are exact copies
    x[100:120] = x[5] + rng.normal(size=(20, 3)) * 0.01
    x[7] = x[130] = 0.0
    df = frame(spark, x)
    want = brute.greedy_kept(x, t)
    got = sorted(r.id for r in pairs.kept_ids(df, "id", "vec", t, tile_rows=40).collect())
    assert got == want
    kept = pairs.drop_near_duplicates(df, "id", "vec", t, tile_rows=40)
    assert kept.columns == ["id", "vec"] and kept.count() == len(want)


def test_chain_needs_many_rounds(spark):
    angle = np.arange(40) * 0.1
    x = np.c_[np.cos(angle), np.sin(angle)]
    t = float(np.cos(0.15))
    got = sorted(r.id for r in pairs.kept_ids(frame(spark, x), "id", "vec", t, 16).collect())
    assert got == brute.greedy_kept(x, t)


def test_similar_pairs_fold_copies(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 4))
    x[30:60] = x[2]
    rows = pairs.similar_pairs(frame(spark, x), "id", "vec", 0.8, tile_rows=20).collect()
    sim = brute.cosine(x)
    reps = [i for i in range(90) if not 30 <= i < 60]
    want = {(a, b) for a in reps for b in reps if a < b and sim[a, b] > 0.8} | {(2, 2)}
    assert {(r.a, r.b) for r in rows} == want and len(rows) == len(want)
    total = sum(r.copies_a * r.copies_b if r.a != r.b else r.copies_a * (r.copies_a - 1) // 2
                for r in rows)
    assert total == int((np.triu(sim, 1) > 0.8).sum())


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_neighbours(spark, metric):
    x = blobs(1, 80)
    d = brute.euclid(x) if metric == "euclidean" else np.maximum(1 - brute.cosine(x), 0)
    curve = pairs.kth_neighbor_curve(frame(spark, x), "id", "vec", [1, 5], metric, tile_rows=30)
    for k in (1, 5):
        got = [r.distance for r in curve.filter(F.col("k") == k).orderBy("rank").collect()]
        np.testing.assert_allclose(got, np.sort(np.sort(d, 1)[:, k - 1]), atol=1e-6)


@pytest.mark.parametrize("seed,metric", [(0, "euclidean"), (1, "euclidean"), (2, "cosine")])
def test_dbscan(spark, seed, metric):
    x = blobs(seed)
    if metric == "euclidean":
        d, settings = brute.euclid(x), [Dbscan(0.8, 4), Dbscan(1.2, 8), Dbscan(0.1, 3), Dbscan(30, 5)]
    else:
        d = np.maximum(1 - brute.cosine(x), 0)
        settings = [Dbscan(0.02, 4), Dbscan(0.1, 10), Dbscan(2.4, 5)]
    np.fill_diagonal(d, 0)
    for local in (10**6, 0):
        got = dbscan(frame(spark, x), "id", "vec", settings, metric, 50, local).persist()
        for s, p in enumerate(settings):
            want = brute.dbscan(d, p.eps, p.min_samples)
            assert labels_of(got, len(x), s).tolist() == want.tolist()
        if seed:
            break


@pytest.mark.parametrize("seed,metric", [(0, "euclidean"), (3, "euclidean"), (4, "cosine")])
def test_hdbscan(spark, seed, metric):
    x = blobs(seed, n=90)
    d = brute.euclid(x) if metric == "euclidean" else np.maximum(1 - brute.cosine(x), 0)
    np.fill_diagonal(d, 0)
    settings = [Hdbscan(5, 1), Hdbscan(8, 4), Hdbscan(15, 4)]
    for band in (10**6, 60):
        got = hdbscan(frame(spark, x), "id", "vec", settings, metric, 40, band).persist()
        for s, p in enumerate(settings):
            want = brute.hdbscan(d, p.min_cluster_size, p.min_samples)
            same_partition(labels_of(got, len(x), s), want)
        if seed:
            break


@pytest.mark.parametrize("strip,local", [(None, 10**6), (1, 10**6), (1, 200), (1, 0)])
def test_reachability_tree(spark, strip, local):
    """n - 1 edges of least weight: in one task, by merged strips, and by rounds of joins."""
    x = blobs(3, n=90)
    x[40:60] = x[7]
    d = brute.euclid(x)
    np.fill_diagonal(d, 0)
    got = hdbscan_edges(frame(spark, x), "id", "vec", [1, 4], "euclidean", 12, strip, local).collect()
    for m in (1, 4):
        core = np.sort(d, 1)[:, m - 1]
        w = np.maximum(d, np.maximum(core[:, None], core[None, :]))
        edges = [(r.u, r.v, r.w) for r in got if r.ms == m]
        assert len(edges) == 89
        np.testing.assert_allclose([e[2] for e in edges], [w[u, v] for u, v, _ in edges], atol=1e-7)
        whole = reduced(*(a.ravel() for a in np.indices(w.shape)), w.ravel())
        np.testing.assert_allclose(sum(e[2] for e in edges), whole[2].sum(), atol=1e-6)
        assert len(reduced(*(np.array(c) for c in zip(*edges)))[0]) == 89


def test_hdbscan_over_strips_and_bands(spark):
    x = blobs(3, n=90)
    d = brute.euclid(x)
    settings = [Hdbscan(5, 1), Hdbscan(8, 4)]
    got = hdbscan(frame(spark, x), "id", "vec", settings, "euclidean", 12, 17, 1, 100).persist()
    for s, p in enumerate(settings):
        same_partition(labels_of(got, len(x), s), brute.hdbscan(d, p.min_cluster_size, p.min_samples))


def test_reduced_edges():
    rng = np.random.default_rng(6)
    for n, m in ((1, 3), (2, 5), (30, 20), (30, 300), (200, 4000)):
        u, v = rng.integers(0, n, (2, m))
        w = rng.integers(0, 9, m).astype(float)
        got = reduced(u, v, w)
        parent, want = list(range(n)), []

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for c, a, b in sorted((c, min(a, b), max(a, b)) for a, b, c in zip(u.tolist(), v.tolist(), w.tolist())):
            if root(a) != root(b):
                parent[root(a)] = root(b)
                want.append((a, b, c))
        assert list(zip(*(x.tolist() for x in got))) == want
        pool = EdgePool()
        pool.limit = 7
        for i in range(0, m, 5):
            pool.add(u[i : i + 5], v[i : i + 5], w[i : i + 5])
        assert list(zip(*(x.tolist() for x in pool.forest()))) == want


def test_rows_leave_once_a_strip(spark):
    """With s strips of several tiles, a row leaves s tasks and a tile is copied s times."""
    x = blobs(1, 96)
    df = frame(spark, x)
    seen = []

    class Each(tiles.RowState):
        def block(self, a, b, same):
            return tiles.distances(a, b, same, "euclidean")

        def meet(self, mine, others, block):
            return (np.full(len(mine.ids), len(others.ids)),)

        def merged(self, old, new):
            return (old[0] + new[0],)

        def rows(self, lo, hi):
            ids, (n,) = self.joined()
            return {"id": ids, "met": n.astype(np.int64), "lo": np.full(len(ids), lo), "hi": np.full(len(ids), hi)}

    for strip in (1, 3, 100):
        rows = tiles.tile_join(df, None, "id long, met long, lo long, hi long", "id", "vec", tile_rows=8, strip=strip, state=Each)
        strips = -(-12 // strip)
        per = rows.groupBy("id").agg(F.count("*").alias("n"), F.sum("met").alias("met")).collect()
        assert {(r.n, r.met) for r in per} == {(strips, 96)}
        seen.append(rows.select("lo", "hi").distinct().count())
    assert seen == [78, 10, 1]
    # Larger strips by the session's setting.
    assert tiles.strip_tiles(1000, 8, 64 << 20) == 16 and tiles.strip_tiles(1000, 8, 256 << 20) == 64
    assert tiles.strip_tiles(16, 8) == 2 and tiles.strip_tiles(1, 8) == 1


@pytest.mark.parametrize("strip_bytes", [4 << 20, 64 << 20])
def test_states_do_not_depend_on_strips(spark, monkeypatch, strip_bytes):
    monkeypatch.setattr(metrics, "HELD_SUMS", 50)
    monkeypatch.setattr(tiles, "strip_tiles", lambda n, cores, held: min(n, strip_bytes >> 22))
    x = blobs(4, 90)
    d = brute.euclid(x)
    lab = np.random.default_rng(0).integers(-1, 4, 90)
    s = metrics.silhouette_samples(frame(spark, x, label=lab), "id", "vec", "label", 10)
    mean = np.mean([r.silhouette for r in s.collect()])
    np.testing.assert_allclose(mean, brute.silhouette(x[lab != -1], lab[lab != -1]), atol=1e-9)
    near = {r["id"]: r.near for r in pairs.nearest_distances(frame(spark, x), "id", "vec", 5, tile_rows=10).collect()}
    np.testing.assert_allclose([near[i] for i in range(90)], np.sort(d, 1)[:, :5], atol=1e-6)
    mean = pairs.mean_pair_distance(frame(spark, x), "id", "vec", tile_rows=10).first()[0]
    np.testing.assert_allclose(mean, d[np.triu_indices(90, 1)].mean())
    got = dbscan(frame(spark, x), "id", "vec", [Dbscan(0.8, 4), Dbscan(1.2, 8)], "euclidean", 10)
    for i, p in enumerate([Dbscan(0.8, 4), Dbscan(1.2, 8)]):
        assert labels_of(got, 90, i).tolist() == brute.dbscan(d, p.eps, p.min_samples).tolist()
    assert sorted(r.id for r in pairs.kept_ids(frame(spark, x), "id", "vec", 0.9, 10).collect()) == brute.greedy_kept(x, 0.9)
    none = pairs.mean_pair_distance(frame(spark, x[:1]), "id", "vec").first()[0]
    assert none is None


@pytest.mark.parametrize("local", [512, 1])
def test_ensemble_matches_naive_linkage(spark, local):
    rng = np.random.default_rng(11)
    n, layers = 40, 6
    truth = rng.integers(0, 3, n)
    lab = np.array([[truth[i] if rng.random() < 0.7 else rng.integers(-1, 3) for _ in range(layers)]
                    for i in range(n)])
    lab[0] = -1
    rows = [(int(c), i, int(lab[i, c])) for i in range(n) for c in range(layers)]
    df = spark.createDataFrame(rows, "layer int, id long, label int")
    votes = sum((lab[:, c][:, None] == lab[:, c][None, :]) & (lab[:, c] != -1)[:, None]
                for c in range(layers)).astype(float)
    np.fill_diagonal(votes, 0)
    valid = np.nonzero((votes > 0).any(1))[0]
    groups = ensemble.signature_groups(df, "id")
    pairs_ = ensemble.co_association(groups, layers, tile_rows=10).collect()
    sig = {r.group: tuple(r.signature) for r in groups.collect()}
    for r in pairs_:
        i, j = r.a, r.b
        if i == j:
            j = next(x for x in range(n) if x != i and tuple(lab[x]) == sig[i])
        assert abs(r.votes - votes[i, j] / layers) < 1e-12
    got = labels_of(ensemble.combine_layers(df, "id", 2, local, tile_rows=10), n)
    assert set(np.nonzero(got == -1)[0]) == set(range(n)) - set(valid)
    assert set(got[valid]) == {0, 1}
    by_sig = {}
    for i in valid:
        assert by_sig.setdefault(tuple(lab[i]), got[i]) == got[i]


def test_merge_heights_without_ties(spark):
    """Heights of all merges equal the naive run when layers are weighted to avoid ties."""
    rng = np.random.default_rng(3)
    n, weights = 24, [1, 2, 4, 8, 16, 32, 64]
    lab = rng.integers(0, 3, (n, len(weights)))
    lab = np.unique(lab, axis=0)
    n = len(lab)
    wide = np.repeat(lab, weights, axis=1)  # a layer of weight w stands w times
    rows = [(c, i, int(wide[i, c])) for i in range(n) for c in range(wide.shape[1])]
    df = spark.createDataFrame(rows, "layer int, id long, label int")
    votes = sum(w * (lab[:, c][:, None] == lab[:, c][None, :]) for c, w in enumerate(weights))
    _, want = brute.average_linkage(votes.astype(float), 1)
    groups = ensemble.signature_groups(df, "id")
    for local in (512, 1):
        merges = ensemble.merge_tree(ensemble.voted(groups), local, tile_rows=8).collect()
        np.testing.assert_allclose(sorted(r.sim for r in merges), sorted(want), atol=1e-9)
        cut = ensemble.combine_layers(df, "id", 3, local, tile_rows=8)
        got = labels_of(cut, n)
        parts, _ = brute.average_linkage(votes.astype(float), 3)
        assert sorted(sorted(np.nonzero(got == c)[0].tolist()) for c in set(got)) == sorted(parts)


def test_ensemble_of_very_many_clusters(spark, monkeypatch):
    """300,000 slots: rounds, and rounds because the last groups hold too many slots, give the same tree."""
    rng = np.random.default_rng(12)
    n = 400
    base = spark.range(n).select(F.col("id"), F.explode(F.sequence(F.lit(0), F.lit(749))).alias("layer"))
    # Neighbours share a few layers; every other label is a cluster of one row.
    shared = F.pmod(F.xxhash64("layer", F.floor(F.col("id") / 8)), F.lit(40)) == 0
    label = F.when(shared, F.floor(F.col("id") / 8)).otherwise(F.col("id") + 1000).cast("int")
    layers = base.select("layer", "id", label.alias("label"))
    assert layers.select("layer", "label").distinct().count() > 290_000
    groups = ensemble.stage(ensemble.voted(ensemble.signature_groups(layers, "id")))
    one = ensemble.stage(ensemble.merge_tree(groups, 512))
    monkeypatch.setattr(ensemble, "LOCAL_ENTRIES", 100_000)
    two = ensemble.stage(ensemble.merge_tree(groups, 512, tile_rows=int(rng.integers(40, 90))))
    sims = [np.sort([r.sim for r in t.collect()]) for t in (one, two)]
    assert len(sims[0]) == groups.count() - 1
    np.testing.assert_allclose(sims[0], sims[1], atol=1e-9)
    tops = [sorted((r.group, r.label) for r in ensemble.cut_tree(groups, t, 50).collect()) for t in (one, two)]
    assert tops[0] == tops[1] and {(g // 8) for g, _ in tops[0]} == set(range(50))
    assert all(label == g // 8 for g, label in tops[0])


def test_ensemble_model(spark):
    x = blobs(2, 100)
    model = ensemble.EnsembleClusterer([Hdbscan(6, 3)], [Dbscan(1.0, 5), Dbscan(1.2, 5)], 2, 50)
    assert model.get_params("dbscan", 1) == Dbscan(1.2, 5)
    model.set_params("k", 3)
    fitted = model.fit(frame(spark, x), "id", "vec")
    out = fitted.transform(frame(spark, np.vstack([x, x[:1]])))
    assert out.filter("id = 100 and label = -1").count() == 1
    top = fitted.votes(normalized=True).agg(F.max("votes"), F.min("votes")).first()
    assert top[0] == 1.0 and top[1] > 0


def test_metrics(spark):
    x = blobs(6, 90)
    lab = np.random.default_rng(0).integers(-1, 4, 90)
    lab[3] = 9                             # a cluster of one row
    row = metrics.evaluate(frame(spark, x, label=lab), "id", "vec", "label", 30).first()
    keep = lab != -1
    xs, ls = x[keep], lab[keep]
    ks = sorted(set(ls))
    c = np.array([xs[ls == k].mean(0) for k in ks])
    s = np.array([np.linalg.norm(xs[ls == k] - c[i], axis=1).mean() for i, k in enumerate(ks)])
    dc = brute.euclid(c)
    np.fill_diagonal(dc, np.inf)
    db = ((s[:, None] + s[None, :]) / dc).max(1).mean()
    w = sum(((xs[ls == k] - c[i]) ** 2).sum() for i, k in enumerate(ks))
    b = sum((ls == k).sum() * ((c[i] - xs.mean(0)) ** 2).sum() for i, k in enumerate(ks))
    ch = b / (len(ks) - 1) / (w / (len(xs) - len(ks)))
    assert row.n_clusters == len(ks)
    np.testing.assert_allclose(
        [row.silhouette_avg, row.davies_bouldin, row.calinski_harabasz],
        [brute.silhouette(xs, ls), db, ch], atol=1e-9,
    )
    dist = metrics.mean_centroid_distance(frame(spark, x, label=lab), "vec", "label").first()[0]
    np.testing.assert_allclose(dist, brute.euclid(c)[np.tril_indices(len(c), -1)].mean())


def test_metrics_fall_back(spark):
    x = blobs(6, 20)
    one = metrics.evaluate(frame(spark, x, label=[0] * 20), "id", "vec", "label").first()
    none = metrics.evaluate(frame(spark, x, label=[-1] * 20), "id", "vec", "label").first()
    assert tuple(one) == (1, -1.0, -1.0, -1.0) and tuple(none) == (0, -1.0, -1.0, -1.0)


def test_scaling(spark):
    rng = np.random.default_rng(8)
    x = np.c_[rng.normal(size=(101, 3)), np.full(101, 2.0), np.repeat([0.0, 5.0, 9.0], [70, 30, 1])]
    get = lambda df: np.array([r.vec for r in df.orderBy("id").collect()])
    got = get(scaling.min_max_scale(frame(spark, x), "vec"))
    width = np.ptp(x, axis=0)
    np.testing.assert_allclose(got, (x - x.min(0)) / np.where(width > 0, width, 1), atol=1e-12)
    q = scaling.column_quantiles(frame(spark, x), "vec", [0.25, 0.5, 0.75, 0.9])
    np.testing.assert_allclose(q, np.quantile(x, [0.25, 0.5, 0.75, 0.9], axis=0), atol=1e-12)
    got = get(scaling.robust_scale(frame(spark, x), "vec"))
    iqr = q[2] - q[0]
    np.testing.assert_allclose(got, (x - q[1]) / np.where(iqr > 0, iqr, 1), atol=1e-12)


def test_plane(spark):
    x = blobs(9, 60)
    lab = np.where(np.arange(60) % 7 == 0, -1, 1)
    got = scaling.plane_coordinates(frame(spark, x, label=lab), "id", "vec", "label").orderBy("id")
    xy = np.array([[r.x, r.y] for r in got.collect()])
    kept = x[lab != -1]
    u, s, _ = np.linalg.svd(kept - kept.mean(0), full_matrices=False)
    np.testing.assert_allclose(np.abs(xy), np.abs(u[:, :2] * s[:2]), atol=1e-8)


def test_kmeans(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(30, 2)) + c for c in ([0, 0], [20, 0], [0, 20])])
    df = frame(spark, x)
    runs = [kmeans.Run(3, init, 42 + i) for init in ("k-means++", "random") for i in range(6)]
    models = kmeans.fit_kmeans(df, "id", "vec", runs)
    want = sum(((x[i:i + 30] - x[i:i + 30].mean(0)) ** 2).sum() for i in (0, 30, 60))
    assert {m.centers.shape for m in models} == {(3, 2)}
    for init in ("k-means++", "random"):
        best = kmeans.best_of(models, 3, init, 6)
        np.testing.assert_allclose(best.inertia, want)
        got = labels_of(kmeans.assign(df, "id", "vec", [best]), 90, 0)
        same_partition(got, np.repeat([0, 1, 2], 30))
    assert kmeans.best_of(models, 3, "random", 2).run.seed in (42, 43)
    again = kmeans.fit_kmeans(df.repartition(7), "id", "vec", runs)
    np.testing.assert_allclose([m.inertia for m in again], [m.inertia for m in models])
    curve = [r.inertia for r in kmeans.inertia_curve(df, "id", "vec", [1, 2, 3]).collect()]
    np.testing.assert_allclose(curve[0], ((x - x.mean(0)) ** 2).sum())
    assert curve[0] > curve[1] > curve[2]


def test_greedy_starts(spark):
    """Each next centre is the trial of least cost, against plain loops over all rows."""
    x = blobs(9, 80, d=3, k=5)
    df = frame(spark, x)
    run = kmeans.Run(5, seed=7)
    ids = np.arange(80)
    got = kmeans._starts(df, [run, kmeans.Run(1), kmeans.Run(3, "random")])
    assert [len(c) for c in got] == [5, 1, 3]
    centers = x[[(-np.log(kmeans._uniform(ids, 7, 0))).argmin()]]
    tried = []
    for step in range(1, 6):
        near = ((x[:, None] - centers[None]) ** 2).sum(2).min(1)
        if step > 1:
            costs = [np.minimum(near, ((x - t) ** 2).sum(1)).sum() for t in tried]
            centers = np.vstack([centers, tried[int(np.argmin(costs))]])
            near = ((x[:, None] - centers[None]) ** 2).sum(2).min(1)
        with np.errstate(divide="ignore"):
            draws = [-np.log(kmeans._uniform(ids, 7, 64 * step + j)) / near for j in range(3)]
        tried = [x[d.argmin()] for d in draws]
    np.testing.assert_array_equal(got[0], centers)


def test_empty_centers_move(spark):
    """A centre without rows takes the farthest row; copies of few values leave it where it is."""
    x = np.array([[0.0], [1.0], [2.0], [50.0]])
    centers = [np.array([[1.0], [500.0], [600.0]]), np.array([[1.0], [40.0], [45.0]])]
    df = frame(spark, x)
    found = kmeans._pass(df, centers)
    size, total = kmeans._relocated(df, centers, found)[0]
    assert size.tolist() == [2, 1, 1] and total[:, 0].tolist() == [1.0 + 2.0, 50.0, 0.0]
    size, total = kmeans._relocated(df, centers, found)[1]
    assert size.tolist() == [3, 1, 0] and total[:, 0].tolist() == [3.0, 50.0, 0.0]
    model = kmeans.fit_kmeans(frame(spark, np.zeros((6, 2))), "id", "vec", [kmeans.Run(3), kmeans.Run(3, "random")])
    assert [m.inertia for m in model] == [0.0, 0.0]


@pytest.mark.parametrize("local", [10**6, 0])
def test_components(spark, local):
    rng = np.random.default_rng(1)
    edges = [(g, int(a), int(b)) for g in (0, 1) for a, b in rng.integers(0, 60, (45, 2))]
    edges += [(1, 100 + i, 101 + i) for i in range(30)] + [(1, 0, 200 + i) for i in range(40)]
    rows = connected_components(spark.createDataFrame(edges, "graph int, u long, v long"), local)
    got = {(r.graph, r.node): r.root for r in rows.collect()}
    for g in (0, 1):
        near = {}
        for h, a, b in edges:
            if h == g and a != b:
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
        for node in near:
            seen, stack = {node}, [node]
            while stack:
                for q in near[stack.pop()] - seen:
                    seen.add(q)
                    stack.append(q)
            assert got[(g, node)] == min(seen)
    assert len(got) == len(rows.collect())


def test_spanning_forest_keeps_components():
    rng = np.random.default_rng(2)
    for density in (0.02, 0.1, 0.9):
        near = rng.random((40, 30)) < density
        i, j = spanning_forest(near)
        assert near[i, j].all() and len(i) <= 69
        parent = list(range(70))

        def root(n):
            while parent[n] != n:
                n = parent[n]
            return n

        for a, b in zip(i, j):
            assert root(a) != root(40 + b)
            parent[root(a)] = root(40 + b)
        for a, b in zip(*np.nonzero(near)):
            assert root(a) == root(40 + b)


@pytest.mark.parametrize("small", [10**6, 10])
def test_keys_are_dense(spark, monkeypatch, small):
    from topiclake.operators import keys

    monkeypatch.setattr(keys, "SMALL_ROWS", small)
    df = spark.range(1000).repartition(7).withColumn("v", (F.col("id") * 7919) % 1009)
    got = assign_keys(df, "k", 5, ["v"])
    rows = got.orderBy("k").collect()
    assert [r.k for r in rows] == list(range(5, 1005))
    assert [r.v for r in rows] == sorted(r.v for r in rows)
    free = assign_keys(df, "k")
    assert free.agg(F.min("k"), F.max("k"), F.count_distinct("k")).first() == (1, 1000, 1000)


def test_index_within(spark, monkeypatch):
    from topiclake.operators import keys

    df = spark.createDataFrame([(g, i * 3) for g in (0, 1, 2) for i in range(10 + g)], "g int, x int")
    small = {(r.g, r.x): r.i for r in index_within(df, "g", "x", "i").collect()}
    monkeypatch.setattr(keys, "SMALL_ROWS", 5)
    large = {(r.g, r.x): r.i for r in index_within(df, "g", "x", "i").collect()}
    assert small == large and small[(2, 33)] == 11


def test_small_tables_are_copied_to_the_runs(spark, monkeypatch):
    """Runs dealt to tasks come to the same centres as one pass of all rows an iteration."""
    x = blobs(3, 300, d=3, k=4)
    x[7] = x[5]
    df = frame(spark, x)
    runs = [kmeans.Run(k, init, 42 + i) for k in (2, 4) for init in ("k-means++", "random") for i in range(3)]
    passes, real = [], kmeans._pass
    monkeypatch.setattr(kmeans, "_pass", lambda *a: passes.append(a) or real(*a))
    dealt = kmeans.fit_kmeans(df, "id", "vec", runs)
    assert not passes  # no job an iteration
    monkeypatch.setattr(kmeans, "SMALL_BYTES", 0)
    spread = kmeans.fit_kmeans(df.repartition(3), "id", "vec", runs)
    assert passes and [m.run for m in dealt] == runs
    for a, b in zip(dealt, spread):
        np.testing.assert_allclose(a.centers, b.centers)
        np.testing.assert_allclose(a.inertia, b.inertia)
