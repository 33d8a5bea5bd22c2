import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from topiclake.llm import centroids
from topiclake.llm.queries import Q

SCHEMA = "vec_id long, embedding array<double>, label int"


def name(i):
    return hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()


def order():
    return F.sha2(F.concat(F.lit("3:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)


def brute(rows, k=8, rounds=10, width=64):
    kept = [
        (i, [math.floor(1024 * x) for x in v]) for i, v in rows
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)
    ]
    centres = [q for _, q in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(centres)) for _, q in kept]

    for _ in range(rounds):
        own = assign()
        for j in range(len(centres)):
            mine = [q for (_, q), (_, c) in zip(kept, own) if c == j]
            if mine:
                centres[j] = [sum(x) // len(mine) for x in zip(*mine)]
    out, per = [], Counter()
    own = assign()
    for d, c in own:
        per[c] += d
    for (i, _), (d, c) in zip(kept, own):
        digest = hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()
        out.append((i, c, d, per[c], sum(per.values()), digest))
    return sorted(out, key=str)


def run(spark, rows, width=64, **kw):
    df = spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA)
    found = centroids.cluster(df.repartition(3), "vec_id", "embedding", order(), width=width, **kw)
    return sorted((tuple(r) for r in centroids.with_inertia(found, "vec_id").collect()), key=str), found


def vectors(n, width, seed, groups=5):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, width)) * 3
    return [(i, (middle[i % groups] + rng.normal(size=width) * 0.2).tolist()) for i in range(n)]


def test_equals_measuring_everything(spark):
    rows = vectors(400, 64, 1)
    got, found = run(spark, rows)
    assert got == brute(rows)
    # Grouped vectors do not need all distances.
    assert sum(found.measured) < 0.7 * 10 * 400 * 8


def test_edges(spark):
    good = vectors(30, 4, 2)
    bad = [(90, None), (91, []), (92, [1.0] * 3), (93, [1.0, None, 1.0, 1.0]), (94, [1.0, float("nan"), 0.0, 0.0]),
           (95, [float("inf"), 0.0, 0.0, 0.0]), (96, [0.0] * 5)]
    ties = [(200 + i, [0.5, -0.5, 0.0, -0.0]) for i in range(20)]
    rows = good + bad + ties + [good[3], good[3], (None, good[0][1]), (None, good[5][1])]
    got, _ = run(spark, rows, width=4)
    assert got == brute(rows, width=4)
    for few in (rows[:3], rows[:1], bad, []):
        assert run(spark, few, width=4)[0] == brute(few, width=4)
    same = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(50)]
    assert run(spark, same, width=4)[0] == brute(same, width=4)


def test_large_components(spark):
    big = 131071.9
    rows = [(i, [big * (-1) ** (i >> j & 1) for j in range(4)]) for i in range(40)]
    assert run(spark, rows, width=4, k=3)[0] == brute(rows, k=3, width=4)
    with pytest.raises(Exception, match="no exact distance"):
        run(spark, [*rows, (99, [131072.0, 0.0, 0.0, 0.0])], width=4)


def test_bounds_never_lose_the_nearest():
    rng = np.random.default_rng(4)
    for scale in (3, 1000, 1 << 26):
        q = rng.integers(-scale, scale, (500, 6))
        c = np.concatenate([q[:4], q[:4] + 1, q[:3]])
        pivots = centroids.choose_pivots(q[:50], 5)
        own, distance, cost = centroids.nearest(q, centroids.pivot_distances(q, pivots), c, centroids.pivot_distances(c, pivots))
        full = ((q[:, None] - c[None]) ** 2).sum(2)
        assert (own == full.argmin(1)).all() and (distance == full.min(1)).all()
        assert len(q) <= cost <= full.size


def test_query(spark, tmp_path):
    rows = vectors(60, 64, 5)
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, _q string, cluster string")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    back = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    assert sorted((tuple(r) for r in Q["op12_laesa_centroids"](spark, str(tmp_path)).collect()), key=str) == brute(back)
