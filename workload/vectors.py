"""Vector operators: similarity, scaling, clustering, quality and grid search."""

from __future__ import annotations

from pyspark.sql import functions as F

from topiclake.operators import ensemble, kmeans, metrics, pairs, scaling
from topiclake.operators.dbscan import Dbscan, dbscan, neighbor_counts
from topiclake.operators.hdbscan import Hdbscan, hdbscan, reachability_edges
from topiclake.operators.tiles import unit
from topiclake.plans import sweep
from topiclake.session import new_path, stage
from topiclake.sources import resources
from topiclake.sources.catalog import Catalog
from workload import views as v
from workload.registry import registry

Q, SQL, query = registry()

VECTORS = """v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec, label
    FROM embeddings)"""
COSINE = 0.35


def scaled(s, d):
    return stage(scaling.min_max_scale(v.vectors(s, d), "vec"), "scaled")


# ------------------------------------------------------------ pairs
PAIRS = f"""WITH {VECTORS},
    c AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.vec, b.vec) AS cosine
          FROM v a JOIN v b ON a.vec_id < b.vec_id)"""


@query(
    "j11_m1_similar_pairs",
    PAIRS
    + f""" SELECT a, b, round(cosine, 9) AS cosine, CAST(1 AS BIGINT) AS copies_a,
    CAST(1 AS BIGINT) AS copies_b FROM c WHERE cosine > {COSINE}""",
)
def _(s, d):
    found = pairs.similar_pairs(v.vectors(s, d), "vec_id", "vec", COSINE)
    return found.withColumn("cosine", F.round("cosine", 9))


@query(
    "f4_u4_near_duplicates",
    f"""WITH RECURSIVE {VECTORS},
    n AS (SELECT a.vec_id AS i, list(b.vec_id) AS later FROM v a JOIN v b ON a.vec_id < b.vec_id
          WHERE list_cosine_similarity(a.vec, b.vec) > {COSINE} GROUP BY a.vec_id),
    o AS (SELECT vec_id, coalesce(later, []) AS later,
                 row_number() OVER (ORDER BY vec_id) AS place
          FROM v LEFT JOIN n ON i = vec_id),
    r AS (SELECT CAST(0 AS BIGINT) AS place, CAST([] AS BIGINT[]) AS dropped
          UNION ALL
          SELECT o.place, CASE WHEN list_contains(r.dropped, o.vec_id) THEN r.dropped
                          ELSE list_distinct(list_concat(r.dropped, o.later)) END
          FROM r JOIN o ON o.place = r.place + 1)
    SELECT vec_id FROM v WHERE vec_id NOT IN
      (SELECT unnest(dropped) FROM r WHERE place = (SELECT max(place) FROM o))""",
)
def _(s, d):
    rows = v.vectors(s, d)
    return pairs.drop_near_duplicates(rows, "vec_id", "vec", COSINE).select("vec_id")


@query(
    "f4_copies_of_vectors",
    """SELECT vec_id FROM embeddings""",
)
def _(s, d):
    rows = v.vectors(s, d).select("vec_id", "vec")
    # Three of four rows are copies, scaled or shifted a little, under later ids.
    last = 1_000_000
    near = F.transform("vec", lambda x, i: F.when(i == 0, x + 0.001).otherwise(x))
    for i, vec in enumerate((F.col("vec"), F.transform("vec", lambda x: x * 3.0), near), 1):
        copy = v.vectors(s, d).select((F.col("vec_id") + i * last).alias("vec_id"), vec.alias("vec"))
        rows = rows.unionByName(copy)
    return pairs.drop_near_duplicates(rows, "vec_id", "vec", 0.99).select("vec_id")


@query(
    "f5_t5_neighbor_curve",
    f"""WITH {VECTORS},
    x AS (SELECT a.vec_id, list_distance(a.vec, b.vec) AS distance,
                 row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.vec, b.vec)) AS r
          FROM v a CROSS JOIN v b)
    SELECT CAST(r AS INT) AS k, CAST(row_number() OVER (PARTITION BY r ORDER BY distance, vec_id)
           AS BIGINT) AS rank, round(distance, 6) AS distance
    FROM x WHERE r IN (5, 10)""",
)
def _(s, d):
    curve = pairs.kth_neighbor_curve(v.vectors(s, d), "vec_id", "vec", [5, 10])
    return curve.withColumn("distance", F.round("distance", 6))


# ------------------------------------------------------------ scaling
LONG = f"""WITH {VECTORS}, e AS (SELECT vec_id, unnest(vec) AS x,
    CAST(unnest(range(len(vec))) AS INT) AS pos FROM v)"""


def _long(df):
    return df.select("vec_id", F.posexplode("vec").alias("pos", "x")).withColumn(
        "x", F.round("x", 6)
    )


@query(
    "f2_min_max_scale",
    LONG
    + """ SELECT vec_id, pos, round((x - min(x) OVER p) / (max(x) OVER p - min(x) OVER p), 6) AS x
    FROM e WINDOW p AS (PARTITION BY pos)""",
)
def _(s, d):
    return _long(scaling.min_max_scale(v.vectors(s, d), "vec"))


@query(
    "f3_robust_scale",
    LONG
    + """, q AS (SELECT pos, quantile_cont(x, [0.25, 0.5, 0.75]) AS q FROM e GROUP BY pos)
    SELECT vec_id, pos, round((x - q[2]) / (q[3] - q[1]), 6) AS x FROM e JOIN q USING (pos)""",
)
def _(s, d):
    return _long(scaling.robust_scale(v.vectors(s, d), "vec"))


@query("f21_plane_coordinates")
def _(s, d):
    return scaling.plane_coordinates(v.vectors(s, d), "vec_id", "vec", "label")


# ------------------------------------------------------------ quality
CENTERS = LONG + """, c AS (SELECT label, pos, avg(x) AS x FROM e JOIN v USING (vec_id)
      WHERE label <> -1 GROUP BY ALL),
    cc AS (SELECT CAST(label AS BIGINT) AS cluster, list(x ORDER BY pos) AS center FROM c
           GROUP BY label)"""


@query("a19_centroids", CENTERS + """ SELECT CAST(label AS BIGINT) AS cluster, pos,
    round(x, 9) AS x FROM c""")
def _(s, d):
    c = metrics.centroids(v.vectors(s, d), "vec", "label")
    return c.select("cluster", F.posexplode("centroid").alias("pos", "x")).withColumn(
        "x", F.round("x", 9)
    )


@query(
    "f19_j14_centroid_distances",
    CENTERS
    + """ SELECT a.cluster AS a, b.cluster AS b, round(list_distance(a.center, b.center), 6)
    AS distance FROM cc a JOIN cc b ON a.cluster < b.cluster""",
)
def _(s, d):
    found = metrics.centroid_distances(v.vectors(s, d), "vec", "label")
    return found.withColumn("distance", F.round("distance", 6))


@query(
    "f19_m4_mean_centroid_distance",
    CENTERS
    + """ SELECT round(avg(list_distance(a.center, b.center)), 6) AS distance_mean
    FROM cc a JOIN cc b ON a.cluster < b.cluster""",
)
def _(s, d):
    mean = metrics.mean_centroid_distance(v.vectors(s, d), "vec", "label")
    return mean.select(F.round("distance_mean", 6).alias("distance_mean"))


SILHOUETTE = """dd AS (SELECT a.vec_id, a.label AS own, b.label AS other,
      sum(list_distance(a.vec, b.vec)) AS t, count(*) AS n
      FROM v a CROSS JOIN v b GROUP BY ALL),
    sl AS (SELECT vec_id, max(t / nullif(n - 1, 0)) FILTER (own = other) AS a,
                  min(t / n) FILTER (own <> other) AS b FROM dd GROUP BY vec_id),
    sil AS (SELECT vec_id, CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END AS s
            FROM sl)"""


@query(
    "f15_m2_silhouette_samples",
    f"WITH {VECTORS}, {SILHOUETTE} SELECT vec_id, round(s, 6) AS silhouette FROM sil",
)
def _(s, d):
    found = metrics.silhouette_samples(v.vectors(s, d), "vec_id", "vec", "label")
    return found.withColumn("silhouette", F.round("silhouette", 6))


@query(
    "f15_f16_f17_quality",
    CENTERS
    + f""", {SILHOUETTE},
    sc AS (SELECT cluster, any_value(center) AS center, avg(list_distance(vec, center)) AS s,
             sum(list_distance(vec, center) ** 2) AS w, count(*) AS n
           FROM v JOIN cc ON label = cluster GROUP BY cluster),
    db AS (SELECT a.cluster, max((a.s + b.s) / list_distance(a.center, b.center)) AS worst
           FROM sc a JOIN sc b ON a.cluster <> b.cluster GROUP BY a.cluster),
    al AS (SELECT list(x ORDER BY pos) AS mean FROM (SELECT pos, avg(x) AS x FROM e GROUP BY pos)),
    ch AS (SELECT sum(n * list_distance(center, mean) ** 2) / (count(*) - 1)
             / (sum(w) / (sum(n) - count(*))) AS ch, CAST(count(*) AS INT) AS k FROM sc, al)
    SELECT k AS n_clusters, round((SELECT avg(s) FROM sil), 6) AS silhouette_avg,
      round((SELECT avg(worst) FROM db), 6) AS davies_bouldin,
      round(ch, 6) AS calinski_harabasz FROM ch""",
)
def _(s, d):
    row = metrics.evaluate(v.vectors(s, d), "vec_id", "vec", "label")
    return row.select("n_clusters", *[F.round(m, 6).alias(m) for m in metrics.METRICS])


@query(
    "f18_undefined_quality",
    """SELECT CAST(1 AS INT) AS n_clusters, CAST(-1 AS DOUBLE) AS silhouette_avg,
    CAST(-1 AS DOUBLE) AS davies_bouldin, CAST(-1 AS DOUBLE) AS calinski_harabasz
    FROM embeddings LIMIT 1""",
)
def _(s, d):
    one = v.vectors(s, d).withColumn("label", F.when(F.col("label") == 0, 0).otherwise(-1))
    return metrics.evaluate(one, "vec_id", "vec", "label")


@query(
    "a17_cluster_count",
    "SELECT count(DISTINCT label) FILTER (label <> 3) AS n_clusters FROM embeddings",
)
def _(s, d):
    noisy = v.vectors(s, d).withColumn(
        "label", F.when(F.col("label") == 3, -1).otherwise(F.col("label"))
    )
    return metrics.cluster_count(noisy, "label")


# ------------------------------------------------------------ clustering
RADII = [1.3, 1.39, 1.5, 1.62]


SCALED = LONG + """, z AS (SELECT vec_id, pos,
      (x - min(x) OVER p) / (max(x) OVER p - min(x) OVER p) AS x
      FROM e WINDOW p AS (PARTITION BY pos)),
    m AS MATERIALIZED (SELECT vec_id, list(x ORDER BY pos) AS vec FROM z GROUP BY vec_id)"""


@query(
    "f8_neighbor_counts",
    SCALED
    + f""" SELECT a.vec_id, {', '.join(
        f"count(*) FILTER (list_distance(a.vec, b.vec) <= {r}) AS n{i}"
        for i, r in enumerate(RADII))} FROM m a CROSS JOIN m b GROUP BY a.vec_id""",
)
def _(s, d):
    return neighbor_counts(scaled(s, d), "vec_id", "vec", RADII)


DBSCAN = [Dbscan(1.5, 4), Dbscan(1.62, 8), Dbscan(1.62, 5)]


def _dbscan_sql(i: int, p: Dbscan) -> str:
    return f""", p{i} AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM m a CROSS JOIN m b
        WHERE list_distance(a.vec, b.vec) <= {p.eps}),
      k{i} AS MATERIALIZED (SELECT a FROM p{i} GROUP BY a HAVING count(*) >= {p.min_samples}),
      q{i} AS MATERIALIZED (SELECT a, b FROM p{i} WHERE a IN (FROM k{i}) AND b IN (FROM k{i})),
      t{i}(root, node) AS (SELECT a, a FROM k{i}
        UNION SELECT t.root, q.b FROM t{i} t JOIN q{i} q ON q.a = t.node AND q.b > t.root),
      r{i} AS (SELECT node, min(root) AS root FROM t{i} GROUP BY node),
      f{i} AS (SELECT node, dense_rank() OVER (ORDER BY root) - 1 AS label FROM r{i}),
      g{i} AS (SELECT {i} AS setting, v.vec_id, CAST(coalesce(f.label,
          (SELECT min(h.label) FROM p{i} p JOIN f{i} h ON h.node = p.b WHERE p.a = v.vec_id), -1)
          AS INT) AS label FROM v LEFT JOIN f{i} f ON f.node = v.vec_id)"""


@query(
    "f8_dbscan",
    SCALED.replace("WITH", "WITH RECURSIVE", 1)
    + "".join(_dbscan_sql(i, p) for i, p in enumerate(DBSCAN))
    + " UNION ALL ".join(f" SELECT * FROM g{i}" for i in range(len(DBSCAN))),
)
def _(s, d):
    return dbscan(scaled(s, d), "vec_id", "vec", DBSCAN)


HDBSCAN = [Hdbscan(5, 3), Hdbscan(8, 3), Hdbscan(5, 5)]


# Prim's walk over the whole matrix of mutual reachability, from the first vector.
def _tree_sql(m: int) -> str:
    return f""", w{m} AS MATERIALIZED (SELECT a.n, list(greatest(d, a.c, b.c) ORDER BY b.n) AS w
        FROM dd JOIN cores a ON a.n = dd.a AND a.ms = {m} JOIN cores b ON b.n = dd.b AND b.ms = {m} GROUP BY a.n),
      p{m}(step, pos, far, total) AS (
        SELECT 0, 1, list_transform(w, lambda x, i: CASE WHEN i = 1 THEN 'inf'::DOUBLE ELSE x END), 0.0::DOUBLE
        FROM w{m} WHERE n = 1
        UNION ALL
        SELECT step + 1, q.pos, list_transform(list_zip(far, w), lambda x, i: CASE WHEN x[1] = 'inf' OR i = q.pos
            THEN 'inf'::DOUBLE ELSE least(x[1], x[2]) END), total + list_min(far)
        FROM (SELECT *, list_position(far, list_min(far)) AS nxt FROM p{m} WHERE list_min(far) < 'inf') p
        JOIN (SELECT n AS pos, w FROM w{m}) q ON q.pos = p.nxt)"""


@query(
    "f9_reachability_tree",
    SCALED.replace("WITH", "WITH RECURSIVE", 1)
    + """, k AS (SELECT CAST(row_number() OVER (ORDER BY vec_id) AS INT) AS n, vec FROM m),
      dd AS MATERIALIZED (SELECT a.n AS a, b.n AS b, CASE WHEN a.n = b.n THEN 0 ELSE
        greatest(1 - list_cosine_similarity(a.vec, b.vec), 0) END AS d FROM k a CROSS JOIN k b),
      o AS (SELECT a, d, row_number() OVER (PARTITION BY a ORDER BY d) AS r FROM dd),
      cores AS MATERIALIZED (SELECT a AS n, CAST(r AS INT) AS ms, d AS c FROM o WHERE r IN (3, 5))"""
    + _tree_sql(3) + _tree_sql(5)
    + " UNION ALL ".join(
        f" SELECT CAST({m} AS INT) AS ms, max(step)::BIGINT AS edges, round(max(total), 6) AS weight FROM p{m}"
        for m in (3, 5)
    ),
)
def _(s, d):
    rows = scaled(s, d).withColumn("vec", unit("vec"))
    tree = reachability_edges(rows, "vec_id", "vec", [3, 5], "cosine")
    return tree.groupBy("ms").agg(
        F.count("*").alias("edges"), F.round(F.sum("w"), 6).alias("weight")
    )


@query("f9_hdbscan")
def _(s, d):
    return hdbscan(scaled(s, d), "vec_id", "vec", HDBSCAN, "cosine")


def layers_of(s, d):
    """Label layers of the documents: two given labels, the language, and a length class."""
    docs = v.table(s, d, "documents").join(v.table(s, d, "labels"), "doc_id", "left")
    order = F.array(*[F.lit(x) for x in ("en", "fr", "de")])
    cols = [
        F.coalesce("quality", F.lit(-1)), F.coalesce("toxic", F.lit(-1)),
        (F.array_position(order, F.col("lang")) - 1).cast("int"),
        F.when(F.col("n_chars") > 5000, -1).otherwise((F.col("n_chars") / 500).cast("int")),
    ]
    return docs.select(
        "doc_id", F.posexplode(F.array(*cols)).alias("layer", "label")
    ).select("layer", "doc_id", "label")


SIGNATURES = """WITH s AS (SELECT doc_id, [coalesce(quality, -1), coalesce(toxic, -1),
      CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE -1 END,
      CASE WHEN n_chars > 5000 THEN -1 ELSE CAST(n_chars // 500 AS INT) END] AS sig
    FROM documents LEFT JOIN labels USING (doc_id)),
  g AS (SELECT sig, min(doc_id) AS grp, count(*) AS size FROM s GROUP BY sig)"""


@query(
    "f11_signature_groups",
    SIGNATURES + """ SELECT grp AS "group", size, array_to_string(sig, ',') AS signature FROM g""",
)
def _(s, d):
    groups = ensemble.signature_groups(layers_of(s, d), "doc_id")
    return groups.withColumn(
        "signature", F.array_join(F.col("signature").cast("array<string>"), ",")
    )


VOTES = SIGNATURES + """,
  q AS (SELECT a.grp AS a, b.grp AS b, a.size AS na,
      len(list_filter(range(1, 5), lambda i: a.sig[i] = b.sig[i] AND a.sig[i] <> -1)) / 4 AS votes
    FROM g a JOIN g b ON a.grp <= b.grp),
  votes AS (SELECT a, b, votes FROM q WHERE votes > 0 AND (a <> b OR na > 1))"""


@query("f11_j12_co_association", VOTES + " SELECT a, b, round(votes, 9) AS votes FROM votes")
def _(s, d):
    groups = stage(ensemble.signature_groups(layers_of(s, d), "doc_id"))
    found = ensemble.co_association(groups, 4)
    return found.withColumn("votes", F.round("votes", 9))


@query(
    "a22_voted_rows",
    VOTES
    + """ SELECT doc_id FROM s JOIN g USING (sig)
    WHERE grp IN (SELECT a FROM votes UNION SELECT b FROM votes)""",
)
def _(s, d):
    layers = layers_of(s, d)
    groups = stage(ensemble.signature_groups(layers, "doc_id"))
    held = ensemble.voted(groups).select("signature")
    return ensemble.signatures(layers, "doc_id").join(held, "signature", "left_semi").select(
        "doc_id"
    )


@query("f12_m5_merge_heights")
def _(s, d):
    groups = stage(ensemble.voted(ensemble.signature_groups(layers_of(s, d), "doc_id")))
    return ensemble.merge_heights(groups, stage(ensemble.merge_tree(groups)), 4)


@query("f12_combined_layers")
def _(s, d):
    return ensemble.combine_layers(layers_of(s, d), "doc_id", 2)


@query("f10_f13_f14_ensemble")
def _(s, d):
    model = ensemble.EnsembleClusterer(HDBSCAN, DBSCAN, 2)
    model.set_params("k", 3)
    rows = scaled(s, d)
    kept = pairs.drop_near_duplicates(rows, "vec_id", "vec", 0.99)
    return model.fit(kept, "vec_id", "vec").transform(rows.select("vec_id"))


@query(
    "f6_inertia_curve",
)
def _(s, d):
    return kmeans.inertia_curve(v.vectors(s, d), "vec_id", "vec", list(range(1, 10)))


@query(
    "f6_inertia_of_one",
    LONG
    + """, c AS (SELECT pos, avg(x) AS c FROM e GROUP BY pos)
    SELECT CAST(1 AS INT) AS k, round(sum((x - c) ** 2), 6) AS inertia FROM e JOIN c USING (pos)""",
)
def _(s, d):
    curve = kmeans.inertia_curve(v.vectors(s, d), "vec_id", "vec", [1])
    return curve.withColumn("inertia", F.round("inertia", 6))


@query("f7_kmeans")
def _(s, d):
    rows = v.vectors(s, d)
    runs = [kmeans.Run(k, i, 42 + r) for k in (3, 4, 5) for i in ("k-means++", "random")
            for r in range(10)]
    models = kmeans.fit_kmeans(rows, "vec_id", "vec", runs)
    best = [kmeans.best_of(models, k, i, 10) for k in (3, 4, 5) for i in ("k-means++", "random")]
    return kmeans.assign(rows, "vec_id", "vec", best)


# ------------------------------------------------------------ grid search
def spaces(s, d):
    rows = v.vectors(s, d).select("vec_id", "vec")
    return {
        "minMax": stage(scaling.min_max_scale(rows, "vec")),
        "robust": stage(scaling.robust_scale(rows, "vec")),
    }


def _runs(s, found):
    rows = resources.run_rows(s, found)
    return rows.drop("run_id")


@query("f22_s15_j13_sweep_dbscan")
def _(s, d):
    grid = {"eps": [1.5, 1.62, 2.4], "min_samples": [5, 8], "metric": ["euclidean", "cosine"]}
    return _runs(s, sweep.sweep_dbscan(spaces(s, d), "vec_id", "vec", grid))


@query("f22_s15_sweep_hdbscan")
def _(s, d):
    grid = {"metric": ["cosine"], "min_samples": [3, 5], "min_cluster_size": [5, 8]}
    return _runs(s, sweep.sweep_hdbscan(spaces(s, d), "vec_id", "vec", grid))


@query("f22_s15_sweep_kmeans")
def _(s, d):
    return _runs(s, sweep.sweep_kmeans(spaces(s, d), "vec_id", "vec"))


RECORDED = [Dbscan(e, m) for e in (1.5, 1.62) for m in (5, 8)]


def _quality_sql(i: int) -> str:
    """The metrics of setting ``i`` over its labelled rows, from the labels ``g{i}``."""
    return f""", lv{i} AS MATERIALIZED (SELECT vec_id, vec, label FROM m JOIN g{i} USING (vec_id)
        WHERE label <> -1),
      dd{i} AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_distance(a.vec, b.vec)) AS t,
        count(*) AS n FROM lv{i} a CROSS JOIN lv{i} b GROUP BY ALL),
      sl{i} AS (SELECT vec_id, max(t / nullif(n - 1, 0)) FILTER (own = other) AS a,
        min(t / n) FILTER (own <> other) AS b FROM dd{i} GROUP BY vec_id),
      si{i} AS (SELECT avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS s FROM sl{i}),
      ce{i} AS (SELECT label, list(x ORDER BY pos) AS center FROM (SELECT label, pos, avg(z.x) AS x
        FROM z JOIN lv{i} USING (vec_id) GROUP BY ALL) GROUP BY label),
      st{i} AS (SELECT label, any_value(center) AS center, avg(list_distance(vec, center)) AS s,
        sum(list_distance(vec, center) ** 2) AS w, count(*) AS n
        FROM lv{i} JOIN ce{i} USING (label) GROUP BY label),
      wo{i} AS (SELECT max((a.s + b.s) / list_distance(a.center, b.center)) AS worst
        FROM st{i} a JOIN st{i} b ON a.label <> b.label GROUP BY a.label),
      al{i} AS (SELECT list(x ORDER BY pos) AS mean FROM (SELECT pos, avg(z.x) AS x
        FROM z JOIN lv{i} USING (vec_id) GROUP BY pos)),
      ch{i} AS (SELECT sum(n * list_distance(center, mean) ** 2) / (count(*) - 1)
        / (sum(w) / (sum(n) - count(*))) AS ch, count(*) AS k, sum(n) AS n FROM st{i}, al{i}),
      lo{i} AS (SELECT 'DBSCAN-{i + 1}' AS name, '{RECORDED[i].eps}' AS eps,
        '{RECORDED[i].min_samples}' AS min_samples, CAST(k AS VARCHAR) AS n_clusters,
        CASE WHEN k BETWEEN 2 AND n - 1 THEN round((SELECT s FROM si{i}), 6) ELSE -1 END AS silhouette_avg,
        CASE WHEN k BETWEEN 2 AND n - 1 THEN round((SELECT avg(worst) FROM wo{i}), 6) ELSE -1 END
          AS davies_bouldin,
        CASE WHEN k BETWEEN 2 AND n - 1 THEN round(ch, 6) ELSE -1 END AS calinski_harabasz FROM ch{i})"""


@query(
    "f22_s15_recorded_runs",
    SCALED.replace("WITH", "WITH RECURSIVE", 1)
    + "".join(_dbscan_sql(i, p) for i, p in enumerate(RECORDED))
    + "".join(_quality_sql(i) for i in range(len(RECORDED)))
    + " UNION ALL ".join(f" SELECT * FROM lo{i}" for i in range(len(RECORDED))),
)
def _(s, d):
    grid = {"eps": [1.5, 1.62], "min_samples": [5, 8], "metric": ["euclidean"]}
    catalog = Catalog(s, new_path(s, "lake"))
    sweep.record(catalog, sweep.sweep_dbscan({"minMax": scaled(s, d)}, "vec_id", "vec", grid))
    runs = catalog.load("results", "runs")
    return runs.select(
        "name", *[F.col("params")[p].alias(p) for p in ("eps", "min_samples", "n_clusters")],
        *[F.round(F.col("metrics")[m], 6).alias(m) for m in metrics.METRICS],
    )


@query("f10_f14_s15_ensemble_runs")
def _(s, d):
    """A grid of ensembles, its saved models, and their runs read back from the lake."""
    rows = scaled(s, d)
    grid = {"k": [2, 3, 4], "hdbscanLayers": [HDBSCAN], "dbscanLayers": [DBSCAN, DBSCAN[:2]]}
    catalog = Catalog(s, new_path(s, "lake"))
    runs = sweep.sweep_ensemble({"minMax": rows}, "vec_id", "vec", grid, new_path(s, "models"))
    sweep.record(catalog, runs)
    found = catalog.load("results", "runs")
    return found.select(
        "name", F.col("params")["k"].alias("k"), F.col("params")["dbscan"].alias("dbscan"),
        F.col("params")["n_clusters"].alias("n_clusters"), F.size("artifacts").alias("models"),
        *[F.round(F.col("metrics")[m], 6).alias(m) for m in metrics.METRICS],
    )
