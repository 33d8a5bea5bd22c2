"""Plans that must hold at scale."""

import os

import pytest
from pyspark.sql import functions as F

from tests.test_vectors import blobs, frame
from topiclake.operators import authors, pairs, words
from topiclake.operators.labels import clustered
from topiclake.plans import silver, sweep
from workload import views as v

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_reports_have_no_nested_loops_and_no_python(spark):
    rows = v.labelled(spark, SF)
    for df in (
        words.cooccurrence(rows, "post", 5), words.vocab_coverage(rows, "SK_post", "post", 5),
        words.topic_interactions(rows, "labels", "post"),
        words.mean_jaccard(rows, "labels", "post"),
        authors.top_author_words(clustered(rows), "labels", "post"),
        silver.cleaned_words(v.posts(spark, SF), "SK_post"),
    ):
        text = plan(df)
        assert "NestedLoop" not in text and "Cartesian" not in text and "Python" not in text


def test_rank_filters_are_cut_before_the_shuffle(spark):
    top = authors.top_authors(v.labelled(spark, SF, text=False), "labels")
    assert "WindowGroupLimit" in plan(top) and "Partial" in plan(top)


def test_columns_and_filters_reach_the_scan(spark):
    text = plan(authors.cluster_sizes(clustered(v.labelled(spark, SF, text=False)), "labels"))
    scans = [line for line in text.splitlines() if "FileScan" in line]
    assert scans and all("text" not in s.split("ReadSchema")[1] for s in scans)
    late = v.event_posts(spark, SF).filter(F.col("created_at") > F.lit("2024-01-20").cast("timestamp_ntz"))
    assert "GreaterThan(ts" in plan(late)


def test_distinct_posts_shrink_before_the_shuffle(spark):
    posts = v.posts(spark, SF).select("author", "text", "created_at", *silver.COUNTERS)
    text = plan(silver.distinct_posts(posts))
    assert "partial_max" in text


def test_pairs_never_cross_in_the_plan(spark):
    df = pairs.similar_pairs(frame(spark, blobs(0, 60)), "id", "vec", 0.9, tile_rows=20)
    text = plan(df)
    assert "NestedLoop" not in text and "Cartesian" not in text and "FlatMapGroupsInArrow" in text


def test_sweeps(spark):
    x = blobs(1, 80)
    space = {"plain": frame(spark, x)}
    grid = {"eps": [1.0, 2.4], "min_samples": [4], "metric": ["euclidean", "cosine"]}
    runs = sweep.sweep_dbscan(space, "id", "vec", grid)
    assert [r["name"] for r in runs] == [f"DBSCAN-{i}" for i in range(1, 5)]
    wide = [r for r in runs if r.get("tags")]
    assert len(wide) == 1 and wide[0]["params"]["n_clusters"] == 1
    assert wide[0]["metrics"]["silhouette_avg"] == -1
    runs = sweep.sweep_hdbscan(space, "id", "vec", {
        "metric": ["cosine"], "min_samples": [3], "min_cluster_size": [5, 8]})
    assert len(runs) == 2 and all(set(r["metrics"]) for r in runs)
    runs = sweep.sweep_kmeans(space, "id", "vec", {"k": [3, 4], "init": ["random"], "restarts": [1, 3]})
    assert len(runs) == 4 and all(r["params"]["n_clusters"] >= 2 for r in runs)
