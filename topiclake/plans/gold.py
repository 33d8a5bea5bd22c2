"""Silver star into the gold star: posts with vectors, minutes and authors."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.ml.feature import IDFModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topiclake.functions.vectorize import fit_idf, vectorize
from topiclake.plans.silver import COUNTERS
from topiclake.session import stage
from topiclake.sources.catalog import Catalog, high_water


def with_created_at(posts: DataFrame, time: DataFrame) -> DataFrame:
    """Creation minute of each post, back from the time dimension."""
    return posts.join(time.select("SK_time", "created_at"), "SK_time")


def word_weights(catalog: Catalog) -> IDFModel | None:
    """Document frequencies of the lake's words; learnt from silver once, then kept, so that old and
    new vectors stay comparable. None while there are no posts."""
    path = catalog.path("gold", "idf")
    try:
        return IDFModel.load(path)
    except (AnalysisException, Py4JJavaError):
        pass  # not learnt yet
    posts = catalog.load("silver", "posts")
    if posts.isEmpty():
        return None
    model = fit_idf(posts.select("yaked"), "yaked")
    model.write().save(path)
    return model


def take_revisions(catalog: Catalog) -> None:
    """Take over counters that silver has raised: the days concerned are written again.

    The marks are noted last, so a run that breaks off is simply repeated.
    """
    marks = catalog.load("silver", "revised").join(catalog.load("gold", "revised"), ["day_collect", "mark"], "left_anti")
    marks = stage(marks, "marks")
    days = [r.day_collect for r in marks.select("day_collect").distinct().collect()]  # at most 31
    if not days:
        return
    now = catalog.load("silver", "posts").filter(F.col("day_collect").isin(days)).select("SK_post", *COUNTERS)
    held = catalog.load("gold", "posts").filter(F.col("day_collect").isin(days)).drop(*COUNTERS)
    catalog.replace_load(stage(held.join(now, "SK_post"), "raised"), "gold", "posts")
    catalog.append(marks, "gold", "revised")


def refresh(catalog: Catalog, encoder: Callable | None = None, idf: IDFModel | None = None) -> None:
    """Append new posts and minutes, take over raised counters, replace the authors.

    What is new is told by the keys, which only grow; by creation time, posts of the minute in
    which the last load ended would be lost. Hashed words are weighted by the lake's document
    frequencies unless others are given.
    """
    if encoder is None and idf is None:
        idf = word_weights(catalog)
    for table, key in (("time", "SK_time"), ("posts", "SK_post")):
        mark = high_water(catalog.load("gold", table), key) or 0
        fresh = catalog.load("silver", table).filter(F.col(key) > mark)
        if table == "posts":
            fresh = vectorize(fresh, "yaked", encoder, idf)
        catalog.append(fresh, "gold", table)
    take_revisions(catalog)
    catalog.overwrite(catalog.load("silver", "author"), "gold", "author")
