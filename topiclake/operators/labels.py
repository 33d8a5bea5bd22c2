"""Joining cluster labels to posts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_all(posts: DataFrame, labels: DataFrame, key: str, label: str = "labels") -> DataFrame:
    """Label every post; posts left out of the clustering become noise."""
    return posts.join(labels.select(key, label), key, "left").withColumn(
        label, F.coalesce(label, F.lit(-1))
    )


def clustered(df: DataFrame, label: str = "labels") -> DataFrame:
    """Rows that are not noise."""
    return df.filter(F.col(label) != -1)


def in_cluster(df: DataFrame, c: int, label: str = "labels") -> DataFrame:
    return df.filter(F.col(label) == c)


def star(posts: DataFrame, author: DataFrame, time: DataFrame) -> DataFrame:
    """Posts with their author and time attributes."""
    return posts.join(author, "SK_author").join(time, "SK_time")


def in_window(df: DataFrame, start: str, end: str, ts: str = "created_at") -> DataFrame:
    """Posts created inside the collection window."""
    return df.filter(F.col(ts).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
