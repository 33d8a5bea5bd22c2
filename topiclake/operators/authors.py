"""Author activity, reach and overlap between clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topiclake.functions.words import first_part
from topiclake.operators.words import word_counts


def with_short_author(df: DataFrame, author: str = "author") -> DataFrame:
    return df.withColumn(author, first_part(author))


def author_activity(df: DataFrame, label: str, author: str = "author") -> DataFrame:
    """Posts and mean likes of every author in every cluster."""
    return df.groupBy(label, author).agg(
        F.count("*").alias("posts"), F.avg("like_count").alias("mean_likes")
    )


def _first(df: DataFrame, label: str, author: str, by: str, n: int) -> DataFrame:
    order = Window.partitionBy(label).orderBy(F.desc(by), author)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def top_authors(df: DataFrame, label: str, author: str = "author", n: int = 10) -> DataFrame:
    busy = _first(author_activity(df, label, author), label, author, "posts", n)
    return busy.select(label, author, "posts", "rank")


def top_authors_by_likes(
    df: DataFrame, label: str, author: str = "author", n: int = 5
) -> DataFrame:
    liked = _first(author_activity(df, label, author), label, author, "mean_likes", n)
    return liked.select(label, author, "mean_likes", "rank")


def top_author_posts(
    df: DataFrame, key: str, label: str, text: str, author: str = "author", n: int = 5
) -> DataFrame:
    """The texts of each cluster's best-liked authors, one row per post.

    One long string per author would have to pass through a single task, however much that author
    wrote; the rows sorted by key hold the same text.
    """
    top = top_authors_by_likes(df, label, author, n)
    return df.join(top, [label, author]).select(label, "rank", author, key, text)


def top_author_words(
    df: DataFrame, label: str, text: str, author: str = "author", n: int = 5
) -> DataFrame:
    """Word counts and relative weights behind the word cloud of each best-liked author."""
    top = top_authors_by_likes(df, label, author, n).select(label, author)
    counts = word_counts(df.join(top, [label, author], "left_semi"), text, [label, author])
    best = counts.groupBy(label, author).agg(F.max("n").alias("top"))
    return counts.join(best, [label, author]).select(
        label, author, "word", "n", (F.col("n") / F.col("top")).alias("weight")
    )


def author_overlap(
    df: DataFrame, label: str, author: str = "author", a: int = 0, b: int = 1
) -> DataFrame:
    """Authors seen only in cluster a, only in cluster b, and in both."""
    seen = df.groupBy(author).agg(
        F.max(F.col(label) == a).alias("in_a"), F.max(F.col(label) == b).alias("in_b")
    )
    return seen.agg(
        F.count_if(F.col("in_a") & ~F.col("in_b")).alias("only_a"),
        F.count_if(~F.col("in_a") & F.col("in_b")).alias("only_b"),
        F.count_if(F.col("in_a") & F.col("in_b")).alias("both"),
    )


def shared_authors(
    df: DataFrame, label: str, author: str = "author", a: int = 0, b: int = 1
) -> DataFrame:
    """Names of the authors present in both clusters."""
    in_a = df.filter(F.col(label) == a).select(author)
    return in_a.intersect(df.filter(F.col(label) == b).select(author))


def exclusive_authors(
    df: DataFrame, label: str, author: str = "author", a: int = 0, b: int = 1
) -> DataFrame:
    """Names of the authors present in cluster a and not in cluster b."""
    in_a = df.filter(F.col(label) == a).select(author)
    return in_a.subtract(df.filter(F.col(label) == b).select(author))


def cluster_sizes(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("posts"))
