"""Distribution of the interaction counters per cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topiclake.operators.words import COUNTERS


def with_interaction_groups(df: DataFrame) -> DataFrame:
    """Passive reactions (likes, reposts) and active ones (quotes, replies)."""
    return df.withColumn(
        "passive_count", F.col("like_count") + F.col("repost_count")
    ).withColumn("active_count", F.col("quote_count") + F.col("reply_count"))


def box_statistics(df: DataFrame, label: str, counters: list[str] | None = None) -> DataFrame:
    """Quartiles and whiskers of each counter, whiskers inside 1.5 interquartile ranges.

    Posts are first counted per distinct value, with the counters unfolded from one scan, so both
    the quartiles and the second look at the values run on the small table of counts.
    """
    counters = counters or COUNTERS
    long = df.select(
        (F.col(label) + 1).alias("cluster"),
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("counter"), F.col(c).alias("v")) for c in counters])
        ).alias("x"),
    ).select("cluster", "x.counter", "x.v")
    counts = long.filter("v is not null").groupBy("cluster", "counter", "v").agg(
        F.count("*").alias("n")
    )
    q = counts.groupBy("cluster", "counter").agg(
        F.percentile("v", [0.25, 0.5, 0.75], F.col("n")).alias("q")
    )
    q = q.select(
        "cluster", "counter", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"),
        F.col("q")[2].alias("q3"),
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("v").between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        counts.join(q, ["cluster", "counter"])
        .groupBy("cluster", "counter", "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
        )
    )


def shift_labels(df: DataFrame, label: str) -> DataFrame:
    """Labels counted from one, for display."""
    return df.withColumn(label, F.col(label) + 1)
