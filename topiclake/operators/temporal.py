"""Activity over days, weekdays and hours."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topiclake.operators.words import COUNTERS

# Replicates and limits of the intervals that the bar plots draw.
REPLICATES = 1000
LIMITS = (0.025, 0.975)
# Shares of the Poisson distribution of mean one up to 0, 1, 2, …
POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(n + 1)) for n in range(13)]


def posts_per_day(df: DataFrame, ts: str) -> DataFrame:
    """Posts per date, with its day of the month and weekday."""
    return df.groupBy(
        F.to_date(ts).alias("DATA"),
        F.dayofmonth(ts).alias("DIA"),
        F.date_format(ts, "EEEE").alias("DIA_SEMANA"),
    ).agg(F.count("*").alias("posts"))


def posts_per_day_and_hour(df: DataFrame, ts: str) -> DataFrame:
    """Posts per date and hour, with the day of the month."""
    return df.groupBy(
        F.to_date(ts).alias("DATA"), F.dayofmonth(ts).alias("DIA"), F.hour(ts).alias("HORA")
    ).agg(F.count("*").alias("posts"))


def _mean_with_interval(value: str) -> list[Column]:
    """Mean with the 95 % normal interval, mean ± 1.96 s / √n."""
    half = 1.96 * F.stddev_samp(value) / F.sqrt(F.count(value))
    return [
        F.count(value).alias("groups"),
        F.avg(value).alias("mean_posts"),
        (F.avg(value) - half).alias("low"),
        (F.avg(value) + half).alias("high"),
    ]


def bootstrap_interval(
    df: DataFrame, by: list[str], unit: str, value: str, replicates: int = REPLICATES, seed: int = 0
) -> DataFrame:
    """Mean of a value per group with its bootstrap percentile interval: (by, mean, low, high).

    Each unit (a date) has a Poisson weight of mean one in each replicate, from an MD5 of seed, unit and
    replicate; a replicate's mean is the weighted one, and where no unit of a group has weight, it does not
    count. All replicates are one aggregate; what is shuffled is a row per group, replicate and task.
    Rows of a null unit are a unit of their own; null values do not count.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("_x"), F.explode(
        F.sequence(F.lit(1), F.lit(replicates))).alias("_r"),
        F.coalesce(F.col(unit).cast("string"), F.lit("")).alias("_unit"))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), "_unit", F.col("_r").cast("string")))
    u = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)
    weight = sum((F.when(u >= p, 1).otherwise(0) for p in POISSON), F.lit(0))
    drawn = rows.withColumn("_w", weight).groupBy(*by, "_r").agg(
        (F.sum(F.col("_w") * F.col("_x")) / F.nullif(F.sum("_w"), F.lit(0))).alias("_mean"),
    )
    limits = [F.percentile("_mean", p).alias(n) for p, n in zip(LIMITS, ("low", "high"))]
    means = df.groupBy(*by).agg(F.avg(value).alias("mean"))
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"i.{c}")) for c in by]
    return means.alias("m").join(drawn.groupBy(*by).agg(*limits).alias("i"), same, "left").select(
        *[F.col(f"m.{c}") for c in by], "mean", "low", "high"
    )


def weekday_means(df: DataFrame, ts: str) -> DataFrame:
    """Mean count per date of each weekday, Monday first."""
    daily = df.groupBy(
        F.to_date(ts).alias("DATA"),
        F.weekday(ts).alias("weekday"),
        F.date_format(ts, "EEEE").alias("DIA_SEMANA"),
    ).agg(F.count("*").alias("posts"))
    means = daily.groupBy("weekday", "DIA_SEMANA").agg(*_mean_with_interval("posts"))
    return means.orderBy("weekday")


def hour_means(df: DataFrame, ts: str) -> DataFrame:
    """Mean over the dates of the count in each hour of the day."""
    return (
        posts_per_day_and_hour(df, ts).groupBy("HORA").agg(*_mean_with_interval("posts"))
    )


def hourly_medians(
    df: DataFrame, label: str, hour: str, counters: list[str] | None = None
) -> DataFrame:
    counters = counters or COUNTERS
    return df.groupBy(label, hour).agg(
        *[F.median(c).alias(c.replace("count", "median")) for c in counters]
    )
