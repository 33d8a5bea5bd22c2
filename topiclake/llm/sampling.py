"""Bounded samples by hash, the same rows however the table is cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def least_rows(df: DataFrame, order: Column, n: int) -> DataFrame:
    """At most ``n`` rows, those with the least value of a 64-bit hash; of equal values one.

    A count tells below which value about three times as many rows lie. Only those are compared, so
    what leaves the tasks does not grow with their number. If copies leave too few different values,
    the bound is raised.
    """
    keyed = df.withColumn("_order", order)
    total = df.count()
    share = min(1.0, 3 * n / max(total, 1))
    while True:
        low = keyed if share >= 1 else keyed.filter(F.col("_order") < int(-(2**63) + share * 2**64))
        low = low.dropDuplicates(["_order"])
        if share >= 1 or low.count() >= n:
            return low.orderBy("_order").limit(n).drop("_order")
        share = min(1.0, share * 8)
