"""Dense sequential keys without sorting everything into one partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topiclake.session import SMALL_ROWS, small_side, stage

_ROW_BITS = (1 << 33) - 1


def assign_keys(
    df: DataFrame, key: str, start: int = 1, order_by: list[str] | None = None,
    within: str | None = None,
) -> DataFrame:
    """Number the rows ``start, start + 1, …``.

    Rows are numbered inside their partition and each partition starts where the one before ends.
    The numbering is written down before it is used, so a recomputed partition cannot renumber.
    With ``order_by`` the keys follow that order: by a range partitioning, or in one task if a count
    proves the rows few. With ``within`` rows of a lower value of that column get lower keys; nothing
    but its counts per partition is moved for that.
    """
    if order_by:
        df = stage(df, "unordered")
        if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
            place = F.row_number().over(Window.orderBy(*order_by))
            return df.withColumn(key, (place + F.lit(start - 1)).cast("long"))
        df = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    if within:
        df = df.sortWithinPartitions(within)
    tagged = stage(
        df.withColumn("_p", F.spark_partition_id()).withColumn(
            "_r", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS))
        ),
        "numbered",
    )
    if within:
        return _keys_within(tagged, key, start, within)
    sizes = tagged.groupBy("_p").agg(F.count("*").alias("n"))
    # One row per partition of the input: as many rows as tasks, whatever the data.
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_o"))
    return tagged.join(F.broadcast(offsets), "_p").select(
        *[c for c in tagged.columns if c not in ("_p", "_r")],
        (F.col("_o") + F.col("_r") + F.lit(start)).cast("long").alias(key),
    )


def _keys_within(tagged: DataFrame, key: str, start: int, within: str) -> DataFrame:
    """Keys of rows that lie in order of ``within`` in each partition ``_p``, at places ``_r``."""
    sizes = stage(
        tagged.groupBy("_p", within).agg(F.count("*").alias("n"), F.min("_r").alias("_first")), "sizes"
    )
    total = sizes.groupBy(within).agg(F.sum("n").alias("n"))
    lower = Window.orderBy(within).rowsBetween(Window.unboundedPreceding, -1)  # one row per value
    before = Window.partitionBy(within).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.join(
        F.broadcast(total.select(within, F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("_l"))), within
    ).select(
        "_p", within, (F.col("_l") + F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("_first")).alias("_o")
    )
    return tagged.join(small_side(offsets, 10 * SMALL_ROWS), ["_p", within]).select(
        *[c for c in tagged.columns if c not in ("_p", "_r")],
        (F.col("_o") + F.col("_r") + F.lit(start)).cast("long").alias(key),
    )


def index_within(df: DataFrame, by: str, order: str, index: str) -> DataFrame:
    """Number the distinct rows of each ``by`` group from zero in the order of ``order``."""
    if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        w = Window.partitionBy(by).orderBy(order)
        return df.withColumn(index, F.row_number().over(w) - 1)
    numbered = assign_keys(df, "_k", 0, [by, order])
    first = numbered.groupBy(by).agg(F.min("_k").alias("_first"))
    return numbered.join(small_side(first), by).withColumn(
        index, (F.col("_k") - F.col("_first")).cast("int")
    ).drop("_k", "_first")
