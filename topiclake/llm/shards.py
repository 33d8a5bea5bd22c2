"""Sharding by rendezvous hashing: stable record keys over weighted shards.

Every shard draws a score for a record from the record's key and its own number, and the highest
score takes the record. A shard that is added can only win records for itself; a shard that is
removed gives up only its own. Built-in functions only: the assignment is narrow, and no row
depends on another.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topiclake.llm.columns import unused
from topiclake.session import stage

# 52 bits of an MD5 digest become a number in (0, 1).
_DIGITS = 13
_RANGE = float(16**_DIGITS)
# Rows that a task numbers.
TASK_ROWS = 2_000_000


def draw(key: Column, shard: int) -> Column:
    """A uniform number in (0, 1) from the key (as text; null is the empty text) and the shard."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f"/{shard}"))
    digits = F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10).cast("long")
    return (digits + F.lit(0.5)) / F.lit(_RANGE)


def score(key: Column, shard: int, weight: float) -> Column:
    """Weight over the exponential variate of the draw: shards win in proportion to weight."""
    return F.lit(-float(weight)) / F.log(draw(key, shard))


def winner(key: Column, weights: Sequence[float]) -> Column:
    """Shard number with the highest score; a shard of weight 0 takes nothing.

    Equal scores go to the lower number. Null keys are one key, repeated keys stay together.
    """
    entries = [
        F.struct(score(key, i, w).alias("score"), F.lit(-i).alias("negated"))
        for i, w in enumerate(weights)
        if w > 0
    ]
    if not entries:
        raise ValueError("at least one shard needs a positive weight")
    return -F.array_max(F.array(*entries)).getField("negated")


def assign(df: DataFrame, key: str, weights: Sequence[float], column: str = "shard") -> DataFrame:
    """The rows with their shard in ``column``, which replaces a column of that name."""
    return df.withColumn(column, winner(F.col(key), weights).cast("int"))


def with_slots(df: DataFrame, shard: str, order: Sequence[Column], slot: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without gaps, in the given order.

    The rows are range-partitioned by shard, order and their place in the input, so a shard of any
    size, or one key with a third of all rows, spreads over many tasks. A written copy fixes the
    place of each row; then a row's slot is its place in its partition plus the rows of the same
    shard in the partitions before. Only the counts (a row per partition and shard) pass through
    a window. Rows equal in the whole order get slots in any order. Written columns: all of ``df``,
    so hand in digests, not texts.
    """
    names = [unused(df, f"_o{i}") for i in range(len(order))]
    salt, at, part, first, rows, before = (
        unused(df, n) for n in ("_salt", "_at", "_part", "_first", "_rows", "_before")
    )
    keyed = df.select("*", *(c.alias(n) for c, n in zip(order, names)))
    keyed = stage(keyed.withColumn(salt, F.monotonically_increasing_id()), "sharded")
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), keyed.count() // TASK_ROWS)
    placed = (
        keyed.repartitionByRange(parts, shard, *names, salt)
        .sortWithinPartitions(shard, *names, salt)
        .drop(*names, salt)
        .withColumn(at, F.monotonically_increasing_id())
    )
    placed = stage(placed, "placed").withColumn(part, F.shiftright(at, 33))
    blocks = placed.groupBy(part, shard).agg(F.count("*").alias(rows), F.min(at).alias(first))
    above = Window.partitionBy(shard).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn(before, F.coalesce(F.sum(rows).over(above), F.lit(0)))
    return (
        placed.join(blocks.select(part, shard, first, before), [part, shard])
        .withColumn(slot, F.col(at) - F.col(first) + F.col(before))
        .drop(part, at, first, before)
    )


def write_shards(df: DataFrame, path: str, key: str, weights: Sequence[float]) -> None:
    """Write the rows to one folder per shard, each task writing what it has of every shard."""
    assign(df, key, weights, "shard").write.partitionBy("shard").parquet(path)
