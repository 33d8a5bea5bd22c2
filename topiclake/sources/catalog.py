"""The lake's tables below one root folder."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topiclake.schemas import PARTITIONED, TABLES


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table with a fixed schema; an empty frame if the folder does not exist."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def high_water(df: DataFrame, column: str):
    """Greatest value of a column, None for an empty table."""
    return df.agg(F.max(column)).first()[0]


def first_mark(ts: str) -> Column:
    """The last second of the day before the earliest row: every row lies after it."""
    return F.date_trunc("day", F.min(ts)) - F.expr("INTERVAL 1 SECOND")


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, layer: str, table: str) -> str:
        return f"{self.root}/{layer}/{table}"

    def load(self, layer: str, table: str) -> DataFrame:
        """All files of a table, with the partition column; empty before the first write."""
        return read_or_empty(self.spark, self.path(layer, table), TABLES[layer, table])

    def _writer(self, df: DataFrame, layer: str, table: str, mode: str):
        columns = self.spark.createDataFrame([], TABLES[layer, table]).schema
        out = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in columns])
        parts = PARTITIONED.get((layer, table))
        if parts:
            # Few files per day, and a day too large for one task is split over several.
            return out.hint("rebalance", *parts).write.mode(mode).partitionBy(*parts)
        return out.write.mode(mode)

    def append(self, df: DataFrame, layer: str, table: str) -> None:
        self._writer(df, layer, table, "append").parquet(self.path(layer, table))

    def replace_load(self, df: DataFrame, layer: str, table: str) -> None:
        """Write the partitions of one load; a load that is run again replaces its own rows."""
        writer = self._writer(df, layer, table, "overwrite")
        writer.option("partitionOverwriteMode", "dynamic").parquet(self.path(layer, table))

    def overwrite(self, df: DataFrame, layer: str, table: str) -> None:
        self._writer(df, layer, table, "overwrite").parquet(self.path(layer, table))
