"""Session helpers: the shared work folder, staged tables and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import topiclake

# Task code is pickled by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(topiclake)

# Largest table that may be broadcast or collected, in rows.
SMALL_ROWS = 100_000

_local_dirs: dict[str, str] = {}


def build_session(app: str = "topiclake", master: str = "local[*]", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``.

    A local session without the setting gets its own folder; a cluster must name one, because a
    folder on one machine is lost with that machine.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _local_dirs:
        _local_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="topiclake-")
    return _local_dirs[sc.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{work_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a table below the shared folder and read it back.

    Cuts the lineage, fixes values that would change on recomputation (such as partition ids),
    survives the loss of executors, and computes the input once.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Mark a table for broadcast if a count proves it small; else leave the plan to Spark."""
    few = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if few else df


def spread(df: DataFrame) -> DataFrame:
    """Give a scan with fewer splits than cores one task per core; a join would be run to be counted.

    Large inputs already have more splits than that and are left alone, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
