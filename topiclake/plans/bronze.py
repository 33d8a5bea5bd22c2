"""Raw CSV files into the bronze table, one day of files at a time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topiclake.sources.catalog import Catalog
from topiclake.sources.feed import DATE, input_files, oldest_files, read_csv


def with_day(df: DataFrame) -> DataFrame:
    """Partition column: the day of the month a post was created on."""
    return df.withColumn("day_collect", F.dayofmonth("created_at"))


def with_month(df: DataFrame) -> DataFrame:
    """Year and month a post was created in, as one number such as 202412."""
    return df.withColumn("month_collect", F.year("created_at") * 100 + F.month("created_at"))


def load_oldest_day(catalog: Catalog, landing: str) -> str | None:
    """Append the oldest day of files not loaded yet; returns its date, None if nothing is new.

    Loaded files are listed in a table instead of being moved, so a restart knows what it did. The
    list is written last and names the batch: rows that a load left behind when it broke off belong
    to a batch that is not listed, and nothing reads them.
    """
    dates = _load_files(catalog, oldest_files(_new_files(catalog, landing)))
    return dates[0] if dates else None


def load_backlog(catalog: Catalog, landing: str) -> list[str]:
    """Append all days of files not loaded yet in one pass; returns their dates, the oldest first.

    Each day is a batch of its own, as if the days had been loaded one by one; the jobs do not grow
    with the number of days.
    """
    return _load_files(catalog, _new_files(catalog, landing))


def _new_files(catalog: Catalog, landing: str) -> DataFrame:
    known = catalog.load("bronze", "files")
    return input_files(catalog.spark, landing).join(known.select("file"), "file", "left_anti")


def _load_files(catalog: Catalog, files: DataFrame) -> list[str]:
    """Append the rows of the files, a batch for each date."""
    found = [(r["file"], r["file_date"]) for r in files.collect()]
    if not found:
        return []
    run = uuid.uuid4().hex
    posts = read_csv(catalog.spark, [f for f, _ in found])
    posts = with_day(posts).withColumn("source_file", F.col("_metadata.file_path"))
    date = F.regexp_extract("source_file", DATE, 1)
    catalog.append(posts.withColumn("batch", F.concat(F.lit(f"{run}-"), date)), "bronze", "posts")
    listed = catalog.spark.createDataFrame(
        [(f, d, f"{run}-{d}") for f, d in found], "file string, file_date string, batch string"
    )
    # One file, so that the batches are listed together or not at all.
    catalog.append(listed.coalesce(1), "bronze", "files")
    return sorted({d for _, d in found})


def batches(catalog: Catalog) -> DataFrame:
    """(batch, file_date) of the finished loads; the date is that of the oldest file."""
    return catalog.load("bronze", "files").groupBy("batch").agg(F.min("file_date").alias("file_date"))


def posts(catalog: Catalog) -> DataFrame:
    """Rows of the finished loads."""
    return catalog.load("bronze", "posts").join(batches(catalog), "batch", "left_semi")
