"""Raw posts: nested feed records and headed CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topiclake.schemas import FEED, RAW

# How the raw CSV files are written.
CSV = {"header": "true", "sep": ",", "quote": '"', "escape": '"', "multiLine": "true"}
# Creation times keep their microseconds.
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
DATE = r"(\d{4}-\d{2}-\d{2})"


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEED).json(path)


def flatten_feed(df: DataFrame) -> DataFrame:
    """The seven post columns out of the nested record."""
    return df.select(
        F.col("post.author.handle").alias("author"),
        F.col("post.record.text").alias("text"),
        F.col("post.record.created_at").alias("created_at"),
        *[F.col(f"post.{c}_count") for c in ("like", "repost", "quote", "reply")],
    )


def write_csv(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Headed CSV, one folder per value of ``by``; line breaks inside quotes survive.

    Rows are brought together by ``by`` first, so that the files grow with the bytes and not with the
    product of tasks and folders.
    """
    writer = (df.hint("rebalance", *by) if by else df).write.options(**CSV).option("quoteAll", "true").option(
        "timestampFormat", TIME_FORMAT
    )
    writer = writer.option("ignoreLeadingWhiteSpace", "false").option(
        "ignoreTrailingWhiteSpace", "false"
    )
    (writer.partitionBy(*by) if by else writer).csv(path)


def read_csv(spark: SparkSession, paths: str | list[str], corrupt: str | None = None) -> DataFrame:
    """Raw posts from CSV; values that do not parse become NULL, and the line goes to ``corrupt``
    when that column is asked for."""
    schema = f"{RAW}, {corrupt} string" if corrupt else RAW
    reader = spark.read.schema(schema).options(**CSV)
    if corrupt:
        reader = reader.option("columnNameOfCorruptRecord", corrupt)
    return reader.csv(paths)


def input_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, file_date) of the files below ``path`` with a date in their name.

    Only names are listed; no file is opened.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        .select(F.col("path").alias("file"))
    )
    dated = files.withColumn("file_date", F.regexp_extract("file", DATE, 1))
    return dated.filter("file_date <> ''")


def oldest_files(files: DataFrame) -> DataFrame:
    """The files of the earliest date."""
    return files.join(files.agg(F.min("file_date").alias("file_date")), "file_date").select(
        *files.columns
    )
