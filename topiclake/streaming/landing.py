"""The same loads as streams over the landing folder and the bronze table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from topiclake.plans.bronze import with_day, with_month
from topiclake.plans.silver import (
    COUNTERS, TextPlan, counters, digests, load_posts, seen_in,
)
from topiclake.schemas import RAW, TABLES
from topiclake.sources.catalog import Catalog
from topiclake.sources.feed import CSV


def read_landing(
    spark: SparkSession, landing: str, archive: str | None = None, files_per_batch: int | None = None
) -> DataFrame:
    """CSV files as a stream. With ``archive`` consumed files move there, one batch late."""
    reader = spark.readStream.schema(RAW).options(**CSV).option("recursiveFileLookup", "true")
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    return reader.csv(landing).withColumn("source_file", F.col("_metadata.file_path"))


def recollected_once(posts: DataFrame, ledger: DataFrame) -> DataFrame:
    """Each post once, with its highest counters, unless the ledger has it with counters as high,
    however old it is. Posts and ledger meet by the digests, so the texts are shuffled once."""
    same = ["day_collect", "h1", "h2"]
    rest = [c for c in posts.columns if c not in (*COUNTERS, "day_collect")]
    best = F.max(F.struct(*COUNTERS, *rest)).alias("_best")
    fresh = digests(posts).groupBy(*same).agg(best)
    seen = seen_in(ledger, posts, *COUNTERS).groupBy(*same).agg(F.max(counters()).alias("_known"))
    fresh = fresh.join(seen, same, "left").select("day_collect", "_known", "_best.*")
    return fresh.filter(F.col("_known").isNull() | (counters() > F.col("_known"))).drop("_known")


def start_bronze(
    catalog: Catalog, landing: str, checkpoint: str, archive: str | None = None,
    once: bool = True, files_per_batch: int | None = None,
) -> StreamingQuery:
    """Append new files to the bronze table; the checkpoint knows which files are done.

    With ``once`` a post that was landed before is dropped: its digest is in the ledger, so nothing
    depends on how late it comes. Only a copy with higher counters is landed too, so that the highest
    of a post's rows are those of all its copies, in whatever order they come. A batch that is run again replaces the partitions of its first try.
    """

    def land(batch: DataFrame, number: int) -> None:
        name = f"stream-{number}"
        rows = with_day(batch)
        if once:
            rows = recollected_once(rows, catalog.load("bronze", "ledger").filter(F.col("batch") != name))
        catalog.replace_load(rows.withColumn("batch", F.lit(name)), "bronze", "posts")
        # From the rows as they are written, so that no other copy of the texts is.
        landed = catalog.load("bronze", "posts").filter(F.col("batch") == name)
        catalog.replace_load(digests(with_month(landed)), "bronze", "ledger")
        listed = [(None, None, name)]
        catalog.append(
            catalog.spark.createDataFrame(listed, TABLES["bronze", "files"]), "bronze", "files"
        )

    posts = read_landing(catalog.spark, landing, archive, files_per_batch)
    return (
        posts.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def start_silver(
    catalog: Catalog, checkpoint: str, text_plan: TextPlan | None = None,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Load new bronze rows into the star, batch by batch.

    A batch that is run again after a failure finds its posts in the ledger, so none is doubled,
    and late posts are loaded whenever they come. Higher counters of a copy that comes later replace
    those of its post.
    """
    reader = catalog.spark.readStream.schema(TABLES["bronze", "posts"])
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    posts = reader.parquet(catalog.path("bronze", "posts")).drop("source_file", "batch")

    def load(batch: DataFrame, _: int) -> None:
        load_posts(catalog, batch, text_plan)

    return (
        posts.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
