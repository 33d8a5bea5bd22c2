"""The post view that stands in for the feed, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topiclake.functions.clean import EMOJI, HAPPY, PUNCTUATION, SAD, SIGNS, SPACE, clean_text
from topiclake.functions.words import ENGLISH, MIN_LENGTH, drop_words
from topiclake.operators.labels import label_all
from topiclake.session import spread, stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The scan is spread, not the join: to count the partitions of a join, Spark would run it.
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    joined = docs.join(events, docs.doc_id == events.event_id)
    return joined.select(
        F.col("doc_id").alias("SK_post"),
        F.concat(F.lit("u"), F.col("user_id"), F.lit(".example.social")).alias("author"),
        "text",
        F.col("ts").alias("created_at"),
        F.floor("value").cast("int").alias("like_count"),
        (F.col("event_id") % 13).cast("int").alias("repost_count"),
        (F.col("event_id") % 5).cast("int").alias("quote_count"),
        (F.col("event_id") % 7).cast("int").alias("reply_count"),
    )


def event_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events alone as posts: they span a month, so the calendar reports use them."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("SK_post"), F.col("ts").alias("created_at")
    )


def words_of(text: str):
    return drop_words(clean_text(text), ENGLISH)


def cleaned(spark: SparkSession, sf_dir: str, written: bool = False) -> DataFrame:
    """Posts with ``post``, the cleaned text without stop words.

    Reports that read the text more than once have it ``written`` first, as the silver table is.
    """
    rows = posts(spark, sf_dir).withColumn("post", words_of("text")).drop("text")
    return stage(rows, "cleaned") if written else rows


def cluster_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("SK_post"), F.col("quality").alias("labels")
    )


def labelled(
    spark: SparkSession, sf_dir: str, text: bool = True, written: bool = False
) -> DataFrame:
    rows = cleaned(spark, sf_dir, written) if text else posts(spark, sf_dir).drop("text")
    return label_all(rows, cluster_labels(spark, sf_dir), "SK_post")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vec"), "label"
    )


# ---------------------------------------------------------------- SQL


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_clean(col: str) -> str:
    """The cleaning steps for an engine without look-around and back-references."""

    def sub(expr: str, pattern: str, replacement: str = "") -> str:
        return f"regexp_replace({expr}, {quoted(pattern)}, {quoted(replacement)}, 'g')"

    e = sub(col, f"[{EMOJI}]+")
    e = sub(e, f"@[^{SPACE}]+")
    e = sub(e, r"<[^>\n]*>")
    e = sub(e, r"[-+]?[.\p{Nd}]*\p{Nd}+[:,./\p{Nd}]*")
    e = sub(e, f"https?://[^{SPACE}]+|www\\.[^{SPACE}]+", "URL")
    e = sub(e, r"[!?.]*([!?.])", r"\1 ")
    e = sub(e, HAPPY)
    e = sub(e, SAD)
    e = f"translate({e}, {quoted(PUNCTUATION)}, '')"
    for letter in "abcdefghijklmnopqrstuvwxyz":
        e = sub(e, letter + r"{3,}([^\p{L}\p{N}_]|$)", letter + r" \1")
    e = f"replace({e}, ' - ', ' ')"
    e = sub(e, f"[{SPACE}]+", " ")
    e = (
        f"array_to_string(list_transform(string_split({e}, ' '), "
        f"lambda w: trim(w, {quoted(SIGNS)})), ' ')"
    )
    return f"lower({e})"


def sql_drop_words(expr: str) -> str:
    stops = ", ".join(quoted(w) for w in sorted(set(ENGLISH)))
    return (
        f"array_to_string(list_filter(string_split({expr}, ' '), "
        f"lambda w: length(w) >= {MIN_LENGTH} and w not in ({stops})), ' ')"
    )


POSTS = """posts AS (
  SELECT d.doc_id AS "SK_post", 'u' || e.user_id || '.example.social' AS author, d.text,
         e.ts AS created_at, CAST(floor(e.value) AS INT) AS like_count,
         CAST(e.event_id % 13 AS INT) AS repost_count, CAST(e.event_id % 5 AS INT) AS quote_count,
         CAST(e.event_id % 7 AS INT) AS reply_count
  FROM documents d JOIN events e ON d.doc_id = e.event_id)"""

CLEANED = (
    POSTS
    + f""", cleaned AS MATERIALIZED (
  SELECT * EXCLUDE (text), {sql_drop_words("c")} AS post
  FROM (SELECT *, {sql_clean("text")} AS c FROM posts))"""
)

LABELLED = (
    CLEANED
    + """, labelled AS (
  SELECT c.* EXCLUDE (c), coalesce(l.quality, -1) AS labels
  FROM cleaned c LEFT JOIN labels l ON l.doc_id = c."SK_post")"""
)

LABELLED_ROWS = (
    POSTS
    + """, labelled AS (
  SELECT p.* EXCLUDE (text), coalesce(l.quality, -1) AS labels
  FROM posts p LEFT JOIN labels l ON l.doc_id = p."SK_post")"""
)
