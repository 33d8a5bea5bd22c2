"""Corpus pipeline: quality, near-duplicates, decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir), works on every row that the stage before kept, and returns a
DataFrame; it is written as Parquet and read again as the docs of the next stage. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topiclake.llm import bpe, cotraining, decontaminate, neardup, secrets
from topiclake.session import new_path

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the co-trained classifier does not reject.

    It is trained on the labels of documents that are here; without labels of both kinds all rows
    stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = cotraining.fit(docs, labels)
    return cotraining.keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by a similarity of 0.8 over shingles of five words.

    The least id stays; of repeated rows of that id and text one stays. Texts without words are in
    no group and stay, each row of them.
    """
    return neardup.drop_near_duplicates(docs, "doc_id", "text", shingle=5, limit=(4, 5))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which windows of benchmark items cover a twentieth of the words."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by a mark; the stated length follows the text."""
    clean = secrets.redact_all(docs, "text", secrets.fit(docs))
    changed = F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, the byte of the text behind each token, and their number.

    The text itself goes; a null text has no tokens.
    """
    return bpe.encode_all(docs, "text", public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("secrets", without_secrets),
    ("tokens", tokens),
]
# A trained classifier and a trained network decide in two stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
