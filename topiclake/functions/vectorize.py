"""Text to dense vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import IDF, HashingTF, IDFModel, Normalizer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

# Width of a post vector.
DIMENSIONS = 384


def fit_idf(df: DataFrame, text: str, dimensions: int = DIMENSIONS) -> IDFModel:
    """Document frequencies of the hashed words: one vector, whatever the corpus."""
    hashed = _hashed(df, text, dimensions)
    return IDF(inputCol="_tf", outputCol="_idf").fit(hashed)


def _hashed(df: DataFrame, text: str, dimensions: int) -> DataFrame:
    words = df.withColumn("_w", F.filter(F.split(text, " "), lambda w: w != ""))
    return HashingTF(numFeatures=dimensions, inputCol="_w", outputCol="_tf").transform(words)


def vectorize(
    df: DataFrame, text: str, encoder: Callable | None = None, idf: IDFModel | None = None,
    dimensions: int = DIMENSIONS, batch_size: int = 256, out: str = "embedding",
) -> DataFrame:
    """Add ``embedding`` (array<float>).

    ``encoder`` is a function without arguments that loads a model and returns a function from a
    numpy array of strings to a matrix; each Python worker loads it once. Without one, words are
    hashed, weighted by ``idf`` if given, and scaled to length one.
    """
    if encoder is not None:
        udf = predict_batch_udf(
            encoder, return_type=ArrayType(FloatType()), batch_size=batch_size
        )
        return df.withColumn(out, udf(text))
    hashed = _hashed(df, text, dimensions)
    source = "_tf"
    if idf is not None:
        hashed, source = idf.transform(hashed), idf.getOutputCol()
    scaled = Normalizer(inputCol=source, outputCol="_n").transform(hashed)
    return scaled.withColumn(out, vector_to_array("_n", "float32")).drop("_w", "_tf", "_idf", "_n")
