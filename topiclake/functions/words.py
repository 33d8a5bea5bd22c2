"""Word-level expressions: stop words, tokens and the plain-ASCII test."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from topiclake.functions.clean import SPACE
from topiclake.session import SMALL_ROWS, stage

# Common English stop words.
ENGLISH = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very s
t can will just don should now d ll m o re ve y ain aren couldn didn doesn hadn hasn haven isn ma
mightn mustn needn shan shouldn wasn weren won wouldn
you're you've you'll you'd she's it's that'll don't should've aren't couldn't didn't doesn't hadn't
hasn't haven't isn't mightn't mustn't needn't shan't shouldn't wasn't weren't won't wouldn't
""".split()
ENGLISH += [w.replace("'", "") for w in ENGLISH if "'" in w]

MIN_LENGTH = 3


def tokens(text: Column | str) -> Column:
    """Words between single spaces; an empty text gives one empty word."""
    return F.split(text, " ")


def drop_words(text: Column | str, stops: Iterable[str], min_length: int = MIN_LENGTH) -> Column:
    """Text without stop words and short words, as one narrow expression.

    The membership test becomes a hash-set lookup in the plan.
    """
    stop_list = sorted(set(stops))
    words = F.split(text, f"[{SPACE}]+")
    keep = F.filter(
        words, lambda w: (F.length(w) >= min_length) & ~w.isin(stop_list) if stop_list
        else F.length(w) >= min_length,
    )
    return F.array_join(keep, " ")


def remove_stopwords(
    df: DataFrame, text: str, stop_df: DataFrame, min_length: int = MIN_LENGTH,
    max_words: int = SMALL_ROWS,
) -> DataFrame:
    """Remove the words of a one-column table from ``text``; a null text stays null.

    A list that a count proves small goes into the expression. A longer one is anti-joined word by
    word, and the texts are put together again by a number that each row gets for it. Both ways give
    equal rows, whatever keys the table has.
    """
    word = stop_df.columns[0]
    found = [r[0] for r in stop_df.select(word).dropna().distinct().limit(max_words + 1).collect()]
    if len(found) <= max_words:
        return df.withColumn(text, drop_words(text, found, min_length))
    rows = stage(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    exploded = rows.select("_row", F.posexplode(F.split(text, f"[{SPACE}]+")).alias("_pos", "_word"))
    kept = exploded.filter(F.length("_word") >= min_length).join(
        stop_df.select(F.col(word).alias("_word")), "_word", "left_anti"
    )
    whole = kept.groupBy("_row").agg(
        F.array_sort(F.collect_list(F.struct("_pos", "_word"))).alias("_w")
    )
    joined = rows.join(whole, "_row", "left")
    left = F.coalesce(F.array_join(F.col("_w._word"), " "), F.lit(""))
    return joined.withColumn(text, F.when(F.col(text).isNotNull(), left)).select(*df.columns)


@F.arrow_udf(BooleanType())
def _plain_after_nfkc(text: pa.Array) -> pa.Array:
    def plain(s):
        return all(c.isascii() and c.isalnum() for c in unicodedata.normalize("NFKC", s))

    return pa.array([None if s is None else plain(s) for s in text.to_pylist()], pa.bool_())


def is_ascii_alnum(text: Column | str) -> Column:
    """Whether all characters are ASCII letters or digits after NFKC normalisation.

    Spark has no NFKC function. ASCII text is its own normal form and is decided without Python.
    """
    col = F.col(text) if isinstance(text, str) else text
    ascii_only = col.rlike(r"\A\p{ASCII}*\z")
    return F.when(ascii_only, col.rlike(r"\A[A-Za-z0-9]*\z")).otherwise(
        _plain_after_nfkc(F.when(~ascii_only, col))
    )


def first_part(handle: Column | str) -> Column:
    """First component of a dotted handle."""
    return F.split_part(F.col(handle) if isinstance(handle, str) else handle, F.lit("."), F.lit(1))
