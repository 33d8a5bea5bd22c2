"""Word counts, coverage, co-occurrence and vocabulary overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topiclake.functions.words import tokens
from topiclake.operators.keys import assign_keys
from topiclake.session import stage

COUNTERS = ["like_count", "repost_count", "quote_count", "reply_count"]

# Clusters that a word may be known to before it is counted in bitmaps; their width in words of 64 bits, and
# the tasks that share a block.
FEW = 32
LANES = 16
SALTS = 8
# Frequent words that are broadcast with their numbers.
NUMBERED_ROWS = 1_000_000


def word_counts(df: DataFrame, text: str, by: list[str] | None = None) -> DataFrame:
    by = by or []
    words = df.select(*by, F.explode(tokens(text)).alias("word"))
    return words.groupBy(*by, "word").agg(F.count("*").alias("n"))


def top_words(df: DataFrame, text: str, n: int = 20) -> DataFrame:
    return word_counts(df, text).orderBy(F.desc("n"), "word").limit(n)


def word_weights(df: DataFrame, text: str) -> DataFrame:
    """Count of each word relative to the most frequent one."""
    counts = word_counts(df, text)
    top = counts.agg(F.max("n").alias("top")).scalar()
    return counts.select("word", "n", (F.col("n") / top).alias("weight"))


def frequent_words(df: DataFrame, text: str, min_freq: int = 150) -> DataFrame:
    return word_counts(df, text).filter(F.col("n") >= min_freq)


def vocab_coverage(df: DataFrame, key: str, text: str, min_freq: int = 150) -> DataFrame:
    """How much of the vocabulary, of the tokens and of the posts the frequent words make up."""
    counts = word_counts(df, text)
    often = F.col("n") >= min_freq
    totals = counts.agg(
        F.count_if(often).alias("frequent_words"),
        F.count("*").alias("vocabulary"),
        F.sum("n").alias("tokens"),
        F.coalesce(F.sum(F.when(often, F.col("n"))), F.lit(0)).alias("frequent_tokens"),
    )
    posts = df.agg(F.count("*").alias("posts")).scalar()
    covered = (
        df.select(key, F.explode(F.array_distinct(tokens(text))).alias("word"))
        .join(counts.filter(often).select("word"), "word", "left_semi")
        .agg(F.count_distinct(key).alias("covered"))
        .scalar()
    )
    return totals.select(
        "frequent_words",
        (F.col("tokens") - F.col("frequent_words")).alias("other_tokens"),
        F.try_divide("frequent_words", "vocabulary").alias("vocab_share"),
        F.try_divide("frequent_tokens", "tokens").alias("token_coverage"),
        F.try_divide(covered, posts).alias("post_coverage"),
    )


def cooccurrence(df: DataFrame, text: str, min_freq: int = 150, directed: bool = False) -> DataFrame:
    """Weighted edges between neighbouring frequent words of the same post.

    Neighbours come from the token array itself, so no window sort is needed. Frequent words that a
    count finds few enough for a broadcast are numbered, and only pairs of them are counted, as one
    number each; else pairs are counted before the frequent words are joined.
    """
    arr = df.select(tokens(text).alias("w1"))
    arr = arr.filter(F.size("w1") > 1).withColumn("w2", F.slice("w1", 2, F.size("w1")))
    pairs = arr.select(F.inline(F.arrays_zip("w1", "w2"))).filter("w2 is not null")
    often = stage(frequent_words(df, text, min_freq).select("word"), "frequent")
    if often.limit(NUMBERED_ROWS + 1).count() <= NUMBERED_ROWS:
        return _numbered_edges(pairs, often, directed)
    if not directed:
        pairs = pairs.select(
            F.least("w1", "w2").alias("w1"), F.greatest("w1", "w2").alias("w2")
        )
    edges = (
        pairs.filter(F.col("w1") != F.col("w2"))
        .groupBy("w1", "w2")
        .agg(F.count("*").alias("weight"))
    )
    for side in ("w1", "w2"):
        edges = edges.join(often.withColumnRenamed("word", side), side, "left_semi")
    return edges.select("w1", "w2", "weight")


def _numbered_edges(pairs: DataFrame, often: DataFrame, directed: bool) -> DataFrame:
    """Edges of the pairs (w1, w2) of different frequent words; the number of a pair holds those of both."""
    # Numbers follow the order of the words: the least of two belongs to the least word.
    ids = stage(assign_keys(often, "id", 0, ["word"]), "ids")
    for side in ("w1", "w2"):
        named = ids.select(F.col("word").alias(side), F.col("id").alias(f"{side}_id"))
        pairs = pairs.join(F.broadcast(named), side)  # counted
    a, b = F.col("w1_id"), F.col("w2_id")
    ends = (a, b) if directed else (F.least(a, b), F.greatest(a, b))
    counts = pairs.filter(a != b).groupBy((ends[0] * 2**32 + ends[1]).alias("pair")).agg(
        F.count("*").alias("weight")
    )
    places = {"w1": F.shiftright("pair", 32), "w2": F.col("pair").bitwiseAND(F.lit(2**32 - 1))}
    edges = counts.select("weight", *[place.alias(f"{side}_id") for side, place in places.items()])
    for side in places:
        named = ids.select(F.col("word").alias(side), F.col("id").alias(f"{side}_id"))
        edges = edges.join(F.broadcast(named), f"{side}_id")  # counted
    return edges.select("w1", "w2", "weight")


def top_words_per_cluster(df: DataFrame, label: str, text: str, n: int = 5) -> DataFrame:
    """The rank filter becomes a group limit below the shuffle, so a hot label is cut early."""
    order = Window.partitionBy(label).orderBy(F.desc("n"), "word")
    ranked = word_counts(df, text, [label]).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= n)


def topic_coverage(df: DataFrame, label: str, text: str, n: int = 5) -> DataFrame:
    """Tokens covered by the top words of each cluster, and all other tokens."""
    top = top_words_per_cluster(df, label, text, n).groupBy(label).agg(F.sum("n").alias("covered"))
    total = df.groupBy(label).agg(F.sum(F.size(tokens(text))).alias("total"))
    return top.join(total, label).select(
        label, "covered", (F.col("total") - F.col("covered")).alias("other")
    )


def topic_interactions(
    df: DataFrame, label: str, text: str, n: int = 5, counters: list[str] | None = None
) -> DataFrame:
    """Median counters over the posts that contain each of a cluster's top words."""
    counters = counters or COUNTERS
    top = top_words_per_cluster(df, label, text, n).select(label, "word")
    holding = df.select(
        label, *counters, F.explode(F.array_distinct(tokens(text))).alias("word")
    ).join(top, [label, "word"], "left_semi")
    return holding.groupBy(label, "word").agg(
        F.count("*").alias("posts"),
        *[F.median(c).alias(c.replace("count", "median")) for c in counters],
    )


def vocabulary(df: DataFrame, label: str, text: str, include_noise: bool = True) -> DataFrame:
    rows = df if include_noise else df.filter(F.col(label) != -1)
    return rows.select(label, F.explode(tokens(text)).alias("word")).distinct()


def _shared_rare(vocab: DataFrame, label: str, known: DataFrame) -> DataFrame:
    """(a, b, words) from words of at most ``FEW`` clusters: sets first, each unfolded to pairs once."""
    sets = (
        vocab.join(known.filter(F.col("k").between(2, FEW)).select("word"), "word")
        .groupBy("word")
        .agg(F.array_sort(F.collect_set(label)).alias("s"))
        .groupBy("s")
        .agg(F.count("*").alias("words"))
    )
    return (
        sets.select("s", "words", F.posexplode("s").alias("i", "a"))
        .select("a", "words", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b"))
        .select("a", "b", "words")
    )


def _shared_common(vocab: DataFrame, label: str, known: DataFrame) -> DataFrame:
    """(a, b, words) from words of more clusters: a bitmap per cluster and block of 64 × ``LANES`` words.

    A pair of clusters is a row once per block, not once per word. The rows of a block are dealt to
    ``SALTS`` tasks by the cluster, because a block may hold every cluster.
    """
    numbered = assign_keys(known.filter(F.col("k") > FEW).select("word"), "id", 0)
    bit = F.expr("shiftleft(1L, cast(pmod(id, 64) AS int))")
    lane = F.pmod(F.floor(F.col("id") / 64), F.lit(LANES))
    lanes = [F.coalesce(F.bit_or(F.when(lane == i, bit)), F.lit(0).cast("long")).alias(f"w{i}") for i in range(LANES)]
    blocks = vocab.join(numbered, "word").groupBy(
        F.col(label).alias("c"), F.floor(F.col("id") / (64 * LANES)).alias("block")
    ).agg(*lanes)
    blocks = stage(blocks, "bitmaps")
    salt = F.pmod(F.hash("c"), F.lit(SALTS))
    left = blocks.withColumn("salt", salt).alias("x")
    right = blocks.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))).alias("y")
    near = (F.col("x.block") == F.col("y.block")) & (F.col("x.salt") == F.col("y.salt"))
    both = sum(
        (F.bit_count(F.col(f"x.w{i}").bitwiseAND(F.col(f"y.w{i}"))) for i in range(LANES)), F.lit(0)
    )
    return left.join(right, near & (F.col("x.c") < F.col("y.c"))).groupBy(
        F.col("x.c").alias("a"), F.col("y.c").alias("b")
    ).agg(F.sum(both).alias("words"))


def vocabulary_jaccard(
    df: DataFrame, label: str, text: str, include_noise: bool = True
) -> DataFrame:
    """Jaccard similarity of the vocabularies of every two clusters that share a word.

    Words of few clusters are counted by their sets of clusters, and only those few sets are unfolded
    to pairs; words of many clusters are counted in bitmaps, so no list grows with the clusters.
    """
    vocab = stage(vocabulary(df, label, text, include_noise).filter(F.col(label).isNotNull()), "vocabulary")
    sizes = vocab.groupBy(label).agg(F.count("*").alias("size"))
    known = vocab.groupBy("word").agg(F.count("*").alias("k"))
    shared = (
        _shared_rare(vocab, label, known).unionByName(_shared_common(vocab, label, known))
        .groupBy("a", "b")
        .agg(F.sum("words").alias("both"))
        .filter("both > 0")
    )
    left = sizes.select(F.col(label).alias("a"), F.col("size").alias("size_a"))
    right = sizes.select(F.col(label).alias("b"), F.col("size").alias("size_b"))
    either = F.col("size_a") + F.col("size_b") - F.col("both")
    return (
        shared.join(left, "a").join(right, "b")
        .select("a", "b", "both", either.alias("either"), (F.col("both") / either).alias("jaccard"))
    )


def mean_jaccard(df: DataFrame, label: str, text: str, include_noise: bool = True) -> DataFrame:
    """Mean over all pairs of clusters; pairs without a common word count as zero."""
    rows = df if include_noise else df.filter(F.col(label) != -1)
    clusters = rows.agg(F.count_distinct(label).alias("k")).scalar()
    pairs = vocabulary_jaccard(df, label, text, include_noise)
    return pairs.agg(F.coalesce(F.sum("jaccard"), F.lit(0.0)).alias("total")).select(
        F.when(clusters > 1, F.col("total") / (clusters * (clusters - 1) / 2)).alias("jaccard_mean")
    )


def vocabulary_sizes(df: DataFrame, label: str, text: str) -> DataFrame:
    return vocabulary(df, label, text).groupBy(label).agg(F.count("*").alias("words"))


def posts_with_word(df: DataFrame, text: str, word: str) -> DataFrame:
    """Flag the posts that contain a word."""
    return df.withColumn("has_word", F.array_contains(tokens(text), word).cast("int"))
