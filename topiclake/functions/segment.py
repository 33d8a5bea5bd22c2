"""Splitting of run-together words with a vocabulary learnt from the corpus."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topiclake.operators.keys import assign_keys
from topiclake.operators.words import word_counts
from topiclake.session import SMALL_ROWS, stage

# Letters of the first prefix table of the trie.
PREFIX = 4
# Starts of a word that are cut from the same copy of its text.
CHUNK = 512
# Bits of a bitmap for each word it lists; bits in a row of Spark's bitmaps, and rows of 4 kB at most.
LISTED_BITS, PIECE_BITS, MAX_PIECES = 16, 32_768, 4096


def learn_vocabulary(df: DataFrame, text: str, min_count: int = 2) -> DataFrame:
    """(word, n): the words of the corpus that occur ``min_count`` times or more."""
    return frequent(word_counts(df, text), min_count)


def frequent(counts: DataFrame, min_count: int = 2) -> DataFrame:
    """The vocabulary of a table of word counts."""
    return counts.filter((F.col("n") >= min_count) & (F.col("word") != "")).select("word", "n")


def word_costs(vocabulary: DataFrame) -> DataFrame:
    """(word, cost): log(rank · log N) of each word, ranked by frequency and then by name."""
    ranked = assign_keys(vocabulary.select("word", "n"), "rank", 1, [F.desc("n"), F.col("word")])
    ranked = stage(ranked, "ranks")
    scale = math.log(max(ranked.count(), 3))
    return ranked.select("word", F.log(F.col("rank") * F.lit(scale)).alias("cost"))


def split_word(word: str, parts: dict[int, list[tuple[int, float]]]) -> str:
    """Cheapest division of a word into known parts; the word itself if there is none.

    ``parts`` has, by the place where a known word ends, where it starts and what it costs.
    """
    best = [0.0] + [math.inf] * len(word)
    cut = [0] * (len(word) + 1)
    for end in range(1, len(word) + 1):
        for start, cost in sorted(parts.get(end, ())):
            if best[start] + cost < best[end]:
                best[end], cut[end] = best[start] + cost, start
    if best[-1] == math.inf:
        return word
    found, end = [], len(word)
    while end:
        found.append(word[cut[end]:end])
        end = cut[end]
    return " ".join(reversed(found))


def cheapest_cuts(
    lengths: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray, cost: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``split_word`` for all words of a batch: for each place of each word what its division costs and where
    the last part starts, and the place of each word's start in these lists.

    A piece is a known part of the word ``row`` from ``start`` to ``end``. Ends are taken in ascending order, all
    words at a time; of equal costs the part that starts first counts.
    """
    base = np.append(0, np.cumsum(lengths + 1))[:-1]
    best = np.full(int((lengths + 1).sum()), np.inf)
    cut = np.zeros(len(best), np.int64)
    best[base] = 0.0
    order = np.lexsort((start, row, end))
    row, start, end, cost = row[order], start[order], end[order], cost[order]
    steps = np.append(np.flatnonzero(np.append(True, end[1:] != end[:-1])), len(end)) if len(end) else []
    for low, high in zip(steps[:-1], steps[1:]):
        of, begin = row[low:high], start[low:high]
        sums = best[base[of] + begin] + cost[low:high]
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        least = np.minimum.reduceat(sums, first)
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(of))))
        at = np.flatnonzero(sums == least[group])
        at = at[np.append(True, group[at][1:] != group[at][:-1])]
        place = base[of[first]] + end[low]
        best[place] = least
        cut[place] = np.where(least < np.inf, begin[at], 0)
    return best, cut, base


def divided_words(
    words: pa.Array, row: np.ndarray, start: np.ndarray, size: np.ndarray, cost: np.ndarray
) -> pa.Array:
    """Cheapest division of each word into known parts; the word itself if there is none.

    The pieces are parts of the words ``row``."""
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    best, cut, base = cheapest_cuts(lengths, row, start, start + size, cost)
    out = words.to_pylist()
    whole = base + lengths
    for i in np.flatnonzero((best[whole] < np.inf) & (cut[whole] > 0)).tolist():
        word, end, found = out[i], int(lengths[i]), []
        while end:
            begin = int(cut[base[i] + end])
            found.append(word[begin:end])
            end = begin
        out[i] = " ".join(reversed(found))
    return pa.array(out, pa.string())


def _divided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, divided) of the words that change, from rows in order of ids: those of words, those of pieces.

    A batch may end within the pieces of a word; its rows wait for the next one.
    """
    held: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):
        if batch is not None:
            held.append(batch)
            ids = [held[0].column(0)[0], batch.column(0)[-1]] if batch.num_rows and held[0].num_rows else [0, 0]
            if ids[0] == ids[1]:
                held = [x for x in held if x.num_rows]
                continue
        if not held:
            return
        rows = pa.Table.from_batches(held)
        ids = rows.column("id").to_numpy()
        ready = len(ids) if batch is None else int(np.searchsorted(ids, ids[-1]))
        held = rows.slice(ready).to_batches()
        rows, ids = rows.slice(0, ready), ids[:ready]
        named = rows.column("word").is_valid().to_numpy()
        words = rows.column("word").drop_null().combine_chunks()
        start, size, cost = (
            rows.column(c).drop_null().to_numpy().astype(t) for c, t in (("start", int), ("size", int), ("cost", float))
        )
        new = divided_words(words, np.searchsorted(ids[named], ids[~named]), start, size, cost)
        changed = pc.not_equal(new, words)
        yield pa.RecordBatch.from_arrays([words.filter(changed), new.filter(changed)], ["word", "divided"])


def _trie_level(costs: DataFrame, size: int) -> DataFrame:
    """(prefix, sizes, deeper): prefixes of ``size`` letters of longer known words.

    ``sizes`` are the different lengths of those words up to twice ``size``; ``deeper`` tells whether
    there are still longer ones.
    """
    n = F.length("word")
    return costs.filter(n > size).groupBy(F.left("word", F.lit(size)).alias("prefix")).agg(
        F.collect_set(F.when(n <= 2 * size, n)).alias("sizes"), F.max(n > 2 * size).alias("deeper")
    )


def known_pieces(words: DataFrame, costs: DataFrame) -> DataFrame:
    """(id, start, size, cost): every known word inside the rows (id, word); starts count from 1.

    The known words are a trie, kept as tables of their prefixes of 4, 8, 16, … letters. A start goes
    to the next table only if a known word begins like its text and is longer than that table's
    lengths, and only lengths that such words have become pieces. Rows therefore grow with the letters
    of a word and with what is known of it, not with its substrings.
    """
    length = F.length("word")
    longest, few = costs.agg(F.max(length), F.collect_set(F.when(length <= PREFIX, length))).first()
    longest = longest or 0
    n, base, local = length, F.col("base"), F.col("local")
    # Letters are counted from the start of a chunk, not of a word of any length.
    chunks = words.filter(n > 0).select(
        "id", "word", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1, F.lit(CHUNK))).alias("base")
    ).select("id", "n", "base", F.substring("word", base + 1, F.lit(CHUNK + 2 * PREFIX)).alias("chunk"))
    at = chunks.select(
        "*", F.explode(F.sequence(F.lit(1), F.least(F.lit(CHUNK), F.col("n") - base))).alias("local")
    ).select(
        "id", (base + local).alias("start"), (F.col("n") - base - local + 1).alias("room"),
        F.substring("chunk", local, F.lit(2 * PREFIX)).alias("text"),
    )
    short = F.array(*(F.lit(size) for size in sorted(few))).cast("array<int>")
    pieces = at.select(
        "id", "start", "text", F.explode(F.filter(short, lambda size: size <= F.col("room"))).alias("size")
    )
    depth = PREFIX
    while depth < longest:
        begun = at.filter(F.col("room") > depth).withColumn("prefix", F.left("text", F.lit(depth)))
        at = stage(begun.join(_trie_level(costs, depth), "prefix").drop("prefix"), "walk")
        whole = at.select("id", "start", "room", "text", F.explode("sizes").alias("size"))
        pieces = pieces.unionByName(whole.filter("size <= room").drop("room"))
        at = at.filter(F.col("deeper") & (F.col("room") > 2 * depth)).select("id", "start", "room")
        depth *= 2
        if at.isEmpty():
            break
        at = at.join(words, "id").select(
            "id", "start", "room", F.substring("word", F.col("start"), F.lit(2 * depth)).alias("text")
        )
    named = pieces.select("id", "start", "size", F.left("text", F.col("size")).alias("word"))
    return named.join(costs, "word").select("id", "start", "size", "cost")


def divisions(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, divided) of the different words that a division changes.

    The vocabulary may be of any size; a word and its known pieces meet in one task, as rows in order.
    """
    costs = stage(word_costs(vocabulary), "costs")
    numbered = stage(assign_keys(words.select("word"), "id"), "words")
    pieces = known_pieces(numbered, costs).select("id", F.lit(None).cast("string").alias("word"), F.col("start") - 1, "size", "cost")
    none = [F.lit(None).cast(t) for t in ("int", "int", "double")]
    pieces = pieces.toDF("id", "word", "start", "size", "cost").unionByName(
        numbered.select("id", "word", *none).toDF("id", "word", "start", "size", "cost")
    )
    return pieces.repartition("id").sortWithinPartitions("id").mapInArrow(_divided, "word string, divided string")


def _perhaps_listed(tokens: DataFrame, listed: DataFrame, count: int) -> DataFrame:
    """The rows of ``tokens`` whose word may be among the ``count`` words ``listed``, and few others.

    A word sets one bit of a bitmap of ``LISTED_BITS`` bits for each, at most 16 MB, which is broadcast.
    """
    pieces = min(max(math.ceil(LISTED_BITS * count / PIECE_BITS), 1), MAX_PIECES)
    spot = F.pmod(F.xxhash64("word"), F.lit(pieces * PIECE_BITS))
    piece, place = F.floor(spot / PIECE_BITS).alias("_piece"), F.pmod(spot, F.lit(PIECE_BITS))
    bits = listed.groupBy(piece).agg(F.bitmap_construct_agg(place).alias("_bits"))
    found = tokens.withColumn("_piece", piece).join(F.broadcast(stage(bits, "bits")), "_piece")  # MAX_PIECES rows at most
    byte = F.conv(F.hex(F.substring("_bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return found.filter(F.getbit(byte, (place % 8).cast("int")) == 1).select(*tokens.columns)


def segment_words(
    df: DataFrame, text: str, vocabulary: DataFrame, words: DataFrame | None = None
) -> DataFrame:
    """Replace every word of ``text`` by its division.

    Each different word of the table is divided once; ``words`` has them if they are known already. Of the texts, only the words that change, and few others, are
    shuffled; where a count finds their list small, it is broadcast.
    """
    rows = stage(df.withColumn("_row", F.monotonically_increasing_id()), "texts")
    tokens = rows.select("_row", F.posexplode(F.split(text, " ")).alias("at", "word"))
    if words is None:
        words = tokens.select("word").distinct()
    words = words.select("word").filter("word <> ''")
    changed = stage(divisions(words, vocabulary), "divisions")
    count = changed.count()
    if count <= SMALL_ROWS:
        changed = F.broadcast(changed)
    else:
        tokens = _perhaps_listed(tokens, changed, count)
    places = (
        tokens.join(changed, "word")
        .groupBy("_row")
        .agg(F.map_from_entries(F.collect_list(F.struct("at", "divided"))).alias("_new"))
    )
    joined = rows.join(places, "_row", "left")
    replaced = F.array_join(
        F.transform(
            F.split(text, " "), lambda w, i: F.coalesce(F.try_element_at("_new", i), w)
        ),
        " ",
    )
    kept = F.when(F.col("_new").isNull(), F.col(text)).otherwise(replaced)
    return joined.withColumn(text, kept).select(*df.columns)
