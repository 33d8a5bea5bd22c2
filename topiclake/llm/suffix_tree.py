"""Language-model scores from a probabilistic suffix tree over words.

Symbols are the end of a text, every word with at least ``SYMBOL`` of all tokens, and for all other
words the class of their last letters. A state is a context of one to ``DEPTH`` symbols. States grow
level by level from the root: the contexts that extend a kept state and are frequent enough are
counted over the whole corpus, and a context is kept if its next-symbol distribution diverges from
that of its suffix, measured by what leaving each occurrence out in turn still gains. Distributions
are smoothed by absolute discounting towards the suffix's. A text is scored from the longest suffix
state at each token; a word without a symbol of its own costs its class and its share in it, which
takes its exact count.

What is broadcast is bounded by shares of all tokens, whatever the corpus: at most ``1 / SYMBOL``
symbols, ``1 / CONTEXT`` states and ``1 / ENTRY`` next-symbol entries per level, and ``1 / COMMON``
word counts. The counts themselves, and all words below ``COMMON``, stay in tables that grow with the
corpus and are joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topiclake.llm.text import LOWER, SOLID, Words, mix, slices
from topiclake.session import stage

SYMBOL = 1e-4
COMMON = 1e-6
CONTEXT = 1e-5
ENTRY = 5e-7
LEAST_CONTEXT = 20
LEAST_ENTRY = 2
DEPTH = 3
DISCOUNT = 0.75
# Decimal orders of likelihood that a state must gain.
GAIN = 2.0
CLASSES = 4096
SUFFIX = 3
# Different keys that a task holds before it adds them up.
HELD = 1 << 21


def word_classes(words: Words, chosen: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Class of each word, or of the chosen ones: a hash of its last three bytes."""
    starts, ends = words.starts[chosen], words.ends[chosen]
    key = np.zeros(len(starts), np.uint64)
    for i in range(1, SUFFIX + 1):
        at = ends - i
        key = key * np.uint64(257)
        key += np.where(at >= starts, words.data[np.maximum(at, 0)], 0).astype(np.uint64)
    return (mix(key + np.uint64(1)) >> np.uint64(52)).astype(np.int64)


class Counter:
    """Adds up counts of 64-bit keys, with one value that goes with each key."""

    def __init__(self):
        self.keys, self.counts, self.values, self.held = [], [], [], 0

    def add(self, keys: np.ndarray, values: np.ndarray | None = None) -> None:
        if values is None:
            keys, counts = np.unique(keys, return_counts=True)
            self.values.append(np.zeros(len(keys), np.int64))
        else:
            keys, first, counts = np.unique(keys, return_index=True, return_counts=True)
            self.values.append(values[first])
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)

    def full(self) -> bool:
        """Whether so many different keys are held that they must go."""
        if self.held <= HELD:
            return False
        self.total()
        return self.held > HELD // 2

    def total(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(self.keys) > 1:
            keys = np.concatenate(self.keys)
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            self.counts = [np.add.reduceat(np.concatenate(self.counts)[order], first)]
            self.values = [np.concatenate(self.values)[order][first]]
            self.keys = [keys[first]]
        self.held = len(self.keys[0]) if self.keys else 0
        empty = np.zeros(0, np.int64)
        return (self.keys + [empty])[0], (self.counts + [empty])[0], (self.values + [empty])[0]


def _emit(counter: Counter, valued: bool) -> Iterator[pa.RecordBatch]:
    keys, counts, values = counter.total()
    for i in range(0, len(keys), 1 << 17):
        part = slice(i, i + (1 << 17))
        columns = {"key": keys[part].view(np.int64), "n": counts[part]}
        yield pa.RecordBatch.from_pydict(columns | ({"value": values[part].astype(np.int32)} if valued else {}))


def _counted(
    df: DataFrame, add: Callable[[Counter, np.ndarray, np.ndarray], None], valued: bool = False
) -> DataFrame:
    """(key, n) over all texts, and ``value`` if asked for: each task adds up its own before the shuffle.

    A task that holds too many keys passes on what it has and begins anew.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for batch in batches:
            for _, data, offsets in slices(batch, "_text"):
                add(counter, data, offsets)
                if counter.full():
                    yield from _emit(counter, valued)
                    counter = Counter()
        yield from _emit(counter, valued)

    rows = df.select("_text").mapInArrow(run, "key long, n long" + (", value int" if valued else ""))
    least = [F.min("value").alias("value")] if valued else []
    return rows.groupBy("key").agg(F.sum("n").alias("n"), *least)


@dataclass
class Level:
    """States of one depth, sorted by context, and their entries, sorted by state and symbol."""

    contexts: np.ndarray
    rest: np.ndarray
    keys: np.ndarray
    shares: np.ndarray


@dataclass
class Tree:
    """Symbols, root and states, as sorted arrays."""

    words: np.ndarray  # hashes of common words, sorted
    counts: np.ndarray
    symbols: np.ndarray  # symbol of each common word, 0 if it has none of its own
    size: int
    root: np.ndarray
    outside: np.ndarray  # decimal logarithm of the mass of each class's words, unknown ones included
    total: float  # decimal logarithm of N + V + 1
    ends: int
    levels: list[Level] = field(default_factory=list)

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash among the common words, and whether it is there."""
        if not len(self.words):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        kinds, kind = np.unique(hashes, return_inverse=True)
        at = np.minimum(np.searchsorted(self.words, kinds), len(self.words) - 1)
        return at[kind], (self.words[at] == kinds)[kind]

    def symbols_of(self, words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbol, place and presence of the words with the given hashes."""
        at, known = self.look_up(hashes)
        symbols = np.zeros(len(hashes), np.int64)
        symbols[known] = self.symbols[at[known]]
        others = np.flatnonzero(symbols == 0)
        symbols[others] = 1 + word_classes(words, others)
        return symbols, at, known

    def sequence(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all texts, each closed by 0; text of each; and of the words, place and presence."""
        symbols, at, known = self.symbols_of(words, words.hashes())
        closes = words.bounds[1:]
        texts = np.insert(words.texts(), closes, np.arange(len(closes)))
        return np.insert(symbols, closes, 0), texts, at, known

    def closed(self, words: Words) -> np.ndarray:
        """The symbols of all texts, each closed by 0."""
        return np.insert(self.symbols_of(words, words.hashes())[0], words.bounds[1:], 0)

    def context(self, symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Number of the ``depth`` symbols before each; and whether they are all of one text.

        The start of a text is the end of another, so the first symbols have a context that begins
        with an end, and none beyond it.
        """
        out = np.zeros(len(symbols), np.int64)
        good = np.ones(len(symbols), bool)
        factor = 1
        before = symbols
        for i in range(depth):
            before = np.append(0, before[:-1])
            out += before * factor
            factor *= self.size
            if i < depth - 1:
                good &= before != 0
        return out, good

    def probabilities(self, symbols: np.ndarray) -> np.ndarray:
        """Smoothed probability of each symbol from its longest suffix state."""
        p = self.root[symbols]
        alive = np.ones(len(symbols), bool)
        for depth, level in enumerate(self.levels, 1):
            if not len(level.contexts):
                break
            context, good = self.context(symbols, depth)
            at = np.minimum(np.searchsorted(level.contexts, context), len(level.contexts) - 1)
            alive &= good & (level.contexts[at] == context)
            key = at * self.size + symbols
            kinds, kind = np.unique(key, return_inverse=True)
            share = np.zeros(len(kinds))
            if len(level.keys):
                place = np.minimum(np.searchsorted(level.keys, kinds), len(level.keys) - 1)
                hit = level.keys[place] == kinds
                share[hit] = level.shares[place[hit]]
            p = np.where(alive, share[kind] + level.rest[at] * p, p)
        return p


def _columns(df: DataFrame, names: list[str]) -> list[np.ndarray]:
    table = df.select(*names).toArrow()
    return [table.column(n).combine_chunks().to_numpy(zero_copy_only=False) for n in names]


def _vocabulary(texts: DataFrame, stored: DataFrame, n_texts: int) -> Tree:
    """Symbols, word counts and the root from the table of all words (key, n, value)."""
    sums = stored.agg(F.sum("n"), F.count("*")).first()
    total = (sums[0] or 0) + n_texts
    different = sums[1] + (n_texts > 0)
    hashes, counts, classes = _columns(stored.filter(F.col("n") >= COMMON * total), ["key", "n", "value"])
    order = np.argsort(hashes.view(np.uint64))
    hashes, counts, classes = hashes[order].view(np.uint64), counts[order], classes[order]
    own = counts >= max(SYMBOL * total, 3)
    symbols = np.where(own, CLASSES + np.cumsum(own), 0)
    size = CLASSES + 1 + int(own.sum())
    # Words without a symbol, by class: all of them come from the table.
    mass, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for row in stored.groupBy("value").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect():
        mass[row.value], kinds[row.value] = row.n, row.k
    np.subtract.at(mass, classes[own], counts[own])
    np.subtract.at(kinds, classes[own], 1)
    root = np.concatenate([[n_texts], mass, counts[own]]).astype(float)
    # Symbols that were not seen share what symbols seen once had.
    unseen = root == 0
    root[unseen] = min(0.5, (1 + (root == 1).sum()) / max(unseen.sum(), 1))
    return Tree(
        hashes, counts, symbols, size, root / root.sum(), np.log10(mass + kinds + 1),
        float(np.log10(total + different + 1)), n_texts,
    )


def _grow(spark, texts: DataFrame, tree: Tree, total: int, depth: int) -> Level:
    """Count, test and smooth the contexts of one depth."""
    shared = spark.sparkContext.broadcast(tree)
    size = tree.size
    # Contexts worth counting: extensions of kept states that are frequent enough themselves.
    wanted = None
    if depth > 1:
        last = tree.levels[-1]
        # How often a state is followed by a symbol is how often the longer context occurs, as
        # far as entries tell; all contexts that can be frequent enough are entries.
        wanted = spark.sparkContext.broadcast(_extensions(tree, last, depth))

    def add(counter: Counter, data: np.ndarray, offsets: np.ndarray) -> None:
        known: Tree = shared.value
        symbols = known.closed(Words(LOWER[data], offsets, SOLID))
        context, good = known.context(symbols, depth)
        if wanted is None:
            counter.add(context[good] * size + symbols[good])
            return
        listed = wanted.value
        at = np.minimum(np.searchsorted(listed, context), max(len(listed) - 1, 0))
        if len(listed):
            good &= listed[at] == context
            counter.add(at[good] * size + symbols[good])

    counted = _counted(texts, add).select(
        F.floor(F.col("key") / F.lit(size)).cast("long").alias("context"),
        F.pmod("key", F.lit(size)).cast("long").alias("symbol"), "n",
    )
    counted = stage(counted, "successors")
    least = max(LEAST_CONTEXT, CONTEXT * total)
    contexts = (
        counted.groupBy("context")
        .agg(F.sum("n").alias("all"), F.count("*").alias("kinds"))
        .filter(F.col("all") >= least)
    )
    # At most 1 / CONTEXT rows: the successors stay where they are.
    rows = counted.join(F.broadcast(contexts), "context")

    def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What each successor gains over the suffix's distribution, left out once."""
        known: Tree = shared.value
        for batch in batches:
            context, symbol, n, whole, kinds = (
                batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)
            )
            path = wanted.value[context] if wanted is not None else context
            p = _parent(known, path, symbol, depth)
            left, rest = n - 1, np.maximum(whole - 1, 1)
            other = kinds - (n == 1)
            q = (np.maximum(left - DISCOUNT, 0) + DISCOUNT * other * p) / rest
            yield pa.RecordBatch.from_pydict(
                {
                    "context": context, "symbol": symbol, "n": n, "all": whole,
                    "gain": n * np.log10(np.maximum(q, 1e-300) / p),
                }
            )

    schema = "context long, symbol long, n long, all long, gain double"
    tested = rows.select("context", "symbol", "n", "all", "kinds").mapInArrow(gains, schema)
    kept = (
        tested.groupBy("context").agg(F.sum("gain").alias("gain"), F.first("all").alias("all"))
        .filter(F.col("gain") > GAIN)
    )
    kept = stage(kept, "states")
    floor = max(LEAST_ENTRY, ENTRY * total)
    entries = counted.filter(F.col("n") >= floor).join(F.broadcast(kept), "context")
    context, symbol, n, whole = _columns(entries, ["context", "symbol", "n", "all"])
    states = np.sort(_columns(kept, ["context"])[0])
    paths = wanted.value[states] if wanted is not None else states
    order = np.lexsort((symbol, context))
    context, symbol, n, whole = context[order], symbol[order], n[order], whole[order]
    at = np.searchsorted(states, context)
    shares = (n - DISCOUNT) / whole
    rest = 1 - np.bincount(at, weights=shares, minlength=len(states))
    # Paths of candidates are sorted, so states in their order are sorted by path too.
    return Level(paths, rest, at * size + symbol, shares)


def _extensions(tree: Tree, last: Level, depth: int) -> np.ndarray:
    """Contexts of ``depth`` symbols whose first ``depth - 1`` and last ``depth - 1`` are states."""
    owner, symbol = last.keys // tree.size, last.keys % tree.size
    # An older context followed by a symbol: drop nothing, append the symbol at the near end.
    path = last.contexts[owner] * tree.size + symbol
    suffix = path % tree.size ** (depth - 1)
    at = np.minimum(np.searchsorted(last.contexts, suffix), max(len(last.contexts) - 1, 0))
    return np.unique(path[(last.contexts[at] == suffix) & (symbol > 0)]) if len(path) else path


def _parent(tree: Tree, path: np.ndarray, symbol: np.ndarray, depth: int) -> np.ndarray:
    """Probability of each symbol at the suffix of each context."""
    p = tree.root[symbol]
    for i, level in enumerate(tree.levels[: depth - 1], 1):
        suffix = path % tree.size**i
        at = np.searchsorted(level.contexts, suffix)
        key = at * tree.size + symbol
        place = np.minimum(np.searchsorted(level.keys, key), max(len(level.keys) - 1, 0))
        share = np.where(level.keys[place] == key, level.shares[place], 0) if len(level.keys) else 0
        p = share + level.rest[at] * p
    return p


@dataclass
class Model:
    tree: Tree
    words: DataFrame  # (key, n, value) of all training words
    total: int


def train(docs: DataFrame, text: str, learn: str, depth: int = DEPTH) -> Model:
    """Learn from the rows whose boolean column ``learn`` is true; null texts are empty."""
    spark = docs.sparkSession
    texts = docs.filter(F.col(learn)).select(F.coalesce(F.col(text), F.lit("")).alias("_text"))
    n_texts = texts.count()

    def add(counter: Counter, data: np.ndarray, offsets: np.ndarray) -> None:
        words = Words(LOWER[data], offsets, SOLID)
        counter.add(words.hashes(), word_classes(words))

    words = stage(_counted(texts, add, valued=True), "words")
    tree = _vocabulary(texts, words, n_texts)
    total = int(words.agg(F.sum("n")).first()[0] or 0) + n_texts
    for level in range(1, depth + 1):
        grown = _grow(spark, texts, tree, total, level)
        tree.levels.append(grown)
        if not len(grown.contexts):
            break
    return Model(tree, words, total)


def score(docs: DataFrame, keep: list[str], text: str, model: Model) -> DataFrame:
    """``keep``, n_tokens, n_known, train_tokens, base_score and score of each text.

    Tokens are the words and one end. ``base_score`` adds up log10((c + 1) / (N + V + 1)) of all
    tokens, ``score`` is the tree's log10 probability. One row out per row in; null and empty texts
    are an end alone. Counts of common words come with the model, those of other words by a join on
    the word, of which no single one has more than the share ``COMMON`` of all tokens.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model.tree)
    picked = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    names = ["n_tokens", "_known", "_base", "_score", "_words", "_times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: Tree = shared.value
        for batch in batches:
            for rows, data, offsets in slices(batch, "_text"):
                n = rows.num_rows
                words = Words(LOWER[data], offsets, SOLID)
                symbols, texts, at, known = tree.sequence(words)
                owner = words.texts()
                logs = np.log10(tree.probabilities(symbols))
                scores = np.bincount(texts, weights=logs, minlength=n)
                counted = np.zeros(len(owner))
                if len(tree.counts):
                    counted[known] = np.log10(tree.counts[at[known]] + 1)
                kinds = symbols[symbols > 0]
                within = np.where(kinds <= CLASSES, counted - tree.outside[np.minimum(kinds, CLASSES) - 1], 0)
                scores = scores + np.bincount(owner, weights=within, minlength=n)
                base = np.bincount(owner, weights=counted - tree.total, minlength=n)
                base = base + (np.log10(tree.ends + 1) - tree.total)
                # Other words, once per text, for the join.
                hashes = words.hashes()[~known]
                whose = owner[~known]
                order = np.lexsort((hashes, whose))
                hashes, whose = hashes[order], whose[order]
                new = np.flatnonzero(
                    np.append(True, (hashes[1:] != hashes[:-1]) | (whose[1:] != whose[:-1]))[: len(hashes)]
                )
                times = np.diff(np.append(new, len(hashes)))
                bounds = pa.array(np.searchsorted(whose[new], np.arange(n + 1)).astype(np.int32))
                found = [
                    pa.array(words.counts + 1), pa.array(np.bincount(owner[known], minlength=n)),
                    pa.array(base), pa.array(scores),
                    pa.ListArray.from_arrays(bounds, pa.array(hashes[new].view(np.int64))),
                    pa.ListArray.from_arrays(bounds, pa.array(times.astype(np.int32))),
                ]
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(i) for i in range(len(keep))), *found], [*keep, *names]
                )

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema if f.name != "_text"]
    schema += ["n_tokens long, _known long, _base double, _score double, _words array<long>, _times array<int>"]
    first = picked.mapInArrow(run, ", ".join(schema)).withColumn("_row", F.monotonically_increasing_id())
    first = stage(first, "scored")
    asked = first.select("_row", F.explode(F.arrays_zip("_words", "_times")).alias("w")).select(
        "_row", F.col("w._words").alias("key"), F.col("w._times").alias("times")
    )
    rare = model.words.filter(F.col("n") < F.lit(COMMON * model.total)).select("key", "n")
    more = (
        asked.join(rare, "key")
        .groupBy("_row")
        .agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("_logs"), F.sum("times").alias("_found"))
    )
    logs = F.coalesce("_logs", F.lit(0.0))
    return first.drop("_words", "_times").join(more, "_row", "left").select(
        *keep,
        "n_tokens",
        (F.col("_known") + 1 * F.lit(int(model.tree.ends > 0)) + F.coalesce("_found", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("_base") + logs).alias("base_score"),
        (F.col("_score") + logs).alias("score"),
    )
