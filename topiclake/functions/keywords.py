"""Keyword extraction by the statistics of a single text (Campos et al., YAKE!, 2020).

Posts reach this step lower-cased, without punctuation and as one sentence, so the casing, sentence
position and sentence spread features are constants. All statistics belong to one post: its text is
shuffled once, by post, and every later step (term, neighbour, phrase) is numpy on the tokens of a slice of
posts, in time T log T of them. No row per token leaves a task's slice.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topiclake.functions.words import MIN_LENGTH

# Position feature of a text of one sentence.
POSITION = math.log(math.log(3.0))
# Bytes of text whose tokens are looked at together; a longer row is a slice of its own.
SLICE_BYTES = 2 << 20
# Digits of scores that are compared, so that equal scores reached by other products stay equal.
DIGITS = 12


@dataclass
class Terms:
    """The terms of the rows of a slice, by row and then by name; the long ones have a score.

    ``row``, ``term`` (a place in ``names``), ``tf`` and ``score`` belong to a term. Its tokens are those of
    ``tokens`` from ``ends[i]`` to ``ends[i + 1]``; ``of`` and ``pos`` belong to a token: its term and its place
    in its text.
    """

    names: pa.Array
    row: np.ndarray
    term: np.ndarray
    tf: np.ndarray
    long: np.ndarray
    score: np.ndarray
    tokens: np.ndarray
    ends: np.ndarray
    of: np.ndarray
    pos: np.ndarray


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, … within each of the groups of the given sizes."""
    starts = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) - np.repeat(starts, sizes)


def _ids(values: np.ndarray) -> np.ndarray:
    return np.asarray(values, np.int64)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows (key, texts) of a batch, cut by the bytes of their texts."""
    texts = batch.column(1)
    ends = _ids(pc.fill_null(pc.binary_length(texts.flatten()), 0).to_numpy(zero_copy_only=False)).cumsum()
    sizes = _ids(texts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).cumsum()
    read = np.append(0, ends)[sizes]
    start = 0
    while start < batch.num_rows:
        before = read[start - 1] if start else 0
        end = max(int(np.searchsorted(read, before + SLICE_BYTES, "right")), start + 1)
        yield batch.slice(start, end - start)
        start = end


def _scored(texts: pa.ListArray, window: int) -> Terms:
    """The terms of the texts of each row; those of an equal row count together."""
    per_row = _ids(texts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    split = pc.split_pattern(texts.flatten().cast(pa.large_string()), " ")
    words, per_text = split.flatten(), _ids(split.value_lengths().to_numpy(zero_copy_only=False))
    held = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(per_text)), per_text)[held]
    coded = words.filter(pa.array(held)).dictionary_encode()
    by_name = pc.sort_indices(coded.dictionary)
    names, place = coded.dictionary.take(by_name), np.empty(len(by_name), np.int64)
    place[by_name.to_numpy()] = np.arange(len(by_name))
    code = place[_ids(coded.indices.to_numpy(zero_copy_only=False))]
    row = np.repeat(np.arange(len(per_row)), per_row)[text]
    pos = _within(np.bincount(text, minlength=len(per_text)))

    width = max(len(names), 1)
    order = np.argsort(row * width + code, kind="stable")
    if (per_row > 1).any():
        order = order[np.lexsort((pos[order], (row * width + code)[order]))]
    sorted_row, sorted_code = row[order], code[order]
    new = np.append(True, (sorted_row[1:] != sorted_row[:-1]) | (sorted_code[1:] != sorted_code[:-1]))[: len(order)]
    first = np.flatnonzero(new)
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    ends = np.append(first, len(order))
    row_of, term, tf = sorted_row[first], sorted_code[first], np.diff(ends)
    long = pc.utf8_length(names).to_numpy(zero_copy_only=False)[term] >= MIN_LENGTH

    # Sums of counts stay whole numbers, so their order does not matter.
    rows = len(per_row)
    n, total, squares = (
        _ids(np.bincount(row_of[long], x[long], rows)) for x in (np.ones_like(tf), tf, tf * tf)
    )
    most = np.zeros(rows, np.int64)
    np.maximum.at(most, row_of, tf)
    with np.errstate(divide="ignore", invalid="ignore"):
        usual = (total + np.sqrt((n * squares - total * total).astype(float))) / n
    related = np.zeros(len(tf))
    for sign in (-1, 1):
        met = []
        for step in range(1, window + 1):
            a, b = (slice(step, None), slice(None, -step)) if sign < 0 else (slice(None, -step), slice(step, None))
            same = text[a] == text[b]
            met.append(of[a][same] * width + code[b][same])
        near = np.concatenate(met) if met else np.zeros(0, np.int64)
        near.sort()
        term_of = near // width
        new = np.append(True, near[1:] != near[:-1])[: len(near)]
        every, different = (np.bincount(x, minlength=len(tf)) for x in (term_of, term_of[new]))
        share = np.where(every > 0, different / np.maximum(every, 1), 0.0)
        related = related + (0.5 + share * (tf / most[row_of]))
    with np.errstate(divide="ignore", invalid="ignore"):
        score = POSITION * related / (tf / usual[row_of] / related + 1.0 / related)
    return Terms(names, row_of, term, tf, long, score, order, ends, of, pos)


@dataclass
class Phrases:
    """Phrases of ``size`` neighbouring terms each: their row, score and first place, and the terms' places in
    the names."""

    row: np.ndarray
    score: np.ndarray
    first: np.ndarray
    terms: np.ndarray

    def keywords(self, names: pa.Array) -> pa.Array:
        parts = [names.take(pa.array(self.terms[:, i])) for i in range(self.terms.shape[1])]
        return pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if len(parts) > 1 else parts[0]


def _phrases(found: Terms, n: int) -> Iterator[Phrases]:
    """The different phrases of 1, 2, … n neighbouring terms; a short word breaks them."""
    at = np.flatnonzero(found.long[found.of])
    at = at[np.lexsort((found.term[found.of[at]], found.pos[at], found.row[found.of[at]]))]
    of, pos = found.of[at], found.pos[at]
    row, score, width = found.row[of], found.score[of], max(len(found.row), 1)
    # The phrase that starts at each place, as a number of its size; and the sums over its terms.
    name, product, total = np.zeros(len(at), np.int64), np.ones(len(at)), np.zeros(len(at))
    begun = np.arange(len(at))
    for size in range(1, n + 1):
        begun = np.arange(max(len(at) - size + 1, 0))
        last = begun + size - 1
        name, product, total = name[: len(begun)], product[: len(begun)], total[: len(begun)]
        product, total = product * score[last], total + score[last]
        _, name = np.unique(name * width + of[last], return_inverse=True)
        whole = np.flatnonzero((row[last] == row[begun]) & (pos[last] == pos[begun] + (size - 1)))
        _, first, count = np.unique(name[whole], return_index=True, return_counts=True)
        first = whole[first]
        yield Phrases(
            row[first], product[first] / ((total[first] + 1.0) * count), pos[first],
            found.term[of[first[:, None] + np.arange(size)]],
        )


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, texts): one row per key, the only shuffle; texts of an equal key count together."""
    return df.select(key, text).repartition(key).groupBy(key).agg(F.collect_list(text).alias("texts"))


def _by_slice(
    df: DataFrame, key: str, text: str, schema: str, work: Callable[[pa.ListArray], Iterator[tuple]]
) -> DataFrame:
    """Rows (key, schema): ``work`` gives for the texts of a slice the number of a row, and columns."""
    rows = _texts(df, key, text)
    columns = [key, *(f.split()[0] for f in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                for row, *values in work(part.column(1)):
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), *values], columns)

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, {schema}")


def term_scores(df: DataFrame, key: str, text: str, window: int = 2) -> DataFrame:
    """(key, term, tf, score, positions) of every term of every text; low scores matter most."""
    def work(texts: pa.ListArray) -> Iterator[tuple]:
        found = _scored(texts, window)
        sizes = np.append(0, np.cumsum(found.tf[found.long])).astype(np.int32)
        tokens = found.tokens[np.repeat(found.long, found.tf)]
        yield (
            found.row[found.long], found.names.take(pa.array(found.term[found.long])).cast(pa.string()),
            pa.array(found.tf[found.long], pa.int32()), pa.array(found.score[found.long]),
            pa.ListArray.from_arrays(pa.array(sizes), pa.array(found.pos[tokens], pa.int32())),
        )

    return _by_slice(df, key, text, "term string, tf int, score double, positions array<int>", work)


def keyword_candidates(
    df: DataFrame, key: str, text: str, n: int = 3, window: int = 2
) -> DataFrame:
    """(key, keyword, score, first): phrases of up to n neighbouring terms with their scores."""
    def work(texts: pa.ListArray) -> Iterator[tuple]:
        found = _scored(texts, window)
        for p in _phrases(found, n):
            yield (
                p.row, p.keywords(found.names).cast(pa.string()), pa.array(p.score),
                pa.array(p.first, pa.int32()),
            )

    return _by_slice(df, key, text, "keyword string, score double, first int", work)


def _rounded(score: np.ndarray) -> np.ndarray:
    """Scores in units of the last digit that counts, halves up; those near a half by their decimal digits."""
    scaled = score * 10.0**DIGITS
    out = np.floor(scaled + 0.5)
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3).tolist():
        out[i] = float(Decimal(repr(float(score[i]))).scaleb(DIGITS).quantize(Decimal(1), ROUND_HALF_UP))
    return out


def _most_edits(longest: int, dedup: float) -> int:
    """Edits that leave a keyword of that length more similar than ``dedup``, −1 if not even none do."""
    d = int((1 - dedup) * longest) + 1
    while d >= 0 and not 1 - d / longest > dedup:
        d -= 1
    return d


def within_edits(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most ``most``; only the diagonals that near are looked at."""
    if a == b:
        return most >= 0
    if most < 1 or abs(len(a) - len(b)) > most:
        return False
    far = most + 1
    row = [*range(min(far, len(b) + 1)), *[far] * (len(b) + 1 - far)]
    for i, x in enumerate(a, 1):
        low, high = max(i - most, 1), min(i + most, len(b))
        last = row[low - 1]
        left = row[low - 1] = i if low == 1 else far
        least = left
        for j in range(low, high + 1):
            above = row[j]
            if x == b[j - 1]:
                left = last
            else:
                left = 1 + (last if last < left and last < above else left if left < above else above)
            last, row[j] = above, left
            if left < least:
                least = left
        if least > most:
            return False
    return row[-1] <= most


def _taken(keywords: Iterator[str], top: int, dedup: float, edits: dict[int, int]) -> list[str]:
    """Keywords in their order, unless too similar to one already taken.

    An edit brings in or removes one letter at most, so keywords of many other letters are not compared.
    """
    out: list[tuple[str, set]] = []
    for word in keywords:
        if len(out) >= top:
            break
        size, letters = len(word), set(word)
        for other, others in out:
            longest = size if size > len(other) else len(other)
            if longest not in edits:
                edits[longest] = _most_edits(longest, dedup)
            most = edits[longest]
            if most < 1 or len(letters - others) > most or len(others - letters) > most:
                continue
            if within_edits(other, word, most):
                break
        else:
            out.append((word, letters))
    return [word for word, _ in out]


def extract_keywords(
    df: DataFrame, key: str, text: str, n: int = 3, window: int = 2, top: int = 15,
    dedup: float = 0.85, max_score: float = 0.05,
) -> DataFrame:
    """(key, yaked): the different words of a text's best keywords, in order of the keywords.

    Keywords are taken in ascending order of score, unless too similar to one already taken, up to
    ``top``; only scores below ``max_score`` count, so others are dropped before the selection,
    which cannot change what comes before them.
    """
    def work(texts: pa.ListArray) -> Iterator[tuple]:
        found = _scored(texts, window)
        row, score, first, size, terms = [], [], [], [], []
        for p in _phrases(found, n):
            good = np.flatnonzero(p.score < max_score)
            row.append(p.row[good])
            score.append(p.score[good])
            first.append(p.first[good])
            size.append(np.full(len(good), p.terms.shape[1]))
            terms.append(np.pad(p.terms[good], ((0, 0), (0, n - p.terms.shape[1]))))
        row, score, first, size = (np.concatenate(x) for x in (row, score, first, size))
        score, terms = _rounded(score), np.concatenate(terms)
        # Keywords of equal score and place come in order of their letters, which is that of their bytes.
        order = np.lexsort((first, score, row))
        same = np.flatnonzero(np.all([x[order][1:] == x[order][:-1] for x in (row, score, first)], axis=0))
        names = found.names.to_pylist()

        def keyword(i: int) -> str:
            return " ".join([names[t] for t in terms[i, : size[i]].tolist()])

        for run in np.split(same, np.flatnonzero(np.diff(same) > 1) + 1) if len(same) else []:
            tied = slice(run[0], run[-1] + 2)
            order[tied] = sorted(order[tied].tolist(), key=lambda i: keyword(i).encode())
        edits: dict[int, int] = {}
        out, rows = [], np.unique(row)
        bounds = np.append(np.searchsorted(row[order], rows), len(order)).tolist()
        for low, high in zip(bounds[:-1], bounds[1:]):
            best = _taken((keyword(i) for i in order[low:high]), top, dedup, edits)
            out.append(" ".join(dict.fromkeys(" ".join(best).split(" "))))
        yield rows, pa.array(out, pa.string())

    return _by_slice(df, key, text, "yaked string", work)
