"""Benchmark decontamination by winnowed fingerprints.

Documents and benchmark items keep fingerprints of the same kind; a join on them yields every pair
of a document and an item that can share a window, and few others. Hits are then extended word by
word on the texts of those pairs alone. Fingerprints of a span of s words guarantee all shared spans
of s words or more, so the result is exact.

Items shorter than a window are one window each. They take fingerprints of shorter spans: lengths
fall into a few classes, and documents keep fingerprints only for classes that the items have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topiclake.llm.columns import shield
from topiclake.llm.text import ALNUM, LOWER, Words, buffers, gram_hashes, large, mix, slices
from topiclake.llm.winnow import split_span, winnow
from topiclake.session import stage


def span_classes(window: int) -> list[int]:
    """Guaranteed spans, longest first: the window, then about halves of it down to one word."""
    spans = [window]
    while spans[-1] > 1:
        spans.append((spans[-1] + 1) // 2)
    return spans


def span_of(n_words: int, window: int) -> int:
    """Class of an item with so many words: the longest span that it holds."""
    return next(s for s in span_classes(window) if s <= n_words)


def _fingerprints(
    words: Words, spans: list[int], own: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(text, fingerprint) for the given classes; the class is part of the hash.

    With ``own`` (a class per text), texts only keep fingerprints of their own class.
    """
    hashes = words.hashes()
    texts = words.texts()
    owners, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for span in spans:
        at, prints = winnow(words, hashes, *split_span(span))
        owner, prints = texts[at], mix(prints + np.uint64(span))
        if own is not None:
            owner, prints = owner[own[owner] == span], prints[own[owner] == span]
        owners.append(owner)
        found.append(prints)
    owners, found = np.concatenate(owners), np.concatenate(found)
    order = np.argsort(owners, kind="stable")
    return owners[order], found[order].view(np.int64)


def _lists(owners: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    bounds = np.searchsorted(owners, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values))


def _printed(df: DataFrame, keep: list[str], text: str, spans: list[int], window: int = 0) -> DataFrame:
    """``keep``, ``n_words`` and ``prints`` of each text; with ``window`` those of items."""
    picked = df.select(*keep, df[text].alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "_text"):
                words = Words(LOWER[data], offsets, ALNUM)
                counts = words.counts
                own = None
                if window:
                    own = np.array([span_of(n, window) if n else 0 for n in counts.tolist()])
                owners, prints = _fingerprints(words, spans, own)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(rows.column(i) for i in range(len(keep))),
                        pa.array(counts.astype(np.int64)),
                        _lists(owners, prints, rows.num_rows),
                    ],
                    [*keep, "n_words", "prints"],
                )

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema if f.name != "_text"]
    return picked.mapInArrow(run, ", ".join([*schema, "n_words long", "prints array<long>"]))


def _word_hashes(text: str) -> np.ndarray:
    data, offsets = buffers(large(pa.array([text])))
    return Words(LOWER[data], offsets, ALNUM).hashes()


def hit_words(document: np.ndarray, item: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Ranges of document words inside occurrences of the item's windows.

    Both are word hashes. A fingerprint's k-gram is an anchor; each anchor is extended in both
    directions while the words agree, and counts if it reaches a whole window. Anchors inside a
    stretch that was extended on the same diagonal are passed over.
    """
    n = min(window, len(item))
    if not n:
        return []
    k = split_span(span_of(n, window))[0]
    places: dict[int, list[int]] = {}
    for q, gram in enumerate(gram_hashes(item, k).tolist()):
        places.setdefault(gram, []).append(q)
    grams = gram_hashes(document, k)
    anchors = np.flatnonzero(np.isin(grams, np.fromiter(places, np.uint64, len(places))))
    left, right = document.tolist(), item.tolist()
    reached: dict[int, int] = {}
    out = []
    for p in anchors.tolist():
        for q in places[int(grams[p])]:
            if reached.get(p - q, -1) > p:
                continue
            a, b = p, p + k
            while a > 0 and a - p + q > 0 and left[a - 1] == right[a - 1 - p + q]:
                a -= 1
            while b < len(left) and b - p + q < len(right) and left[b] == right[b - p + q]:
                b += 1
            reached[p - q] = b
            if b - a >= n:
                out.append((a, b))
    return out


def _extend(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"_key": [], "spans": [], "items": []}
            for key, text, items in zip(*(batch.column(i).to_pylist() for i in range(3))):
                document = _word_hashes(text)
                flags = np.zeros(len(document) + 1, np.int64)
                found = set()
                for item in items:
                    for a, b in hit_words(document, _word_hashes(item["text"]), window):
                        flags[a] += 1
                        flags[b] -= 1
                        found.add(item["id"])
                if found:
                    inside = np.append(np.cumsum(flags) > 0, False)
                    edges = np.flatnonzero(np.diff(np.append(False, inside).astype(np.int8)))
                    out["_key"].append(key)
                    out["spans"].append(edges.reshape(-1, 2).tolist())
                    out["items"].append(sorted(found))
            yield pa.RecordBatch.from_pydict(
                out,
                schema=pa.schema(
                    {"_key": pa.binary(), "spans": pa.list_(pa.list_(pa.int64())), "items": pa.list_(pa.string())}
                ),
            )

    return run


def find_contamination(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text", window: int = 13, share: int = 20,
) -> DataFrame:
    """Per document: key, ``n_words``, ``n_hit``, ``spans`` of hit words, ``items``, ``contaminated``
    and ``text_key``, the MD5 of the text.

    A document is contaminated if at least one word in ``share`` is hit. One row out per row in.
    Null texts and texts without words are clean; null keys are kept. Documents are joined by a
    digest of their text, so repeated keys and copies are safe. Items with one id are one item, a
    null id is written as the empty text, items without words are never hit. The fingerprint join
    and the join with the items' texts are broadcast only where Spark finds the written table small.
    """
    texts = docs.select(
        F.col(key).alias("_id"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
    ).withColumn("_key", F.unhex(F.md5("_text")))
    bench = items.select(
        F.coalesce(F.col(item_key).cast("string"), F.lit("")).alias("_item"),
        F.coalesce(F.col(item_text), F.lit("")).alias("_item_text"),
    ).distinct()
    bench = stage(_printed(bench, ["_item", "_item_text"], "_item_text", span_classes(window), window), "items")
    lengths = [r.n for r in bench.select(F.least("n_words", F.lit(window)).alias("n")).distinct().collect()]
    spans = sorted({span_of(n, window) for n in lengths if n})

    printed = stage(_printed(texts.select("_id", "_key", "_text"), ["_id", "_key"], "_text", spans), "prints")
    item_prints = stage(
        bench.select(F.explode("prints").alias("print"), "_item").distinct(), "item_prints"
    )
    pairs = (
        printed.select("_key", F.explode("prints").alias("print"))
        .join(item_prints, "print")
        .select("_key", "_item")
        .distinct()
    )
    candidates = stage(
        pairs.join(bench.select("_item", "_item_text"), "_item")
        .groupBy("_key")
        .agg(F.collect_list(F.struct(F.col("_item").alias("id"), F.col("_item_text").alias("text"))).alias("_items")),
        "candidates",
    )
    # Copies of a text are checked once.
    checked = texts.select("_key", "_text").join(candidates.select("_key"), "_key", "left_semi")
    checked = checked.groupBy("_key").agg(F.first("_text").alias("_text")).join(candidates, "_key")
    hits = checked.select("_key", "_text", "_items").mapInArrow(
        _extend(window), "_key binary, spans array<array<long>>, items array<string>"
    )
    hits = stage(hits, "hits")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return (
        printed.select("_id", "_key", "n_words")
        .join(hits, "_key", "left")
        .select(
            F.col("_id").alias(key),
            "n_words",
            F.coalesce(n_hit, F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce("spans", F.array().cast("array<array<long>>")).alias("spans"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            F.col("_key").alias("text_key"),
        )
        .withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
    )



def drop_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that are not contaminated; equal texts go or stay together."""
    docs, restore = shield(docs, key, text)
    found = find_contamination(docs, items, key, text, **how).filter("contaminated")
    gone = stage(found.select(F.col("text_key").alias("_gone")).distinct(), "contaminated")
    own = F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))
    marked = docs.withColumn("_key", own)
    return restore(marked.join(gone, F.col("_key") == F.col("_gone"), "left_anti"))
