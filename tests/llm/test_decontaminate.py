import random
import re

import pytest

from tests.llm.conftest import DOCUMENT, SENTENCE, base_rows
from topiclake.llm import decontaminate as D
from topiclake.llm.winnow import split_span, winnow

AZ = str.maketrans({c: chr(ord(c) + 32) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(AZ))


def brute(texts, items, window=13):
    """(n_words, n_hit, items) of each text."""
    out = []
    for text in texts:
        words, hit, found = words_of(text), set(), set()
        for name, item in items:
            parts = words_of(item)
            n = min(window, len(parts))
            wanted = {tuple(parts[i : i + n]) for i in range(len(parts) - n + 1)} if n else set()
            for i in range(len(words) - n + 1):
                if n and tuple(words[i : i + n]) in wanted:
                    hit.update(range(i, i + n))
                    found.add("" if name is None else str(name))
        out.append((len(words), len(hit), sorted(found)))
    return out


def test_spans_cover_every_length():
    for n in range(1, 40):
        span = D.span_of(n, 13)
        k, window = split_span(span)
        assert k + window - 1 == span <= n


def test_shared_spans_keep_a_common_fingerprint():
    rng = random.Random(2)
    for _ in range(200):
        span = [str(rng.randrange(4)) for _ in range(13)]
        prints = []
        for _ in range(2):
            pad = [[str(rng.randrange(4)) for _ in range(rng.randrange(20))] for _ in range(2)]
            import pyarrow as pa

            from topiclake.llm.text import ALNUM, LOWER, Words, buffers, large

            data, offsets = buffers(large(pa.array([" ".join(pad[0] + span + pad[1])])))
            words = Words(LOWER[data], offsets, ALNUM)
            prints.append(set(winnow(words, words.hashes(), 7, 7)[1].tolist()))
        assert prints[0] & prints[1]


def test_against_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(5)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 5, 8, 13, 20])))) for i in range(12)]
    items += [(3, "v1 v2 v3 other"), (None, "v0 v0 v0"), (90, None), (91, " !? "), items[0]]
    texts = [" ".join(rng.choices(vocabulary + ["x", "y"], k=rng.randrange(0, 60))) for _ in range(60)]
    texts += [items[5][1] + " " + items[6][1], "v0"]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = D.find_contamination(docs, bench).orderBy("doc_id").collect()
    expected = brute(texts, items)
    assert [(r.n_words, r.n_hit, r["items"]) for r in found] == expected
    for r, (n, hit, _) in zip(found, expected):
        assert r.contaminated == (hit > 0 and 20 * hit >= n)
        assert sum(b - a for a, b in r.spans) == hit


def test_edges(spark, docs, no_docs, clashing):
    bench = spark.createDataFrame([(1, SENTENCE), (2, None)], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    found = D.find_contamination(docs, bench).collect()
    expected = brute([r[1] for r in base_rows()], [(1, SENTENCE)])
    assert sorted((r.n_words, r.n_hit, r["items"]) for r in found) == sorted(expected)
    assert not any(r.n_hit for r in D.find_contamination(docs, none).collect())
    assert D.find_contamination(no_docs, bench).count() == 0
    kept = D.drop_contaminated(clashing, bench)
    assert kept.columns == clashing.columns
    assert kept.count() == sum(not (h and 20 * h >= n) for n, h, _ in expected)


@pytest.mark.parametrize("copies", [200])
def test_many_copies(spark, copies):
    docs = spark.createDataFrame([(i, SENTENCE) for i in range(copies)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, SENTENCE)], "item_id long, text string")
    assert D.find_contamination(docs, bench).filter("contaminated and n_hit = n_words").count() == copies
    assert spark.createDataFrame([], DOCUMENT).count() == 0
