"""Words of a batch are divided at once, as each alone."""

import numpy as np
import pyarrow as pa

from topiclake.functions import segment


def test_words_of_a_batch_are_divided_as_each_alone():
    rng = np.random.default_rng(1)
    known = {"".join(rng.choice(list("abé𝔘"), rng.integers(1, 4))): float(rng.integers(1, 6)) for _ in range(30)}
    words = ["".join(rng.choice(list("abé𝔘z"), rng.integers(1, 15), p=[0.3, 0.3, 0.2, 0.17, 0.03])) for _ in range(300)]
    words += ["a" * 3000, "z"]
    pieces = [
        [(i, j - i, known[w[i:j]]) for i in range(len(w)) for j in range(i + 1, min(i + 4, len(w)) + 1) if w[i:j] in known]
        for w in words
    ]
    wanted = []
    for w, found in zip(words, pieces):
        parts = {}
        for start, size, cost in found:
            parts.setdefault(start + size, []).append((start, cost))
        wanted.append(segment.split_word(w, parts))
    assert 50 < sum(a != b for a, b in zip(words, wanted)) < 300
    for p in pieces:
        rng.shuffle(p)
    rows = [(i, w, None, None, None) for i, w in enumerate(words)]
    rows += [(i, None, *p) for i, found in enumerate(pieces) for p in found]
    rows = sorted(rows, key=lambda r: r[0])
    schema = pa.schema([("id", pa.int64()), ("word", pa.string()), ("start", pa.int32()), ("size", pa.int32()), ("cost", pa.float64())])
    table = pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)
    # However the rows are cut into batches, also within the pieces of a word.
    for size in (1, 7, 1000, len(rows)):
        out = pa.Table.from_batches(segment._divided(iter(table.to_batches(size))))
        assert list(zip(*(out.column(c).to_pylist() for c in ("word", "divided")))) == [
            (a, b) for a, b in zip(words, wanted) if a != b
        ]


def test_words_and_vocabulary_from_one_count(spark):
    from topiclake.operators.words import word_counts

    df = spark.createDataFrame([(1, "sun day sun day sunday  x"), (2, "sunday sunnyday day"), (3, ""), (4, None)], "k int, t string")
    counts = word_counts(df, "t")
    once = segment.segment_words(df, "t", segment.frequent(counts), counts)
    twice = segment.segment_words(df, "t", segment.learn_vocabulary(df, "t"))
    assert sorted(once.collect()) == sorted(twice.collect())


def test_only_words_that_may_change_are_shuffled(spark, monkeypatch):
    """A list too large for a broadcast: other words do not meet it, and the result is the same."""
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{rng.integers(3000)}x" for _ in range(30)) + " sunday sun day" for _ in range(200)] + ["", "sunnyday"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    vocabulary = spark.createDataFrame([("sun", 900), ("day", 800), *((f"w{i}x", 1) for i in range(3000))], "word string, n long")
    plain = sorted(segment.segment_words(df, "t", vocabulary).collect())
    assert plain[0].t.endswith(" sun day sun day")
    seen = []
    real = segment._perhaps_listed
    monkeypatch.setattr(segment, "_perhaps_listed", lambda *a: seen.append((a[0], real(*a))) or seen[0][1])
    monkeypatch.setattr(segment, "SMALL_ROWS", 0)
    assert sorted(segment.segment_words(df, "t", vocabulary).collect()) == plain
    before, after = (x.count() for x in seen[0])
    assert 200 <= after < before / 10
