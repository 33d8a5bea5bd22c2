import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import base_rows
from topiclake.llm import suffix_tree as T
from topiclake.llm.text import LOWER, SOLID, Words, buffers, large

AZ = str.maketrans({c: chr(ord(c) + 32) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))


def base(rows):
    """(id, n_tokens, n_known, N, base score) of (id, text, learn) rows."""
    counts = Counter()
    for _, text, learn in rows:
        if learn:
            counts.update([*words_of(text), "\n"])
    total, kinds = sum(counts.values()), len(counts)
    out = []
    for name, text, _ in rows:
        tokens = [*words_of(text), "\n"]
        score = sum(math.log10((counts[t] + 1) / (total + kinds + 1)) for t in tokens)
        out.append((name, len(tokens), sum(counts[t] > 0 for t in tokens), total, round(score, 6)))
    return out


def scored(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, learn boolean")
    model = T.train(df, "text", "learn")
    found = T.score(df, ["doc_id"], "text", model).collect()
    got = Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found)
    assert got == Counter(base(rows))
    return model, found


@pytest.fixture(scope="module")
def languages():
    """Texts of two languages; some words are rare."""
    rng = np.random.default_rng(8)
    words = [[f"{p}{i}{p}" for i in range(60)] for p in ("ka", "zu")]
    share = 1 / np.arange(1, 61)
    rows = []
    for i in range(300):
        own = rng.choice(words[i % 2], 80, p=share / share.sum()).tolist()
        own[3] = f"{own[3]}{i}"
        rows.append((i, " ".join(own), i % 5 != 0))
    return rows


def test_base_and_gain(spark, languages):
    model, found = scored(spark, languages)
    held = [r for r in found if r.doc_id % 5 == 0]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)
    assert len(model.tree.levels[0].contexts) > 10


def test_distributions_add_up(spark, languages):
    """Every state's next-symbol distribution sums to one, and so does each class's share."""
    model, _ = scored(spark, languages)
    tree = model.tree
    assert abs(tree.root.sum() - 1) < 1e-9
    everything = np.arange(tree.size)
    for level in tree.levels:
        for i in range(0, len(level.contexts), 7):
            symbols = T._parent(tree, np.full(tree.size, level.contexts[i]), everything, 1)
            assert abs(symbols.sum() - 1) < 1e-9
    depth = 1
    p = T._parent(tree, np.repeat(tree.levels[0].contexts[:5], tree.size), np.tile(everything, 5), depth + 1)
    assert np.allclose(p.reshape(5, -1).sum(axis=1), 1)


def test_longest_suffix_state(spark):
    """A context of two words decides where one word does not."""
    rows = [(i, ("x a p " if i % 2 else "y a q ") * 40, True) for i in range(60)]
    model, found = scored(spark, rows)
    tree = model.tree
    assert len(tree.levels) > 1 and len(tree.levels[1].contexts)
    for text, next_word, other in (("x a p", 2, "q"), ("y a q", 2, "p")):
        data, offsets = buffers(large(__import__("pyarrow").array([text, text.replace(text[-1], other)])))
        symbols, texts, _, _ = tree.sequence(Words(LOWER[data], offsets, SOLID))
        p = tree.probabilities(symbols)
        assert p[next_word] > 0.9 and p[4 + next_word] < 0.05


def test_edges(spark, clashing, no_docs):
    rows = [(r[0], r[1], i % 4 != 0) for i, r in enumerate(base_rows())]
    scored(spark, rows)
    # Nothing to learn from, and nothing to score.
    _, found = scored(spark, [(1, "some words", False), (2, None, False)])
    assert all(np.isfinite(r.score) for r in found)
    empty = no_docs.withColumn("learn", F.lit(True))
    assert T.score(empty, ["doc_id"], "text", T.train(empty, "text", "learn")).count() == 0
    many = clashing.withColumn("learn", F.lit(True))
    model = T.train(many, "text", "learn")
    assert T.score(many, ["doc_id", "kept", "key"], "text", model).filter("kept = 'own kept'").count() == many.count()


def test_full_counters_pass_on_and_levels_move_no_successors(spark, languages, monkeypatch):
    """Counts that tasks pass on in parts add up; contexts are broadcast, so successors are not sorted."""
    model, found = scored(spark, languages)
    monkeypatch.setattr(T, "HELD", 50)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plans, real = [], T.stage
    monkeypatch.setattr(
        T, "stage", lambda df, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, *a)
    )
    try:
        parts, again = scored(spark, languages)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert {r.doc_id: round(r.score, 6) for r in again} == {r.doc_id: round(r.score, 6) for r in found}
    assert all((a.contexts == b.contexts).all() for a, b in zip(model.tree.levels, parts.tree.levels))
    assert not any("SortMergeJoin" in p for p in plans)
    counter = T.Counter()
    counter.add(np.arange(40))
    assert not counter.full()
    counter.add(np.arange(20, 60))
    assert counter.full()
