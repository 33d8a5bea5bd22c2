import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import base_rows
from topiclake.llm import neardup as N

AZ = str.maketrans({c: chr(ord(c) + 32) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))
    if len(words) < size:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute(rows, size, limit=(4, 5)):
    """(id, n, component) of each row; ids may repeat or be null."""
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and limit[1] * common >= limit[0] * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    members = {}
    for i, (name, _) in enumerate(rows):
        members.setdefault(find(i), []).append(name)
    least = {r: min((n for n in m if n is not None), default=None) for r, m in members.items()}
    return [(n, len(s), least[find(i)]) for i, ((n, _), s) in enumerate(zip(rows, sets))]


def as_key(row):
    return tuple(str(x) for x in row)


def check(spark, rows, size):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = N.near_duplicates(docs, shingle=size).collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=as_key)
    assert got == sorted(brute(rows, size), key=as_key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def edited(rng, words, edits, mark):
    words = list(words)
    for e in range(edits):
        words[rng.randrange(len(words))] = f"{mark}-{e}"
    return " ".join(words)


@pytest.mark.parametrize("size", [2, 5])
def test_chains_groups_and_common_passages(spark, size):
    rng = random.Random(size)
    passage = [f"p{i}" for i in range(25)]
    rows = []
    for g in range(12):
        words = [f"g{g}w{rng.randrange(200)}" for _ in range(rng.choice([8, 20, 60, 150]))] + passage
        for c in range(rng.choice([1, 2, 6])):
            rows.append((len(rows), edited(rng, words, rng.randrange(0, 8), f"e{len(rows)}")))
    # A chain: each text is close to the next, the ends are not.
    words = [f"c{i}" for i in range(100)]
    for i in range(12):
        rows.append((len(rows), " ".join(words[i * 6 : i * 6 + 80] if i < 4 else words[:80])))
    # Many different texts around one passage.
    for i in range(40):
        rows.append((len(rows), " ".join(passage + [f"u{i}x{j}" for j in range(12)])))
    rng.shuffle(rows)
    check(spark, [(1000 - i, t) for i, t in rows], size)


def test_large_group(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(120)]
    check(spark, [(i, edited(rng, words, 2, f"e{i}")) for i in range(150)], 2)


def test_star_around_a_centre(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(100, " ".join(words))]
    for i in range(9):  # leaves that are close to the centre and not to each other
        own = list(words)
        own[i * 6] = f"leaf{i}"
        own[i * 6 + 3] = f"leaf{i}b"
        own[i * 6 + 5] = f"leaf{i}c"
        rows.append((i, " ".join(own)))
    check(spark, rows, 2)


def test_edges(spark, docs, no_docs, clashing):
    check(spark, [(r[0], r[1]) for r in base_rows()], 2)
    assert N.near_duplicates(no_docs).count() == 0
    kept = N.drop_near_duplicates(clashing)
    assert kept.columns == clashing.columns
    rows = kept.select("doc_id", "text").collect()
    # One row for each group, and every row without words.
    expected = brute([(r[0], r[1]) for r in base_rows()], 5)
    groups = {c for _, n, c in expected if n}
    assert len(rows) == len(groups) + sum(n == 0 for _, n, _ in expected)
    assert sorted(r.doc_id for r in rows if shingles(r.text, 5)) == sorted(groups)


def test_links_at_the_limit(spark):
    """Pairs of 0.80 to 0.85: changed words in one stretch, at even steps, at the end, anywhere."""
    rng = random.Random(8)
    rows, wanted = [], []
    for p in range(1200):
        n = rng.choice([30, 60, 120, 300])
        words = [f"p{p}w{i}" for i in range(n)]
        kind, other = p % 4, list(words)
        for edits in range(1, n):
            if kind == 0:
                places = range(n // 3, n // 3 + edits)
            elif kind == 1:
                places = range(0, n, max(1, n // edits))
            elif kind == 2:
                places = range(n - edits, n)
            else:
                places = rng.sample(range(n), edits)
            changed = [f"x{i}" if i in set(places) else w for i, w in enumerate(words)]
            a, b = shingles(" ".join(words), 2), shingles(" ".join(changed), 2)
            if 5 * len(a & b) < 4 * len(a | b):
                break
            other = changed
        a, b = shingles(" ".join(words), 2), shingles(" ".join(other), 2)
        wanted.append(5 * len(a & b) >= 4 * len(a | b))
        rows += [(2 * p, " ".join(words)), (2 * p + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in N.near_duplicates(docs, shingle=2).collect()}
    assert all(wanted) and all(got[2 * p + 1] == 2 * p for p in range(1200))


def test_rare_values_find_every_candidate():
    """Two sketches that share enough have one of their rarest values in common."""
    rng = random.Random(3)
    for _ in range(300):
        size = rng.choice([5, 12, 48])
        values = rng.sample(range(10**6), 2 * size)
        common = rng.randint(-(-size // 2), size)
        a = values[:size]
        b = values[:common] + values[size : 2 * size - common]
        length = {v: rng.choice([1, 2, 2, 3, 50]) for v in values}
        for v in values[:common]:
            length[v] = max(length[v], 2)
        floor = common / size

        def prefix(s):
            ranked = sorted((length[v], v) for v in s)
            return {v for _, v in ranked[: size - math.ceil(floor * size - 1e-9) + 1]}

        assert prefix(a) & prefix(b)


def test_long_lists_of_several_components(spark, monkeypatch):
    """Leaders, tiles by sketches and by whole sets, in blocks of four."""
    monkeypatch.setattr(N, "SHORT", 2)
    monkeypatch.setattr(N, "TILE", 4)
    monkeypatch.setattr(N, "HUB_PAIRS", 3)
    rng = random.Random(11)
    shared = [f"s{i}" for i in range(40)]
    rows = []
    for g in range(10):
        own = shared + [f"g{g}w{i}" for i in range(rng.choice([6, 14, 40]))]
        for c in range(rng.choice([1, 3, 7])):
            rows.append((len(rows), edited(rng, own, rng.randrange(0, 5), f"e{len(rows)}")))
    check(spark, rows, 2)
    check(spark, rows, 5)


def test_only_what_may_go_is_shuffled(spark):
    """Rows that are not listed are told by a bitmap, without a join; listed ones are never missed."""
    rows = spark.range(20_000).selectExpr(
        "if(id % 1000 = 7, null, id) as doc_id", "unhex(md5(string(id))) as _key", "repeat('x', 9) as text"
    )
    listed = rows.filter("_key in (unhex(md5('7')), unhex(md5('12'))) or doc_id % 100 = 3")
    listed = listed.select(F.col("doc_id").alias("_drop_id"), F.col("_key").alias("_drop_key"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        safe, asked = N._apart(rows, ["doc_id", "_key"], listed)
        text = safe._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in text and "SortMergeJoin" not in text
        assert safe.columns == asked.columns == rows.columns
        assert safe.count() + asked.count() == 20_000 and safe.count() > 17_000
        same = F.col("doc_id").eqNullSafe(F.col("_drop_id")) & (F.col("_key") == F.col("_drop_key"))
        assert safe.join(listed, same, "left_semi").isEmpty()
        assert asked.join(listed, same, "left_semi").count() == 202
        assert N._apart(rows, ["doc_id", "_key"], listed.filter("false"))[0].count() == 20_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
