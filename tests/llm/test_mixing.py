import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import base_rows
from topiclake.llm import mixing
from topiclake.llm.queries import Q

ADDED = ["doc_id", "size", "source_size", "target", "copies", "taken"]


def draw(*parts):
    return (int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) + 0.5) / 16.0**13


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Shares by weight, the excess shared again until nothing is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left = {}, share * sum(sizes.values())
    open_ = list(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > most * sizes[s]]
        if not over:
            return out | {s: weight[s] * level for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ = [s for s in open_ if s not in over]
    return out


def brute_rounding(rank, items, block):
    """Copies (0 or 1) of items (p, size), folded in blocks, level by level."""
    up = {}
    level, open_ = 0, [(p, float(s), i) for i, (p, s) in enumerate(items)]
    while open_:
        left = []
        for b in range(0, len(open_), block):
            held = open_[b]
            for at in range(b + 1, min(b + block, len(open_))):
                x, u = open_[at], draw(rank, level, at)
                a, give = (1 - held[0]) * held[1], x[0] * x[1]
                c, take = held[0] * held[1], (1 - x[0]) * x[1]
                rise, fall = min(a, give), min(c, take)
                if u * (rise + fall) < fall:
                    if a <= give:
                        up[held[2]], held = 1, (x[0] - rise / x[1], x[1], x[2])
                    else:
                        held = (held[0] + rise / held[1], held[1], held[2])
                elif c <= take:
                    held = (x[0] + fall / x[1], x[1], x[2])
                else:
                    up[x[2]], held = 1, (held[0] - fall / held[1], held[1], held[2])
            left.append(held)
        level += 1
        if len(left) == 1:
            up[left[0][2]] = int(left[0][0] >= 0.5)
            return [up.get(i, 0) for i in range(len(items))]
        open_ = left
    return []


def rows_by_source(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["source"]].append(r)
    return out


def test_targets_share_the_excess(spark):
    for sizes in ({"a": 10, "b": 100, "c": 1000, None: 5}, {"a": 0, "b": 7}, {"a": 3}, {None: 0}, {}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.source_targets(df, "source").collect()}
        want = brute_targets(sizes) if sum(sizes.values()) else {s: 0.0 for s in sizes}
        assert got == pytest.approx(want)


def test_folds_equal_brute_force(spark, monkeypatch):
    """Several levels: blocks of four, sources of up to 700 documents, one with a third of all."""
    monkeypatch.setattr(mixing, "BLOCK", 4)
    rows = [(i, ["hot", "b", None, "d", "e"][0 if i % 3 == 0 else i % 4 + 1], (i * 7919) % 97 + (5000 if i == 3 else 0)) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n long")
    got = mixing.mix(df, ["doc_id"], "source", F.col("n")).collect()
    assert len(got) == len(rows)
    copies = {r.doc_id: r.copies for r in got}
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    target = brute_targets(sizes)
    for rank, source in enumerate(sorted(sizes, key=lambda s: (s is None, s))):
        rate = target[source] / sizes[source]
        own = sorted((-n, hashlib.md5(str(i).encode()).hexdigest(), i) for i, s, n in rows if s == source and n)
        part = rate - int(rate)
        up = brute_rounding(rank, [(part, -n) for n, _, _ in own], 4) if part else [0] * len(own)
        assert [copies[i] for *_, i in own] == [int(rate) + u for u in up]
        taken = sum(-n * copies[i] for n, _, i in own)
        assert abs(taken - target[source]) <= max(-n for n, *_ in own)
    assert all(r.taken == r["size"] * r.copies and r.copies <= 2 for r in got)


def test_expected_copies_are_kept(spark):
    """Over many keys each document is rounded up as often as its part says."""
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), (F.col("id") % 3 * 50 + 10).alias("n"))
    got = mixing.mix(df, ["doc_id"], "source", F.col("n"), share=0.3).groupBy("size").agg(F.avg("copies").alias("m")).collect()
    assert all(abs(r.m - 0.3) < 0.04 for r in got)


def test_edges(spark, docs, no_docs, clashing):
    size = F.length("text")
    got = mixing.mix(docs, ["doc_id"], "source", size).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r[0], len(r[1] or "")) for r in base_rows())
    assert all(r.taken == 0 for r in got if r["size"] == 0)
    assert sorted(map(str, mixing.mix(docs, ["doc_id"], "source", size).collect())) == sorted(map(str, got))
    assert mixing.mix(no_docs, ["doc_id"], "source", size).collect() == []
    more = mixing.mix(clashing, ["doc_id", "key", "_text", "kept"], "source", size)
    assert more.columns == ["doc_id", "key", "_text", "kept", *ADDED[1:]]
    assert more.filter("kept = 'own kept'").count() == len(base_rows())
    with pytest.raises(ValueError):
        mixing.mix(docs.withColumn("Copies", F.lit(1)), ["Copies"], "source", size)
    assert mixing.mixed_rows(mixing.mix(docs, ["doc_id"], "source", size)).count() == sum(r.copies for r in got)


def test_equal_rows_for_a_third_of_all(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("doc_id"), F.lit("x").alias("source"), F.lit(9).alias("n")
    )
    got = mixing.mix(df, ["doc_id"], "source", F.col("n")).agg(F.sum("taken"), F.count("*"), F.first("target")).first()
    assert got[1] == 3000 and abs(got[0] - got[2]) <= 9


def test_query(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = Q["op11_pivotal_mix"](spark, str(tmp_path))
    assert rows.columns == ADDED
    words = Counter((r[0], len((r[1] or "").split())) for r in base_rows())
    assert Counter((r.doc_id, r["size"]) for r in rows.collect()) == words


def test_no_python_workers(spark, docs):
    plan = mixing.mix(docs, ["doc_id"], "source", F.length("text"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
