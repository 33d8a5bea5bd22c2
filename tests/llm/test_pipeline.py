"""The stages one by one on a small table whose answers are plain, and the whole on the test tables."""

import os

import numpy as np
import pytest
import public_tokenizers
import tiktoken

import corpus_pipeline as P
from tests.llm.conftest import CLASHING, DOCUMENT
from tests.llm.test_cotraining import made
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_neardup import brute as brute_links
from tests.llm.test_secrets import brute as brute_secrets
from topiclake.llm import bpe

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    rows, labels, known = made(rng, 400, 200)
    unique = [(i, " ".join(t.split()[:-1] + [f"u{i}a{j}" for j in range(30)]), *rest) for i, t, *rest in rows]
    good = [i for i, label in enumerate(labels) if label]
    first = unique[good[0]][1]
    passage = " ".join(f"b{i}" for i in range(20))
    unique += [
        (1000, first, "en", "s1", len(first)), (1001, first + " more", "en", "s1", 1),
        (1002, f"{passage} {unique[good[1]][1]}", "en", "s2", 1), (1003, unique[good[2]][1] + ' token = "0123456789abcdef01"', "en", "s2", 1),
        (1004, None, None, None, None), (1005, "", "en", "s1", 0),
    ]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(unique, DOCUMENT).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(known, "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(7, passage)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_every_stage_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    tables = {}
    for name, stage in P.STAGES:
        tables[name] = stage(spark, docs, folder)
        docs = spark.createDataFrame(tables[name].collect(), tables[name].schema)
        tables[name] = docs
    rows = {n: [r.asDict() for r in t.collect()] for n, t in tables.items()}

    left = [(r["doc_id"], r["text"]) for r in rows["quality"]]
    links = brute_links(left, 5)
    keep = {i for (i, n, c) in links if n == 0 or i == c}
    assert {r["doc_id"] for r in rows["near_duplicates"]} == keep

    left = [(r["doc_id"], r["text"]) for r in rows["near_duplicates"]]
    hits = brute_hits([t for _, t in left], [(7, " ".join(f"b{i}" for i in range(20)))])
    clean = {i for (i, _), (n, h, _) in zip(left, hits) if not (h and 20 * h >= n)}
    assert {r["doc_id"] for r in rows["decontamination"]} == clean and len(clean) < len(left) + 1

    before = {r["doc_id"]: r for r in rows["decontamination"]}
    for r in rows["secrets"]:
        old = before.pop(r["doc_id"])
        assert not brute_secrets(r["text"])
        if not brute_secrets(old["text"]) and "[SECRET]" not in (r["text"] or ""):
            assert r["text"] == old["text"]
        assert r["n_chars"] == (old["n_chars"] if r["text"] is None else len(r["text"]))
    assert not before

    path = public_tokenizers.path(P.VOCABULARY)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(bpe.read_ranks(path)), special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in rows["secrets"]}
    assert len(rows["tokens"]) == len(texts)
    for r in rows["tokens"]:
        expected = library.encode_ordinary(texts[r["doc_id"]] or "")
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == expected and r["n_tokens"] == len(expected)


def test_planted_cases(spark, folder):
    ids = {r.doc_id for r in P.run(spark, folder).select("doc_id").collect()}
    assert 1000 not in ids and 1001 not in ids and 1002 not in ids


@pytest.mark.parametrize("number", range(5))
def test_edges(spark, docs, no_docs, clashing, folder, number):
    name, stage = P.STAGES[number]
    for table in (docs, no_docs, clashing):
        out = stage(spark, table, folder)
        rows = out.collect()
        if number < 4:
            assert out.columns == table.columns
        assert len(rows) <= table.count()
    assert {c for c in CLASHING if c != "ids"} <= set(stage(spark, clashing, folder).columns)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_on_the_test_tables(spark):
    out = P.run(spark, SF)
    assert 0 < out.count() <= spark.read.parquet(f"{SF}/documents.parquet").count()
