import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import base_rows
from topiclake.llm import secrets as S
from topiclake.llm.text import buffers, large

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)


def brute(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 16]
    return sorted(out)


PARTS = st.sampled_from(
    ["password", "Secret", "TOKEN", "api_key", "apikey", "passwd", "\"", "'", " ", ":", "=", "AKIA", "ABCDEFGHIJ0123",
     "0123456789abcdef", "f", "x", "é", "中", "\n", "/+-_.", "longenoughvalue1", "ſecret", "toKen"]
)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(PARTS, max_size=14).map("".join)), min_size=1, max_size=4))
def test_rules_are_those_of_the_patterns(texts):
    data, offsets = buffers(large(pa.array(texts, pa.string())))
    found = [[] for _ in texts]
    for t, s, k, e in S.rule_spans(data, offsets, S.code_points_before(data)):
        found[t].append((s, k, e))
    assert found == [brute(t) for t in texts]


@pytest.fixture(scope="module")
def findings():
    rng = np.random.default_rng(3)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", np.uint8)
    texts, labels = [], []
    for i in range(600):
        key = rng.choice(letters, 32).tobytes().decode()
        number = "".join(map(str, rng.integers(0, 10, 16)))
        texts.append(f"some words here {key} and more" if i % 2 else f"call {number[:4]}-{number[4:10]}.{number[10:]} now")
        labels.append(i % 2)
    data, offsets = buffers(large(pa.array(texts)))
    spans, starts, ends = S.candidates(data, offsets, S.code_points_before(data))
    return S.windows(data, offsets, starts, ends), np.array([labels[s[0]] for s in spans])


def test_held_out_accuracy_and_recall(findings):
    x, y = findings
    network = S.train(x[:400], y[:400], np.arange(400) % 10 < 3, recall=0.95)
    found = network.probabilities(x[400:]) >= network.threshold
    assert (found == y[400:]).mean() > 0.95
    assert found[y[400:] == 1].mean() > 0.9


def test_threshold_keeps_the_recall_of_few_weak_secrets(findings):
    x, _ = findings
    network = S.Network.new()
    order = np.argsort(network.logits(x))
    # Twelve secrets spread over the scores of 400 others.
    y = np.zeros(len(x), int)
    y[order[len(x) // 3 :: len(x) // 18][:12]] = 1
    network.calibrate(x, y, 0.95)
    assert (network.probabilities(x[y == 1]) >= network.threshold).mean() >= 0.95
    again = np.concatenate([network.probabilities(x[i : i + 1]) for i in np.flatnonzero(y)])
    assert (again >= network.threshold).mean() >= 0.95


def test_gradients(findings):
    x, y = findings
    network = S.Network.new()
    weight = np.ones(16)
    names = ["embed", "filters", "bias", "out", "shift"]
    each = network._gradients(x[:16], y[:16].astype(float), weight)

    def loss():
        p = 1 / (1 + np.exp(-network.logits(x[:16]).astype(float)))
        return -np.mean(np.where(y[:16] == 1, np.log(p), np.log(1 - p)))

    rng = np.random.default_rng(0)
    for name, gradient in zip(names, each):
        value = getattr(network, name)
        at = tuple(rng.integers(0, s) for s in value.shape) if name != "embed" else np.unravel_index(np.abs(gradient).argmax(), gradient.shape)
        old, step = value[at], 1e-2
        value[at] = old + step
        up = loss()
        value[at] = old - step
        down = loss()
        value[at] = old
        assert abs((up - down) / (2 * step) - gradient[at]) < 5e-3


def test_no_network_without_both_labels(findings):
    x, _ = findings
    assert S.train(x, np.ones(len(x), int), np.arange(len(x)) % 2 == 0) is None


def test_table(spark, docs, no_docs, clashing):
    network = S.fit(docs)
    rows = S.find_secrets(docs, ["doc_id"], "text", network).collect()
    base = Counter(
        (r.doc_id, tuple((s.start, S.KINDS.index(s.kind), s.end) for s in r.spans if s.kind != "network")) for r in rows
    )
    assert base == Counter((r[0], tuple(brute(r[1]))) for r in base_rows())
    assert S.fit(no_docs) is None
    assert S.find_secrets(no_docs, ["doc_id"], "text", None).count() == 0
    clean = S.redact_all(clashing, "text", network)
    assert clean.columns == clashing.columns
    for r in clean.collect():
        assert not brute(r.text) and r.spans == "own spans"
    assert sum(r.text is None for r in clean.collect()) == 2


def test_redaction_joins_overlaps():
    spans = [{"start": 2, "end": 5}, {"start": 4, "end": 8}, {"start": 10, "end": 11}]
    assert S.redact("abcdefghijklm", spans, "_") == "ab_ij_lm"
    assert S.redact(None, []) is None


def test_candidates_of_the_network_are_added(spark):
    rows = []
    for i in range(300):
        key = "".join(chr(97 + (i * 7 + j * j * 3 + i * j) % 26) if j % 3 else str((i + j) % 10) for j in range(30))
        rows.append((i, f'token = "{key}" then 12.34.{i % 99}.{100 + i} and {i:07d}.{i * 37:08d} end'))
    rows.append((900, "zz9yy8xx7ww6vv5uu4tt3ss2rr1qq0"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    network = S.fit(df)
    assert network is not None
    found = {r.doc_id: r.spans for r in S.find_secrets(df, ["doc_id"], "text", network).collect()}
    assert all(s.kind in S.KINDS for spans in found.values() for s in spans)
    assert sum(any(s.kind == "assign" for s in spans) for spans in found.values()) == 300


def test_random_keys_in_plain_sentences_are_found(spark):
    """Trained on a table whose rules find only assignments; keys of alphabets that were not in training."""
    rng = np.random.default_rng(4)
    parts = ["inter", "nation", "ation", "under", "stand", "ment", "able", "over", "press", "ing", "form", "less"]

    def word():
        return "".join(rng.choice(parts, 3)).ljust(12, "s")

    def key(n, characters="ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"):
        return "".join(rng.choice(list(characters), n))

    rows = [(i, f"so the {word()} and 2024-{i % 12:02d}-{i % 28:02d}T{i:04d} went by") for i in range(600)]
    rows += [(1000 + i, f'her password = "{key(20)}" was long') for i in range(60)]
    network = S.fit(spark.createDataFrame(rows, "doc_id long, text string"))

    def share(texts):
        data, offsets = buffers(large(pa.array(texts)))
        _, starts, ends = S.candidates(data, offsets, S.code_points_before(data))
        return (network.probabilities(S.windows(data, offsets, starts, ends)) >= network.threshold).mean()

    base58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
    assert share([f"we saw {key(32, base58)} there yesterday" for _ in range(300)]) >= 0.9
    assert share([f"we saw {key(32)} there yesterday" for _ in range(300)]) >= 0.9
    assert share([f"we saw the {word()} there" for _ in range(1000)]) <= 0.005


def test_made_windows():
    plain = np.full((5, S.WINDOW), ord("x"), np.uint8)
    made = S.made_findings(plain, 200)
    size = (made[:, S.BEFORE : S.BEFORE + S.HEAD + S.TAIL] > 0).sum(axis=1)
    assert size.min() >= 12 and size.max() <= S.HEAD + S.TAIL
    assert (made[:, : S.BEFORE] == ord("x")).all() and (made[:, -S.AFTER :] == ord("x")).all()
    assert (S.in_capitals(plain, 3)[:, S.BEFORE : -S.AFTER] == ord("X")).all()


def test_runs_without_digits_are_candidates(spark):
    rng = np.random.default_rng(8)
    letters = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
    parts = ["inter", "nation", "ation", "under", "stand", "ment", "able", "over", "press", "ing", "form", "less"]

    def key(n):
        return "".join(rng.choice(letters, n))

    def word():
        return "".join(rng.choice(parts, 3)).ljust(12, "s")

    # The network tells keys of letters from long words.
    texts = [f"so the {word() if i % 2 else key(24)} went by" for i in range(600)]
    data, offsets = buffers(large(pa.array(texts)))
    _, starts, ends = S.candidates(data, offsets, S.code_points_before(data))
    x, y = S.windows(data, offsets, starts, ends), 1 - np.arange(600) % 2
    assert len(x) == 600
    network = S.train(x[:400], y[:400], np.arange(400) % 10 < 3, recall=0.95)
    found = network.probabilities(x[400:]) >= network.threshold
    assert found[y[400:] == 1].mean() > 0.9 and found[y[400:] == 0].mean() < 0.05

    # They are scored in tables, and are among the labelled findings of both kinds.
    rows = [(i, t) for i, t in enumerate(texts[400:])]
    rows += [(1000 + i, f'a token = "{key(24)}" was {i:013d}') for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in S.find_secrets(df, ["doc_id"], "text", network).collect()}
    assert [any(s.kind == "network" for s in spans[i]) for i in range(200)] == found.tolist()
    assert {(r.label, r.digit) for r in S.labelled_findings(df).collect()} == {(0, False), (0, True), (1, False)}


def test_all_findings_train_and_calibrate(spark, monkeypatch):
    """Beyond the sample the network learns from every finding, however the table is cut, and the threshold is the
    recall of all held-out secrets."""
    rng = np.random.default_rng(6)
    letters = list("abcdefghijklmnopqrstuvwxyz0123456789")
    key = lambda n: "".join(rng.choice(letters, n))
    rows = [(i, f'so the {key(6)}mentations{i % 7} and token = "{key(12 + i % 30)}" on {i:013d} went by') for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(S, "PART", 300)
    monkeypatch.setattr(S, "FEW", 20)
    monkeypatch.setattr(S, "BINS", 7)
    first = S.fit(df, sample=40, made=0)
    again = S.fit(df.repartition(5), sample=40, made=0)
    for a, b in zip(first.weights(), again.weights()):
        np.testing.assert_array_equal(a, b)
    np.testing.assert_allclose(first.threshold, again.threshold, rtol=1e-9)
    seen = S.labelled_findings(df).filter("label = 1").withColumn("order", F.md5("window")).collect()
    held = [r for r in seen if int(r.order[-8:], 16) % 10 < 3]
    scores = first.probabilities(np.stack([np.frombuffer(bytes(r.window), np.uint8) for r in held]))
    assert len(held) > 100 and (scores < first.threshold).sum() == int(0.05 * len(held) + 1e-9)
    # Other findings outside the sample give other weights.
    most = S.fit(df.filter("doc_id < 500"), sample=40, made=0)
    assert any((a != b).any() for a, b in zip(first.weights(), most.weights()))


def test_ranked(spark, monkeypatch):
    monkeypatch.setattr(S, "FEW", 3)
    monkeypatch.setattr(S, "BINS", 4)
    values = [0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.5, 1.5, 2.0, 900.0, -3.0, 7.0, 7.25, 7.5]
    df = spark.createDataFrame([(v,) for v in values], "z double")
    assert [S._ranked(df, i) for i in range(len(values))] == sorted(values)
