import hashlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import DOCUMENT, base_rows
from topiclake.llm import cotraining as C
from topiclake.llm.text import buffers, large

GOOD = "the river ran by the old mill and the children of the town came to see the boats go by".split()


def made(rng, n, labelled):
    """Documents whose text and source both tell quality; only a few are labelled."""
    rows, labels = [], []
    for i in range(n):
        good = int(rng.random() < 0.6)
        words = rng.choice(GOOD, 40).tolist()
        if not good:
            words = [w.upper() + "!!" if rng.random() < 0.8 else "#$%" for w in words]
        source = f"s{rng.integers(0, 10) + (0 if good == (rng.random() < 0.95) else 10)}"
        text = " ".join(words)
        rows.append((i, text, "en", source, len(text)))
        labels.append(good)
    return rows, labels, [(i, labels[i]) for i in range(labelled)]


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels, known = made(np.random.default_rng(2), 900, 200)
    return (
        spark.createDataFrame(rows, DOCUMENT), labels,
        spark.createDataFrame(known, "doc_id long, quality int"),
    )


def test_held_out_accuracy(tables):
    docs, labels, known = tables
    model = C.fit(docs, known, labelled=200, unlabelled=400)
    rows = C.score(docs, model, ["doc_id"]).collect()
    assert len(rows) == 900
    unseen = [r for r in rows if r.doc_id >= 200]
    assert np.mean([r.kept == bool(labels[r.doc_id]) for r in unseen]) > 0.98
    # The views exchanged labels, and both calibrated scores tell something.
    assert model.handed[0] > 0
    for view in ("content_score", "meta_score"):
        assert np.mean([(r[view] > 0.5) == bool(labels[r.doc_id]) for r in unseen]) > 0.8
    kept = C.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in rows)


def test_exchange_helps_the_weaker_view():
    rng = np.random.default_rng(5)
    n = 600
    y = rng.integers(0, 2, n)
    strong = np.stack([y * 4 - 2 + rng.normal(0, 0.5, n), rng.normal(0, 1, n)], axis=1)
    weak = np.zeros((n, 200), np.float32)
    weak[np.arange(n), y * 100 + rng.integers(0, 100, n)] = 1
    labels = np.full(n, -1)
    labels[:120] = y[:120]
    held = np.arange(n) < 20
    model = C.cotrain([strong, weak], labels, held)
    alone = C.Linear().fit(weak[20:120], y[20:120])
    rest = np.arange(120, n)
    before = np.mean((alone.logits(weak[rest]) > 0) == y[rest])
    after = np.mean((model.views[1].logits(weak[rest]) > 0) == y[rest])
    assert after > before + 0.02


def test_same_model_for_any_partitioning(tables):
    docs, _, known = tables
    a = C.fit(docs, known, labelled=100, unlabelled=100)
    b = C.fit(docs.repartition(7), known.repartition(3), labelled=100, unlabelled=100)
    assert a.threshold == b.threshold and (a.views[0].weights == b.views[0].weights).all()


def test_edges(spark, docs, no_docs, clashing, tables):
    known = tables[2]
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert C.fit(docs, none) is None and C.fit(no_docs, known) is None
    one_sided = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    assert C.fit(docs, one_sided) is None
    # Without a model everything is kept.
    assert C.score(docs, None, ["doc_id"]).filter("kept and score is null").count() == len(base_rows())
    odd = spark.createDataFrame([(1, None), (None, 0), (2, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    C.fit(docs, odd)
    model = C.fit(*[tables[0], known], labelled=200, unlabelled=50)
    rows = C.score(docs, model, ["doc_id"]).collect()
    assert len(rows) == len(base_rows()) and all(0 <= r.score <= 1 for r in rows)
    assert C.score(no_docs, model, ["doc_id"]).count() == 0
    kept = C.keep_good(clashing, model)
    assert kept.columns == clashing.columns
    assert kept.filter("kept != 'own kept' or score != 'own score'").count() == 0


def test_rounds_over_all_documents(tables):
    """The rounds on the cluster give the model of the same rounds on arrays, and nothing is capped."""
    docs, _, known = tables
    model = C.fit(docs, known)
    rows = sorted(docs.collect(), key=lambda r: hashlib.md5(str(r.doc_id).encode()).hexdigest())
    data, offsets = buffers(large(pa.array([r.text for r in rows])))
    meta = C.meta_view([r.lang for r in rows], [r.source for r in rows], [r.n_chars for r in rows], offsets)
    features = [C.text_view(data, offsets), meta]
    given = {r.doc_id: r.quality for r in known.collect()}
    labels = np.array([given.get(r.doc_id, -1) for r in rows])
    ends = [int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[-8:], 16) for r in rows]
    held = (labels >= 0) & (np.array(ends) % 10 < 3)
    other = C.cotrain(features, labels, held)
    for a, b in zip(model.views, other.views):
        assert (a.mean == b.mean).all() and (a.scale == b.scale).all() and (a.weights == b.weights).all()
    assert model.threshold == other.threshold and model.handed == other.handed
    # Every one of the 700 other documents is handed over as soon as a view is sure of it.
    assert model.handed[-1] > 700


def test_one_step_by_plain_loops(tables):
    """Sums of one exchange against loops over rows."""
    rng = np.random.default_rng(4)
    features = [rng.normal(size=(80, 3)), rng.normal(size=(80, 2))]
    views = [
        C.View(np.zeros(d), np.ones(d), np.round(rng.normal(size=d + 1) * 4 * C.FINE) / C.FINE) for d in (3, 2)
    ]
    found = C._exchange_sums(views, views, features)
    for i in (0, 1):
        for label in (0, 1):
            n, gradient, hessian = 0, np.zeros(len(views[i].weights)), np.zeros((len(views[i].weights),) * 2)
            for mine, other in zip(features[i], features[1 - i]):
                q = 1 / (1 + np.exp(-(np.append(np.round(other * 64) / 64, 1) @ views[1 - i].weights)))
                if (q if label else 1 - q) < C.SURE:
                    continue
                z = np.append(np.round(mine * 64) / 64, 1)
                p = 1 / (1 + np.exp(-(z @ views[i].weights)))
                n += 1
                gradient += (p - label) * z
                hessian += max(p * (1 - p), 1 / 256) * np.outer(z, z)
            assert found[i][label].rows == n > 0
            assert np.allclose(found[i][label].gradient, gradient, atol=n * 1e-4)
            assert np.allclose(found[i][label].hessian, hessian, atol=n * 0.02)
