"""Quality classifier by co-training on two views of a document.

One classifier sees the text's content, the other only its metadata (language, source, stated
length). Both start from the same labelled rows. In each round each of them labels every other document
of which it is confident, and the other one learns from all of these, by Newton's steps: a step is one
pass over the documents' features, which adds up a gradient and a Hessian per view and class. In the
end both are calibrated on labelled rows that were held out, and a third, small model combines the
calibrated views. All documents are scored in one narrow pass.

Only the labelled rows are a bounded sample, those with the least hashes of their keys. Pseudo-labels
come from all documents without limit; those of a class weigh at most as much as its labelled rows, so
the model behaves alike at every size. What travels with the tasks, and what they add up, has a fixed
size. Features and weights are whole multiples of fixed steps, so sums do not depend on their order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topiclake.llm.columns import shield
from topiclake.llm.sampling import least_rows
from topiclake.llm.text import LOWER, SOLID, Words, slices
from topiclake.session import stage

# Labelled rows in the training sample, at most.
LABELLED = 6000
# Rounds of exchange, Newton's steps in each, and how sure a view must be.
ROUNDS = 3
STEPS = 3
SURE = 0.98
# Steps and limit of standardised features, steps of weights and residuals.
GRID, LIMIT = 64, 16
FINE = 1 << 16
WORD_BUCKETS = 256
SOURCE_BUCKETS = 64
# Share of good held-out rows that the threshold keeps.
KEEP = 0.998

_CLASSES = [
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "!?", "|", ".,;:'\"",
    "#*$%&<>@~^=+_\\", "\n", " ",
]
_TABLE = np.full(256, len(_CLASSES), np.uint8)
for _i, _c in enumerate(_CLASSES):
    _TABLE[[ord(c) for c in _c]] = _i


def text_view(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of features per text: shares of character classes, repetition, hashed words."""
    n = len(offsets) - 1
    texts = np.repeat(np.arange(n), np.diff(offsets))
    classes = np.bincount(texts * 10 + _TABLE[data], minlength=n * 10).reshape(n, 10)
    size = np.maximum(np.diff(offsets), 1)
    words = Words(LOWER[data], offsets, SOLID)
    hashes, owner, counts = words.hashes(), words.texts(), words.counts
    some = np.maximum(counts, 1)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    pairs = hashes ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(pairs, return_index=True)
    different = np.bincount(owner[first], minlength=n)
    lengths = np.bincount(owner, weights=words.ends - words.starts, minlength=n)
    columns = [
        classes / size[:, None],
        (lengths / some)[:, None],
        np.log1p(counts)[:, None],
        (np.bincount(owner, weights=same, minlength=n) / some)[:, None],
        # Vocabulary against what texts of that length have.
        (np.log1p(different) - 0.9 * np.log1p(counts))[:, None],
    ]
    buckets = np.bincount(
        owner * WORD_BUCKETS + (hashes >> np.uint64(56)).astype(np.int64) % WORD_BUCKETS,
        minlength=n * WORD_BUCKETS,
    ).reshape(n, WORD_BUCKETS)
    columns.append(np.sqrt(buckets / some[:, None]))
    return np.concatenate(columns, axis=1).astype(np.float16).astype(np.float32)


def meta_view(langs: list, sources: list, sizes: list, offsets: np.ndarray) -> np.ndarray:
    """A row of features per document: hashed language and source, stated length."""
    n = len(langs)
    out = np.zeros((n, 16 + SOURCE_BUCKETS + 20), np.float32)
    rows = np.arange(n)
    out[rows, [xxhash.xxh64_intdigest(f"{x}") % 16 for x in langs]] = 1
    out[rows, [16 + xxhash.xxh64_intdigest(f"{x}") % SOURCE_BUCKETS for x in sources]] = 1
    stated = np.array([-1.0 if x is None else float(x) for x in sizes])
    log = np.log1p(np.maximum(stated, 0))
    base = 16 + SOURCE_BUCKETS
    out[rows, base + np.clip(log, 0, 15).astype(int)] = 1
    out[:, base + 16] = stated < 0
    out[:, base + 17] = log
    actual = np.log1p(np.diff(offsets))
    out[:, base + 18] = np.where(stated < 0, 0, np.abs(actual - log))
    out[:, base + 19] = stated == 0
    return out.astype(np.float16).astype(np.float32)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Linear:
    """Logistic regression on standardised features, by Newton steps with a ridge."""

    ridge: float = 2.0
    mean: np.ndarray = field(default=None)
    scale: np.ndarray = field(default=None)
    weights: np.ndarray = field(default=None)

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 10) -> Linear:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))]).astype(float)
        penalty = np.full(z.shape[1], self.ridge)
        penalty[-1] = 1e-6
        w = np.zeros(z.shape[1])
        for _ in range(steps):
            p = sigmoid(z @ w)
            hessian = (z * np.maximum(p * (1 - p), 1e-4)[:, None]).T @ z + np.diag(penalty)
            move = np.linalg.solve(hessian, z.T @ (p - y) + penalty * w)
            w -= move
            if np.abs(move).max() < 1e-5:
                break
        self.weights = w
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]


@dataclass
class View:
    """Logistic regression on features standardised over all documents, limited and rounded."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    ridge: float = 2.0

    def standard(self, x: np.ndarray) -> np.ndarray:
        """Features and a one at the end."""
        z = np.clip(np.round((x - self.mean) / self.scale * GRID), -LIMIT * GRID, LIMIT * GRID) / GRID
        return np.hstack([z, np.ones((len(x), 1))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.standard(x) @ self.weights

    def terms(self, z: np.ndarray, y: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and Hessian of the loss at the weights, summed over rows."""
        p = sigmoid(z @ self.weights)
        curve = np.maximum(np.round(p * (1 - p) * 256), 1) / 256
        return (np.round((p - y) * FINE) / FINE) @ z, (z * curve[:, None]).T @ z

    def moved(self, gradient: np.ndarray, hessian: np.ndarray) -> View:
        """One step of Newton's; the last weight has no ridge."""
        penalty = np.append(np.full(len(self.mean), self.ridge), 1e-6)
        move = np.linalg.solve(hessian + np.diag(penalty), gradient + penalty * self.weights)
        weights = np.round(np.clip(self.weights - move, -60, 60) * FINE) / FINE
        return View(self.mean, self.scale, weights, self.ridge)


@dataclass
class Sums:
    """What one view gets from the pseudo-labels of one class."""

    rows: float
    gradient: np.ndarray
    hessian: np.ndarray


def _moments(x: np.ndarray) -> np.ndarray:
    """Sums of features and of their squares, in steps that add up exactly; the number of rows."""
    x = x.astype(float)
    return np.stack([np.full(x.shape[1], len(x)), np.round(x * 4096).sum(0), np.round(x * x * 4096).sum(0)])


def _exchange_sums(givers: list[View], learners: list[View], features: list[np.ndarray]) -> list[list[Sums]]:
    """For each view and class, the sums over the rows of which the other view is confident."""
    out = []
    for i in (0, 1):
        sure = sigmoid(givers[1 - i].logits(features[1 - i]))
        z = learners[i].standard(features[i])
        mine = []
        for label in (0, 1):
            picked = z[(sure if label else 1 - sure) >= SURE]
            mine.append(Sums(len(picked), *learners[i].terms(picked, label)))
        out.append(mine)
    return out


@dataclass
class Model:
    views: list[View]
    calibration: list[Linear]
    combined: Linear
    threshold: float
    handed: list[int] = field(default_factory=list)

    def calibrated(self, features: list[np.ndarray]) -> np.ndarray:
        """Log-odds of each view, calibrated."""
        return np.stack(
            [c.logits(v.logits(x)[:, None]) for v, c, x in zip(self.views, self.calibration, features)],
            axis=1,
        )

    def scores(self, features: list[np.ndarray]) -> np.ndarray:
        return sigmoid(self.combined.logits(np.clip(self.calibrated(features), -12, 12)))


def train(
    features: list[np.ndarray], labels: np.ndarray, held: np.ndarray, moments: list[np.ndarray], exchange,
    keep: float = KEEP,
) -> Model | None:
    """Train on labelled rows (0 and 1), of which the ``held`` ones calibrate, and on pseudo-labels.

    ``moments`` are those of all documents; ``exchange(givers, learners)`` returns the sums over the
    unlabelled ones. None if the rows to train or to calibrate on lack a label.
    """
    if any(len(set(labels[m].tolist())) < 2 for m in (~held, held)):
        return None
    views, given = [], []
    for x, (n, total, squares) in zip(features, moments):
        mean = total / 4096 / n
        scale = np.sqrt(np.maximum(squares / 4096 / n - mean * mean, 0)) + 1e-3
        view = View(mean, scale, np.zeros(len(mean) + 1))
        given.append(view.standard(x[~held]))
        views.append(view)
    y = labels[~held]
    sizes = [int((y == label).sum()) for label in (0, 1)]
    for i in (0, 1):
        for _ in range(10):
            views[i] = views[i].moved(*views[i].terms(given[i], y))
    handed = []
    for _ in range(ROUNDS):
        givers = views
        for _ in range(STEPS):
            found = exchange(givers, views)
            moved = []
            for view, z, mine in zip(views, given, found):
                gradient, hessian = view.terms(z, y)
                for size, sums in zip(sizes, mine):
                    weight = min(1.0, size / max(sums.rows, 1))
                    gradient, hessian = gradient + weight * sums.gradient, hessian + weight * sums.hessian
                moved.append(view.moved(gradient, hessian))
            views = moved
        handed.append(int(sum(sums.rows for mine in found for sums in mine)))
        if not handed[-1]:
            break
    y = labels[held]
    calibration = [
        Linear(ridge=1e-2).fit(v.logits(x[held])[:, None], y) for v, x in zip(views, features)
    ]
    model = Model(views, calibration, Linear(), 0.5, handed)
    odds = np.clip(model.calibrated([x[held] for x in features]), -12, 12)
    model.combined = Linear(ridge=1.0).fit(odds, y)
    good = np.sort(model.scores([x[held] for x in features])[y == 1])
    model.threshold = min(0.5, float(good[int((1 - keep) * len(good))]))
    return model


def cotrain(
    features: list[np.ndarray], labels: np.ndarray, held: np.ndarray, keep: float = KEEP
) -> Model | None:
    """Train on arrays; rows labelled -1 are the unlabelled ones."""
    free, known = labels < 0, labels >= 0
    others = [x[free] for x in features]
    return train(
        [x[known] for x in features], labels[known], held[known], [_moments(x) for x in features],
        lambda givers, learners: _exchange_sums(givers, learners, others), keep,
    )


def _array(column: pa.Array) -> np.ndarray:
    """Rows of features from a column of bytes."""
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), np.float16).reshape(len(parts), -1).astype(np.float32)


def _added(rows: DataFrame, add, width: int) -> dict[int, np.ndarray]:
    """Sums by slot of what ``add(features)`` gives for each batch of (content, meta).

    ``width`` is the length of the longest line of numbers. A task adds up its own batches, so it emits a table of fixed size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for slot, value in add([_array(batch.column(i)) for i in (0, 1)]):
                    held[slot] = held[slot] + value if slot in held else value
        for slot, value in held.items():
            lines = np.atleast_2d(value)
            yield pa.RecordBatch.from_pydict(
                {
                    "slot": pa.array(np.full(len(lines), slot, np.int32)),
                    "line": pa.array(np.arange(len(lines), dtype=np.int32)),
                    "total": pa.array(list(lines), pa.list_(pa.float64())),
                }
            )

    parts = rows.select("content", "meta").mapInArrow(run, "slot int, line int, total array<double>")
    # Plain sums: those of a summarizer go by way of means and are not exact.
    wide = [F.sum(F.get("total", F.lit(i))).alias(f"t{i}") for i in range(width)]
    sums = parts.groupBy("slot", "line").agg(*wide)
    found: dict[int, dict[int, np.ndarray]] = {}
    for row in sums.collect():
        values = [x for x in row[2:] if x is not None]
        found.setdefault(row.slot, {})[row.line] = np.array(values)
    return {slot: np.stack([lines[i] for i in range(len(lines))]) for slot, lines in found.items()}


def _exchange_on(rows: DataFrame):
    """``exchange`` of ``train`` over a table of features: one pass, four small tables of sums."""

    def exchange(givers: list[View], learners: list[View]) -> list[list[Sums]]:
        def add(features: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
            for i, mine in enumerate(_exchange_sums(givers, learners, features)):
                for label, sums in enumerate(mine):
                    size = np.full((len(sums.gradient), 1), sums.rows)
                    yield 2 * i + label, np.hstack([sums.hessian, sums.gradient[:, None], size])

        found = _added(rows, add, 2 + max(len(v.weights) for v in learners))
        out = []
        for i in (0, 1):
            width = len(learners[i].weights)
            none = np.zeros((width, width + 2))
            tables = [found.get(2 * i + label, none) for label in (0, 1)]
            out.append([Sums(float(t[0, -1]), t[:, -2], t[:, :-2]) for t in tables])
        return out

    return exchange


def _featured(df: DataFrame, keep: list[str], make, schema: str) -> DataFrame:
    """Apply ``make(rows, features)`` to the slices of (keep, _lang, _source, _size, _text)."""
    first = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "_text"):
                meta = meta_view(*(rows.column(first + i).to_pylist() for i in range(3)), offsets)
                yield make(rows, [text_view(data, offsets), meta])

    return df.mapInArrow(run, schema)


def _documents(df: DataFrame, key: str, text: str, lang: str, source: str, size: str) -> DataFrame:
    return df.select(
        F.col(key).alias("_id"), F.col(lang).alias("_lang"), F.col(source).alias("_source"),
        F.col(size).alias("_size"), F.col(text).alias("_text"),
    )


def _feature_rows(rows: pa.RecordBatch, features: list[np.ndarray]) -> pa.RecordBatch:
    found = [pa.array([v.tobytes() for v in x.astype(np.float16)], pa.binary()) for x in features]
    return pa.RecordBatch.from_arrays(
        [rows.column(0), rows.column(1), *found], ["label", "order", "content", "meta"]
    )


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", text: str = "text",
    lang: str = "lang", source: str = "source", size: str = "n_chars",
    labelled: int = LABELLED, unlabelled: int | None = None, keep: float = KEEP,
) -> Model | None:
    """Train on a sample of the labelled documents and on all others; three labelled of ten are held out.

    Labels without a key, or null ones, are not used; of conflicting labels of a key the lower counts, of
    several rows of a sampled key the least. Every other row, also without a key, with an empty text or
    repeated, is an unlabelled document; ``unlabelled`` limits these to that many keys on request.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull())
    known = known.groupBy(F.col(key).alias("_id")).agg(F.min(label).cast("int").alias("_label"))
    order = F.md5(F.col("_id").cast("string"))
    chosen = stage(least_rows(known, F.xxhash64(order), labelled), "labelled")
    every = _documents(docs, key, text, lang, source, size)
    # One row for each key and label, the least one.
    least = F.min(F.struct("_lang", "_source", "_size", "_text")).alias("d")
    picked = every.join(F.broadcast(chosen), "_id").groupBy("_id", "_label").agg(least)
    picked = picked.select("_label", order.alias("_order"), "d.*")
    schema = "label int, order string, content binary, meta binary"
    rows = _featured(picked, ["_label", "_order"], _feature_rows, schema).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.order, r.content, r.meta))
    features = [_array(pa.array([bytes(r[i]) for r in rows])) for i in (2, 3)]
    found = np.array([r.label for r in rows])
    held = np.array([int(r.order[-8:], 16) % 10 < 3 for r in rows])
    if any(len(set(found[m].tolist())) < 2 for m in (~held, held)):
        return None
    rest = every.join(F.broadcast(chosen.select("_id")), "_id", "left_anti")
    if unlabelled is not None:
        keys = least_rows(rest.select("_id").filter("_id is not null"), F.xxhash64(order), unlabelled)
        rest = rest.join(F.broadcast(keys.distinct()), "_id", "left_semi")
    rest = rest.select(F.lit(-1).alias("_label"), order.alias("_order"), "_lang", "_source", "_size", "_text")
    rest = stage(_featured(rest, ["_label", "_order"], _feature_rows, schema).select("content", "meta"), "features")
    widest = max(x.shape[1] for x in features)
    sums = _added(rest, lambda features: enumerate(_moments(x) for x in features), widest)
    moments = [_moments(x) + sums.get(i, 0) for i, x in enumerate(features)]
    return train(features, found, held, moments, _exchange_on(rest), keep)


def score(
    docs: DataFrame, model: Model | None, keep: list[str], text: str = "text", lang: str = "lang",
    source: str = "source", size: str = "n_chars",
) -> DataFrame:
    """``keep`` and content, meta and combined scores (0 to 1, 1 is good), and ``kept``.

    One row out per row in. Null and empty texts are scored as texts without words, null metadata as
    a value of its own. Without a model all scores are null and all rows are kept.
    """
    columns = docs.select(
        *keep, docs[lang].alias("_lang"), docs[source].alias("_source"), docs[size].alias("_size"),
        docs[text].alias("_text"),
    )
    names = ["content_score", "meta_score", "score", "kept"]

    def make(rows: pa.RecordBatch, features: list[np.ndarray]) -> pa.RecordBatch:
        if model is None:
            found = [pa.nulls(rows.num_rows, pa.float64())] * 3 + [pa.array([True] * rows.num_rows)]
        else:
            each = sigmoid(model.calibrated(features))
            total = model.scores(features)
            found = [pa.array(v.astype(float)) for v in (each[:, 0], each[:, 1], total)]
            found.append(pa.array(total >= model.threshold))
        return pa.RecordBatch.from_arrays(
            [*(rows.column(i) for i in range(len(keep))), *found], [*keep, *names]
        )

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema.fields[: len(keep)]]
    schema += ["content_score double, meta_score double, score double, kept boolean"]
    return _featured(columns, keep, make, ", ".join(schema))


def keep_good(
    docs: DataFrame, model: Model | None, text: str = "text", lang: str = "lang", source: str = "source",
    size: str = "n_chars",
) -> DataFrame:
    """The rows of ``docs`` that the model does not reject."""
    if model is None:
        return docs
    docs, restore = shield(docs, text, lang, source, size)
    at = [docs.columns.index(c) for c in (lang, source, size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, text):
                meta = meta_view(*(rows.column(i).to_pylist() for i in at), offsets)
                good = model.scores([text_view(data, offsets), meta]) >= model.threshold
                yield rows.filter(pa.array(good))

    return restore(docs.mapInArrow(run, docs.schema))
