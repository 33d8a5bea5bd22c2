"""Secret scan: fixed rules, and a character convolutional network over all other candidates.

Rules find assignments, access keys and hexadecimal strings. Candidates of the network are all long
runs of key characters, plain words among them, each seen in a window with its surroundings. The
network is trained on labelled findings: what the precise rules call a secret against other runs of
the same documents, and random keys of several alphabets and lengths put in the place of plain runs, so that
it learns keys which no rule names. It starts from a bounded sample of the findings and then learns from all of
them: each part of the table trains it in a task, and the weights that come out are averaged. Scores are calibrated
on all findings that were held out, and the threshold is the highest that still keeps the asked-for recall there.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topiclake.llm.columns import shield
from topiclake.llm.sampling import least_rows
from topiclake.llm.text import LOWER, Words, slices
from topiclake.session import stage

# The rules.
ASSIGN = re.compile(
    r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
KEYWORDS = re.compile(rb"passw(?:or)?d|secret|token|api_?key")
KINDS = ["assign", "access", "hex", "network"]
LEAST = {"assign": 12, "access": 18, "hex": 16, "network": 12}

# Characters of a window: before the candidate, its head and its tail, and after it.
BEFORE, HEAD, TAIL, AFTER = 24, 32, 16, 12
WINDOW = BEFORE + HEAD + TAIL + AFTER
SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
# Findings of each label that the first weights are learnt from, at most, with digits and without.
SAMPLE = 1500
# Findings of a part, which trains the network in one task; steps of it, in shares of the first weights' steps; and the
# unit of the weights that are added up, as whole numbers.
PART, SLOWER, UNIT = 20_000, 0.2, 2.0**-32
# Bins of a count that narrows a rank, and rows that are few enough to be sorted.
BINS, FEW = 1000, 10_000
RECALL = 0.95
# Random keys that are added to the labelled findings, at most.
MADE = 3000


def _table(characters: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in characters]] = True
    return table


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGITS = "0123456789"
# Characters of the random keys.
ALPHABETS = [
    _UPPER + _UPPER.lower() + _DIGITS, _UPPER.lower() + _DIGITS, _UPPER + _DIGITS,
    _UPPER + _UPPER.lower() + _DIGITS + "+/", _UPPER + _UPPER.lower() + _DIGITS + "_-", _DIGITS + "abcdef",
    _DIGITS + "ABCDEF", _UPPER + _UPPER.lower(),
]
HEX = _table(_DIGITS + "abcdef")
ACCESS = _table(_UPPER + _DIGITS)
KEY = _table(_UPPER + _UPPER.lower() + _DIGITS + "+/_.=-")
NUMBER = _table(_DIGITS)


def rule_spans(data: np.ndarray, offsets: np.ndarray, points: np.ndarray) -> list[tuple]:
    """(text, start, kind, end) of the rules' findings, sorted; ``points`` counts code points before
    each byte. Runs of one class are maximal, so long enough runs are the rule's matches."""
    out = []
    words = Words(data, offsets, HEX)
    long = np.flatnonzero(words.ends - words.starts >= LEAST["hex"])
    out += _spans(words, long, points, offsets, 2)
    words = Words(data, offsets, ACCESS)
    texts = words.texts()
    for i in np.flatnonzero(words.ends - words.starts >= LEAST["access"]):
        at = data[words.starts[i] : words.ends[i]].tobytes().find(b"AKIA")
        start = words.starts[i] + at
        if at >= 0 and words.ends[i] - start >= LEAST["access"]:
            t = int(texts[i])
            base = points[offsets[t]]
            out.append((t, int(points[start] - base), 1, int(points[words.ends[i]] - base)))
    lower = LOWER[data].tobytes()
    hits = np.fromiter((m.start() for m in KEYWORDS.finditer(lower)), np.int64)
    for t in np.unique(np.searchsorted(offsets, hits, "right") - 1).tolist():
        text = data[offsets[t] : offsets[t + 1]].tobytes().decode("utf-8", "replace")
        for m in ASSIGN.finditer(text):
            if len(m.group(2)) >= LEAST["assign"]:
                out.append((t, m.start(), 0, m.end()))
    return sorted(out)


def _spans(words: Words, chosen: np.ndarray, points: np.ndarray, offsets: np.ndarray, kind: int) -> list[tuple]:
    texts = words.texts()[chosen]
    base = points[offsets[texts]]
    starts, ends = points[words.starts[chosen]] - base, points[words.ends[chosen]] - base
    return [(t, s, kind, e) for t, s, e in zip(texts.tolist(), starts.tolist(), ends.tolist())]


def code_points_before(data: np.ndarray) -> np.ndarray:
    """Code points before each byte, and before the end."""
    return np.append(0, np.cumsum((data & 0xC0) != 0x80))


def candidates(data: np.ndarray, offsets: np.ndarray, points: np.ndarray) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """Long runs of key characters: spans, and their bytes' bounds."""
    words = Words(data, offsets, KEY)
    chosen = np.flatnonzero(words.ends - words.starts >= LEAST["network"])
    return _spans(words, chosen, points, offsets, 3), words.starts[chosen], words.ends[chosen]


def windows(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A window of bytes per candidate; 0 where there is no text, bytes beyond ASCII are 127."""
    texts = np.searchsorted(offsets, starts, "right") - 1
    low, high = offsets[texts], offsets[texts + 1]
    head_end = np.minimum(ends, starts + HEAD)
    tail_start = np.maximum(head_end, ends - TAIL)
    parts = []
    for begin, size, least, most in (
        (starts - BEFORE, BEFORE, low, starts), (starts, HEAD, starts, head_end),
        (ends - TAIL, TAIL, tail_start, ends), (ends, AFTER, ends, high),
    ):
        at = begin[:, None] + np.arange(size)
        inside = (at >= least[:, None]) & (at < most[:, None])
        parts.append(np.where(inside, data[np.clip(at, 0, max(len(data) - 1, 0))], 0))
    return np.minimum(np.concatenate(parts, axis=1), 127).astype(np.uint8)


@dataclass
class Network:
    """Embedding, one convolution, maximum over positions, one linear unit; and its calibration."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: np.ndarray
    slope: float = 1.0
    intercept: float = 0.0
    threshold: float = 2.0

    WIDTH = 5

    @classmethod
    def new(cls, seed: int = 7, dims: int = 8, filters: int = 24) -> Network:
        rng = np.random.default_rng(seed)
        return cls(
            rng.normal(0, 0.5, (128, dims)).astype(np.float32),
            rng.normal(0, 0.2, ((dims + 1) * cls.WIDTH, filters)).astype(np.float32),
            np.zeros(filters, np.float32),
            rng.normal(0, 0.3, filters).astype(np.float32),
            np.zeros(1, np.float32),
        )

    def _unfold(self, x: np.ndarray) -> np.ndarray:
        marks = np.zeros((WINDOW, 1), np.float32)
        marks[BEFORE : BEFORE + HEAD + TAIL] = 1
        e = np.concatenate([self.embed[x], np.broadcast_to(marks, (len(x), WINDOW, 1))], axis=2)
        size = WINDOW - self.WIDTH + 1
        return np.concatenate([e[:, i : i + size] for i in range(self.WIDTH)], axis=2)

    def logits(self, x: np.ndarray, step: int = 2048) -> np.ndarray:
        parts = [np.zeros(0, np.float32)]
        for i in range(0, len(x), step):
            top = (self._unfold(x[i : i + step]) @ self.filters).max(axis=1) + self.bias
            parts.append(np.maximum(top, 0) @ self.out + self.shift[0])
        return np.concatenate(parts)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self.scores(self.logits(x))

    def scores(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logits + self.intercept, -30, 30)))

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.out, self.shift]

    def with_weights(self, flat: np.ndarray) -> Network:
        """A network with these weights, all in a row."""
        parts = np.split(np.asarray(flat, np.float32), np.cumsum([w.size for w in self.weights()])[:-1])
        return Network(*(p.reshape(w.shape).copy() for p, w in zip(parts, self.weights())))

    def fit(
        self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64, seed: int = 11,
        each: np.ndarray | None = None, slower: float = 1.0,
    ) -> None:
        """Adam on the logistic loss; of half the windows the surroundings are blanked.

        Both labels weigh the same together, or rows as much as ``each`` says.
        """
        rng = np.random.default_rng(seed)
        weights = self.weights()
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
        if each is None:
            each = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                rows = order[i : i + batch]
                seen, label = x[rows].copy(), y[rows]
                bare = rng.random(len(rows)) < 0.5
                seen[bare, :BEFORE] = 0
                seen[bare, BEFORE + HEAD + TAIL :] = 0
                step += 1
                gradients = self._gradients(seen, label, each[rows])
                for w, g, (m, v) in zip(weights, gradients, moments):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= 0.01 * slower * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def _gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        folded = self._unfold(x)
        each = folded @ self.filters
        best = each.argmax(axis=1)
        top = np.take_along_axis(each, best[:, None], axis=1)[:, 0] + self.bias
        active = np.maximum(top, 0)
        p = 1 / (1 + np.exp(-np.clip(active @ self.out + self.shift[0], -30, 30)))
        error = ((p - y) * weight / len(x)).astype(np.float32)
        d_top = error[:, None] * self.out * (top > 0)
        picked = folded[np.arange(len(x))[:, None], best]  # batch, filter, folded
        d_filters = np.einsum("bf,bfk->kf", d_top, picked)
        d_folded = d_top[:, :, None] * self.filters.T[None]
        dims = self.embed.shape[1]
        d_embed = np.zeros_like(self.embed)
        parts = d_folded.reshape(len(x), -1, self.WIDTH, dims + 1)[..., :dims]
        places = best[:, :, None] + np.arange(self.WIDTH)
        np.add.at(d_embed, x[np.arange(len(x))[:, None, None], places], parts)
        return [d_embed, d_filters, d_top.sum(axis=0), (error[:, None] * active).sum(axis=0), error.sum(keepdims=True)]

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float) -> None:
        """Platt scaling by Newton steps from zero, then the highest threshold with the recall."""
        z = self.logits(x).astype(float)
        n1, n0 = y.sum(), len(y) - y.sum()
        target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        middle, scale = z.mean(), z.std() + 1e-6
        design = np.stack([(z - middle) / scale, np.ones_like(z)], axis=1)

        def sums(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-np.clip(design @ a, -30, 30)))
            # A floor on the curvature keeps steps small where scores are saturated.
            curve = np.maximum(p * (1 - p), 1e-3)
            return design.T @ (design * curve[:, None]), design.T @ (p - target)

        self._scaled(sums, middle, scale)
        found = np.sort(z[y == 1])
        self._keep(float(found[self._place(len(found), recall)]))

    def _place(self, n: int, recall: float) -> int:
        """Which of n logits, in ascending order, is that of the threshold; the lowest score has the lowest, or, where
        scores fall, the highest."""
        missed = int((1 - recall) * n + 1e-9)
        return missed if self.slope >= 0 else n - 1 - missed

    def _keep(self, logit: float) -> None:
        """The threshold is the score of this logit. Sums differ in their last digits with the rows they are taken
        with, so it lies a little below, as much as single precision tells apart."""
        below = logit - np.copysign(1e-5 * max(1.0, abs(logit)), self.slope)
        self.threshold = float(self.scores(np.array([below], np.float32))[0])

    def _scaled(self, sums: Callable, middle: float, scale: float, least: float = 0.0) -> None:
        """Newton's steps from zero with the sums (curvature, slope) that the held-out findings give, until a step
        is no longer than ``least``."""
        a = np.zeros(2)
        for _ in range(50):
            curvature, slope = sums(a)
            step = np.linalg.solve(curvature + 1e-3 * np.eye(2), slope + 1e-3 * a)
            a = a - step
            if np.abs(step).max() <= least:
                break
        self.slope = float(a[0] / scale)
        self.intercept = float(a[1] - a[0] * middle / scale)


def train(x: np.ndarray, y: np.ndarray, held: np.ndarray, recall: float = RECALL) -> Network | None:
    """A network from labelled windows; None if a label is missing in training or held-out findings."""
    for part in (held, ~held):
        if len(set(y[part].tolist())) < 2:
            return None
    network = Network.new()
    network.fit(x[~held], y[~held])
    network.calibrate(x[held], y[held], recall)
    return network


def made_findings(plain: np.ndarray, count: int, seed: int = 5) -> np.ndarray:
    """Windows of random keys: of plain windows the run is replaced, the surroundings stay."""
    rng = np.random.default_rng(seed)
    out = plain[rng.integers(0, len(plain), count)].copy()
    for row in out:
        characters = np.frombuffer(ALPHABETS[rng.integers(len(ALPHABETS))].encode(), np.uint8)
        key = rng.choice(characters, rng.integers(LEAST["network"], HEAD + TAIL + 1))
        tail = key[HEAD:]
        row[BEFORE : BEFORE + HEAD + TAIL] = 0
        row[BEFORE : BEFORE + min(len(key), HEAD)] = key[:HEAD]
        row[BEFORE + HEAD + TAIL - len(tail) : BEFORE + HEAD + TAIL] = tail
    return out


def in_capitals(plain: np.ndarray, count: int, seed: int = 5) -> np.ndarray:
    """Plain windows with their runs in capitals, which are no keys either."""
    rng = np.random.default_rng(seed)
    out = plain[rng.integers(0, len(plain), count)].copy()
    run = out[:, BEFORE : BEFORE + HEAD + TAIL]
    run[(run >= ord("a")) & (run <= ord("z"))] -= 32
    return out


def _overlaps(spans: list[tuple], found: list[tuple]) -> np.ndarray:
    """Whether each candidate overlaps a finding; both are sorted by text and start."""
    out = np.zeros(len(spans), bool)
    j = 0
    for i, (t, s, _, e) in enumerate(spans):
        while j < len(found) and (found[j][0], found[j][3]) <= (t, s):
            j += 1
        k = j
        while k < len(found) and found[k][0] == t and found[k][1] < e:
            if found[k][3] > s:
                out[i] = True
                break
            k += 1
    return out


def labelled_findings(df: DataFrame, text: str = "text") -> DataFrame:
    """(window, label, digit): candidates inside assignments and access keys are secrets, those in no
    finding of letters are not; ``digit`` tells whether there is one. Equal windows count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in slices(batch, text):
                points = code_points_before(data)
                found = rule_spans(data, offsets, points)
                spans, starts, ends = candidates(data, offsets, points)
                sure = _overlaps(spans, [f for f in found if f[2] < 2])
                unsure = _overlaps(spans, [f for f in found if f[2] == 2]) & ~sure
                # Runs of digits alone are numbers; other hexadecimal strings may be either.
                digits = np.append(0, np.cumsum(NUMBER[data]))
                unsure &= digits[ends] - digits[starts] < ends - starts
                some = digits[ends] > digits[starts]
                seen = windows(data, offsets, starts, ends)[~unsure]
                yield pa.RecordBatch.from_pydict(
                    {
                        "window": [w.tobytes() for w in seen], "label": sure[~unsure].astype(np.int32),
                        "digit": some[~unsure],
                    },
                    schema=pa.schema([("window", pa.binary()), ("label", pa.int32()), ("digit", pa.bool_())]),
                )

    return df.select(text).mapInArrow(run, "window binary, label int, digit boolean").distinct()


def _seen(windows: Iterator) -> np.ndarray:
    return np.stack([np.frombuffer(bytes(w), np.uint8) for w in windows])


def fit(
    df: DataFrame, text: str = "text", sample: int = SAMPLE, recall: float = RECALL, made: int = MADE
) -> Network | None:
    """Train on all findings, from weights of at most ``sample`` of each label with digits and without, those with
    the least hashes; where a count finds no more than these, they are all.

    A finding whose digest ends in one of three of ten ways is held out for calibration. ``made`` random keys
    stand in surroundings of plain runs of the same part, training or held out; half as many plain runs are
    added in capitals.
    """
    tenth = F.conv(F.substring(F.md5("window"), 25, 8), 16, 10).cast("long") % 10
    findings = stage(labelled_findings(df, text).withColumn("held", tenth < 3), "findings")
    rows, more = [], False
    for label in (0, 1):
        for digit in (False, True):
            of_kind = findings.filter((F.col("label") == label) & (F.col("digit") == digit))
            chosen = least_rows(of_kind, F.xxhash64("window"), sample)
            found = chosen.withColumn("order", F.md5("window")).collect()
            more = more or len(found) >= sample
            rows += found
    if not rows:
        return None
    rows.sort(key=lambda r: (r.label, r.order))
    x = _seen(r.window for r in rows)
    held = np.array([r.held for r in rows])
    y = np.array([r.label for r in rows])
    for part, count in ((False, made - made * 3 // 10), (True, made * 3 // 10)):
        plain = x[: len(rows)][(y[: len(rows)] == 0) & (held[: len(rows)] == part)]
        if len(plain) and count:
            keys, words = made_findings(plain, count, 5 + part), in_capitals(plain, count // 2, 5 + part)
            x = np.concatenate([x, keys, words])
            y = np.concatenate([y, np.ones(len(keys), y.dtype), np.zeros(len(words), y.dtype)])
            held = np.concatenate([held, np.full(len(keys) + len(words), part)])
    network = train(x, y, held, recall)
    if network is None or not more:
        return network
    of = np.arange(len(x)) >= len(rows)
    network = _trained_by_all(findings.filter("not held"), network, x[of & ~held], y[of & ~held], sample)
    _calibrate_by_all(findings.filter("held"), network, x[of & held], y[of & held], recall)
    return network


def _trained_by_all(findings: DataFrame, network: Network, x: np.ndarray, y: np.ndarray, sample: int) -> Network:
    """The network after one more pass of all findings, in parts by hash, with the findings ``x`` in each part.

    A part starts from the given weights and takes the steps of its findings; the weights of all parts are
    averaged, as whole numbers, so that their order does not matter. In a part both labels weigh the same, and
    within a label findings with digits, those without and ``x`` as in the first weights' sample.
    """
    counts = {(r.label, r.digit): r["count"] for r in findings.groupBy("label", "digit").count().collect()}
    parts = math.ceil(sum(counts.values()) / PART)
    start = np.concatenate([w.ravel() for w in network.weights()])
    most = 0.7 * sample  # of a sample, three of ten are held out

    def work(table: pa.Table) -> pa.Table:
        seen = _seen(w.as_buffer() for w in table.column("window"))
        order = np.argsort(seen.view(f"S{seen.shape[1]}").ravel(), kind="stable")
        label = table.column("label").to_numpy()[order]
        digit = table.column("digit").to_numpy(zero_copy_only=False)[order].astype(int)
        every, labels = np.concatenate([seen[order], x]), np.concatenate([label, y])
        kind = 3 * labels + np.concatenate([digit, np.full(len(x), 2)])
        each = np.zeros(len(every))
        for k in np.unique(kind):
            n = int((kind == k).sum())
            each[kind == k] = (n if k % 3 == 2 else min(counts[k // 3, k % 3 == 1], most)) / n
        for one in (0, 1):
            each[labels == one] *= 0.5 * len(every) / max(each[labels == one].sum(), 1e-9)
        mine = network.with_weights(start)
        mine.fit(every, labels, 1, seed=table.column("part")[0].as_py(), each=each, slower=SLOWER)
        flat = np.concatenate([w.ravel() for w in mine.weights()]).astype(float)
        return pa.table({
            "n": pa.array([len(seen)], pa.int64()),
            "w": pa.array([np.rint(flat * len(seen) / UNIT).astype(np.int64)], pa.list_(pa.int64())),
        })

    dealt = findings.withColumn("part", F.pmod(F.xxhash64(F.lit(3), "window"), F.lit(parts)))
    trained = dealt.repartition(min(2 * parts, 20_000), "part").groupBy("part").applyInArrow(work, "n long, w array<long>")
    added = trained.select("n", F.posexplode("w").alias("at", "w")).groupBy("at").agg(
        F.sum("n").alias("n"), F.sum(F.col("w").cast("decimal(38,0)")).alias("w")
    )
    rows = sorted(added.collect(), key=lambda r: r.at)  # one row per weight
    return network.with_weights(np.array([float(r.w) * UNIT / r.n for r in rows]))


def _calibrate_by_all(findings: DataFrame, network: Network, x: np.ndarray, y: np.ndarray, recall: float) -> None:
    """``Network.calibrate`` on all held-out findings and ``x``; only sums, counts and a few logits leave the tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                z = network.logits(_seen(w.as_buffer() for w in batch.column(0))).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array(z), batch.column(1)], ["z", "label"])

    spark = findings.sparkSession
    own = spark.createDataFrame(
        [(float(z), int(one)) for z, one in zip(network.logits(x), y)], "z double, label int"
    )
    logits = stage(findings.select("window", "label").mapInArrow(run, "z double, label int").unionByName(own), "logits")
    n1, n0, middle, spread = logits.agg(
        F.sum("label"), F.sum(1 - F.col("label")), F.avg("z"), F.stddev_pop("z")
    ).first()
    scale = spread + 1e-6

    def sums(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u = (F.col("z") - middle) / scale
        score = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), u * float(a[0]) + float(a[1])))
        p = 1 / (1 + F.exp(-score))
        target = F.when(F.col("label") == 1, float((n1 + 1) / (n1 + 2))).otherwise(float(1 / (n0 + 2)))
        row = logits.select(u.alias("u"), F.greatest(p * (1 - p), F.lit(1e-3)).alias("c"), (p - target).alias("e")).agg(
            *[F.sum(F.expr(e)) for e in ("u * u * c", "u * c", "c", "u * e", "e")]
        ).first()
        return np.array([[row[0], row[1]], [row[1], row[2]]]), np.array([row[3], row[4]])

    network._scaled(sums, middle, scale, 1e-9)
    logit = _ranked(logits.filter("label = 1").select("z"), network._place(n1, recall))
    network._keep(logit)


def _ranked(values: DataFrame, place: int) -> float:
    """The value ``z`` at this place of all in ascending order; counts narrow it down until few are sorted."""
    while True:
        n, low, high = values.agg(F.count("*"), F.min("z"), F.max("z")).first()
        if n <= FEW or low == high:
            return sorted(r.z for r in values.collect())[place] if n <= FEW else low
        # Bounds of a bin are among the values, so that every step leaves some out.
        bins = values.groupBy(F.floor((F.col("z") - low) / ((high - low) / BINS)).alias("bin")).agg(
            F.count("*").alias("n"), F.min("z").alias("low"), F.max("z").alias("high")
        )
        for r in sorted(bins.collect(), key=lambda r: r.bin):  # BINS + 1 rows
            if place < r.n:
                values = values.filter(F.col("z").between(r.low, r.high))
                break
            place -= r.n


def _found(batch: pa.RecordBatch, text: str, network: Network | None) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of a batch with the sorted findings of each row."""
    for rows, data, offsets in slices(batch, text):
        points = code_points_before(data)
        found = rule_spans(data, offsets, points)
        if network is not None:
            spans, starts, ends = candidates(data, offsets, points)
            scores = network.probabilities(windows(data, offsets, starts, ends))
            good = (scores >= network.threshold) & ~_overlaps(spans, found)
            found = sorted(found + [spans[i] for i in np.flatnonzero(good)])
        lists: list[list] = [[] for _ in range(rows.num_rows)]
        for t, s, k, e in found:
            lists[t].append({"kind": KINDS[k], "start": s, "end": e})
        yield rows, lists


def find_secrets(df: DataFrame, keep: list[str], text: str, network: Network | None) -> DataFrame:
    """``keep`` and ``spans``: array of (kind, start, end), sorted by start and kind.

    Starts and ends are code points, the end exclusive. Rule findings are always there; candidates
    of the network are added where they overlap none and score at least the threshold. Null and empty
    texts have no spans; rows are independent, texts are scanned whole.
    """
    picked = df.select(*keep, df[text].alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, lists in _found(batch, "_text", network):
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(i) for i in range(len(keep))), pa.array(lists, SPANS)], [*keep, "spans"]
                )

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema if f.name != "_text"]
    schema.append("spans array<struct<kind: string, start: bigint, end: bigint>>")
    return picked.mapInArrow(run, ", ".join(schema))


def redact(text: str | None, spans: list, mark: str = "[SECRET]") -> str | None:
    """The text with every span, overlapping ones as one, replaced by the mark."""
    if not spans:
        return text
    out, end = [], 0
    for span in sorted(spans, key=lambda s: (s["start"], s["end"])):
        if span["start"] >= end:
            out += [text[end : span["start"]], mark]
        end = max(end, span["end"])
    return "".join([*out, text[end:]])


def redact_all(df: DataFrame, text: str, network: Network | None) -> DataFrame:
    """The rows with their secrets replaced in ``text``; all other columns as they are."""
    df, restore = shield(df, text)
    columns = df.columns
    at = columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, lists in _found(batch, text, network):
                # Only rows with findings are written anew.
                some = [i for i, spans in enumerate(lists) if spans]
                kept = list(rows.columns)
                if some:
                    texts = kept[at].to_pylist()
                    for i in some:
                        texts[i] = redact(texts[i], lists[i])
                    kept[at] = pa.array(texts, rows.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(kept, columns)

    return restore(df.mapInArrow(run, df.schema))
