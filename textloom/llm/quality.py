"""Document quality by Bradley-Terry ranking over preference pairs.

A document's features are shares of byte pairs (hashed to 1,024 bins), shares of the 512 runs of three character classes,
and some measures of words and lines. From documents that the labels prefer and documents that they don't, pairs are
drawn with a fixed seed; the weights minimise the logistic loss of the pair's feature difference, log(1 + exp(-w(x - y))).
The cut is a quantile of the training scores, the one at which the labels agree best; the score is a logistic curve of
the ranking score that passes 0.7 at the cut.

Defined cases: null and empty texts have all features 0 and get the score that this gives. Rows without a label (or with
a null label) teach nothing; without labels of both kinds every score is 0.5. Repeated rows score alike. Nothing but the
text enters a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._common import arrow_map, ship, slices, tidy
from textloom.llm.words import U, mix, shingles_of, text_bytes, words_of

PAIRS, CLASSES, MEASURES = 1024, 512, 13
WIDTH = PAIRS + CLASSES + MEASURES
#: Labelled rows that the fit reads at most; of more, those whose hashed id is smallest, also where ids repeat.
SAMPLE = 6000
#: Character classes of bytes: lower, upper, digit, blank, line end, stop, other ASCII sign, non-ASCII.
_CLASS = np.full(256, 6, np.int64)
for _lo, _hi, _c in ((97, 123, 0), (65, 91, 1), (48, 58, 2), (32, 33, 3), (9, 10, 3), (10, 11, 4), (13, 14, 4), (128, 256, 7)):
    _CLASS[_lo:_hi] = _c
for _b in b".,;:?'":
    _CLASS[_b] = 5


def _distinct(unit: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of each unit."""
    key = np.sort((unit.astype(U) << U(44)) | (mix(h) >> U(20)))
    first = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return np.bincount((first >> U(44)).astype(np.int64), minlength=n)


def features(column: pa.Array) -> np.ndarray:
    """A row of WIDTH features for each text."""
    n = len(column)
    data, off = text_bytes(column, lower=False)
    size = np.diff(off)
    out = np.zeros((n, WIDTH), np.float32)
    if not len(data):
        return out
    unit = np.repeat(np.arange(n), size)
    full = np.maximum(size, 1)[:, None]
    same = unit[1:] == unit[:-1]
    pair = (((data[:-1].astype(np.uint32) << 8 | data[1:]) * np.uint32(2654435761)) >> np.uint32(22)).astype(np.int64)
    out[:, :PAIRS] = np.sqrt(np.bincount((unit[1:] * PAIRS + pair)[same], minlength=n * PAIRS).reshape(n, PAIRS) / full)
    kind = _CLASS[data]
    if len(data) > 2:
        run = kind[:-2] * 64 + kind[1:-1] * 8 + kind[2:]
        out[:, PAIRS : PAIRS + CLASSES] = np.sqrt(np.bincount((unit[2:] * CLASSES + run)[unit[2:] == unit[:-2]], minlength=n * CLASSES).reshape(n, CLASSES) / full)
    m = out[:, PAIRS + CLASSES :]
    shares = np.bincount(unit * 8 + kind, minlength=n * 8).reshape(n, 8) / full
    w = words_of(*text_bytes(column))
    words = np.diff(w.ptr)
    many = np.maximum(words, 1)
    own = w.unit()
    sh, su = shingles_of(w)
    lines = 1 + np.bincount(unit[data == 10], minlength=n)
    letters = shares[:, 0] + shares[:, 1] + shares[:, 7]
    m[:, 0] = np.log1p(size) / 10
    m[:, 1] = np.log1p(words) / 10
    m[:, 2] = np.log1p(np.bincount(own, weights=w.end - w.start, minlength=n) / many) / 3
    m[:, 3] = _distinct(own, w.hash, n) / many
    m[:, 4] = _distinct(su, sh, n) / np.maximum(np.bincount(su, minlength=n), 1)
    m[:, 5] = shares[:, 1] / np.maximum(letters, 0.01)
    m[:, 6] = shares[:, 6]
    m[:, 7] = shares[:, 2]
    m[:, 8] = np.log1p(size / lines) / 10
    m[:, 9] = shares[:, 5]
    m[:, 10] = shares[:, 6] / np.maximum(words / np.maximum(size, 1), 0.01)
    m[:, 11] = size > 0
    m[:, 12] = np.bincount(own[1:][(w.hash[1:] == w.hash[:-1]) & (own[1:] == own[:-1])], minlength=n) / many
    return out


@dataclass
class Model:
    weight: np.ndarray
    shift: float
    slope: float
    cut: float

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = x.astype(np.float64) @ self.weight - self.shift
        return 1 / (1 + np.exp(-np.clip(self.slope * (raw - self.cut) + np.log(0.7 / 0.3), -30, 30)))


def neutral(width: int = WIDTH) -> Model:
    """0.5 for every text."""
    return Model(np.zeros(width), 0.0, 1.0, float(np.log(0.7 / 0.3)))


def fit_pairs(x: np.ndarray, y: np.ndarray, rounds: int = 300, batch: int = 4096, decay: float = 3e-4, seed: int = 7) -> Model:
    """Weights from preference pairs (a row with label 1 over a row with label 0) by Adam on the pairs' logistic loss."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return neutral(x.shape[1])
    mean, dev = x.mean(0, dtype=np.float64), x.std(0, dtype=np.float64)
    scale = np.where(dev > 1e-4, 1 / np.maximum(dev, 1e-4), 0) * 0.2
    z = ((x - mean) * scale).astype(np.float32)
    rng = np.random.default_rng(seed)
    w, m, v = (np.zeros(x.shape[1]) for _ in range(3))
    for t in range(1, rounds + 1):
        a, b = rng.choice(good, batch), rng.choice(bad, batch)
        # The difference's gradient, gathered by row: sum over pairs of -sigmoid(-margin) * (z[a] - z[b]).
        s = z @ w.astype(np.float32)
        g = 1 / (1 + np.exp(np.clip(s[a] - s[b], -30, 30)))
        by_row = np.bincount(a, weights=g, minlength=len(z)) - np.bincount(b, weights=g, minlength=len(z))
        grad = -(by_row.astype(np.float32) @ z) / batch + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    s = (z @ w.astype(np.float32)).astype(np.float64)
    levels = np.quantile(s, np.linspace(0, 1, 401))
    share = (y == 1).mean()
    right = np.array([((s >= c) == (y == 1)).mean() for c in levels])
    best = np.flatnonzero(right >= right.max() - 1e-9)
    cut = levels[best[np.abs(np.linspace(0, 1, 401)[best] - (1 - share)).argmin()]]
    weight = w * scale
    return Model(weight, float(mean @ weight), float(1 / max(s.std(), 1e-6)) * 2, float(cut))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> Model:
    """Learn from ``labels`` (key, label), ``sample`` rows at most, joined to the texts of ``docs``."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("k"), "k", "y").limit(sample)
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).join(F.broadcast(known), "k").select("k", "t", "y")
    ship(docs.sparkSession)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                x = features(piece.column(1))
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), pa.array([r.tobytes() for r in x], pa.binary())], names=["k", "y", "x"])

    kind = docs.schema[key].dataType.simpleString()
    got = rows.mapInArrow(tidy(part), f"k {kind}, y int, x binary").orderBy(F.xxhash64("k"), "k", "y", "x").limit(sample).toArrow()
    if not got.num_rows:
        return neutral()
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(-1, WIDTH)
    return fit_pairs(x, got.column("y").to_numpy())


def _score(batch: pa.RecordBatch, model: Model) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(features(batch.column(1))))], names=["__row", "score"])


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id", threshold: float = 0.7) -> DataFrame:
    """Per row: key, score (0 to 1), predicted (1 from ``threshold`` on)."""
    kind = docs.schema[key].dataType.simpleString()
    out = arrow_map(docs.select(F.col(key).alias("__row"), F.col(text).cast("string").alias("__t")), partial(_score, model=model), f"__row {kind}, score double")
    return out.select(F.col("__row").alias(key), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
