"""A quality classifier from positive and unlabelled documents.

Trusted positives and unlabelled web text are all that the risk looks at. The
unlabelled risk less the positives' share of it estimates the negatives' risk,
which must not fall below zero: a step that would take it there is cut back
(non-negative PU learning), which keeps the model from fitting noise.

The class prior is estimated from the mixture. A first model tells positives
from unlabelled rows; among the rows that it finds most like positives there
are few others, so that the share of the unlabelled rows there, divided by the
share of the positives there, comes down to the prior.

All rows outside the held-out fold take part, however many: each Newton step
needs sums over the rows only, which one aggregate brings to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tideclock.llm import scratch
from tideclock.llm.quality_rules import repeat_words

FOLDS = 5
#: Used where no row is known to be positive.
DEFAULT_PRIOR = 0.5
#: The prior is read where at least this share of the positives is.
TAIL = 0.5
#: Most passes over the rows for one model, and the weight decay.
PASSES, DECAY = 16, 1e-3

FEATURES = ("length", "symbols", "bangs", "bars", "capitals", "digits", "repeats", "same_lines", "variety", "top_word", "word_length", "punctuation", "worst_symbols", "worst_capitals", "worst_variety", "longest_word")
_SYMBOL = bytes(1 if b in b"#*$%&|<>" else 0 for b in range(256))


def features(text: bytes | None) -> list[float]:
    """Sixteen numbers about a text's form; of language or origin they know nothing.

    The ``worst`` ones are over runs of 40 words, so that junk within a longer
    text shows.
    """
    of = text.split() if text else []
    n = len(of)
    if not n:
        return [0.0] * len(FEATURES)
    size = len(text)
    lines = [x for x in text.split(b"\n") if x.strip()]
    counts: dict[bytes, int] = {}
    for w in of:
        counts[w] = counts.get(w, 0) + 1
    symbol = np.array([w[-1] in b"#*$%&|<>" for w in of], dtype=np.float32)
    capital = np.array([len(w) > 1 and w.isupper() for w in of], dtype=np.float32)
    new, seen = np.zeros(n, dtype=np.float32), set()
    for start in range(0, n, 40):
        seen.clear()
        for i in range(start, min(start + 40, n)):
            if of[i] not in seen:
                seen.add(of[i])
                new[i] = 1
    runs = np.arange(0, n, 40)
    lengths = np.diff(np.append(runs, n))
    weight = np.minimum(lengths / 20, 1)  # a short last run says less
    worst = lambda x: float((np.add.reduceat(x, runs) / lengths * weight).max())
    return [
        math.log1p(n) / 5,
        float(symbol.mean()),
        min(1.0, text.count(b"!") / n),
        min(1.0, text.count(b"|") / n),
        float(capital.mean()),
        min(1.0, sum(text.count(d) for d in b"0123456789") / size),
        repeat_words(of) / n,
        1 - len(set(lines)) / len(lines),
        len(counts) / n,
        max(counts.values()) / n,
        min(2.0, size / n / 10),
        min(1.0, (text.count(b".") + text.count(b",")) / n),
        worst(symbol),
        worst(capital),
        worst(1 - new),
        min(2.0, max(map(len, counts)) / 50),
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(x.as_buffer().to_pybytes() if x.is_valid else None) for x in batch.column(1)]
        flat = pa.array(np.array(rows, dtype=np.float64).reshape(-1))
        offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], names=["key", "x"])


@dataclass(frozen=True)
class Model:
    """A linear model over standardised features; ``prior`` is the share of positives it was told of."""

    weights: list[float]
    bias: float
    prior: float

    def score(self, x: Column) -> Column:
        """Probability of quality from a features column, by built-in expressions."""
        z = F.lit(self.bias)
        for i, w in enumerate(self.weights):
            z = z + F.lit(w) * x[i]
        return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))


K = len(FEATURES) + 1
_PARTS = (1, 1, K, K, K * K)


def _sums(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Over standardised rows: their number, the logistic loss as negatives, x, its gradient and curvature."""
    z = x @ w
    s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return np.concatenate([[len(x), np.logaddexp(0, z).sum()], x.sum(axis=0), s @ x, ((x * (s * (1 - s))[:, None]).T @ x).ravel()])


def _means(sums: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray, np.ndarray]:
    n, loss, x, gradient, curvature = np.split(sums, np.cumsum(_PARTS)[:-1])
    n = float(n[0])
    return n, float(loss[0]) / n, x / n, gradient / n, curvature.reshape(K, K) / n


def _newton(gather: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], w: np.ndarray, prior: float | None) -> np.ndarray:
    """The least risk from ``w`` on; ``gather`` gives the sums of positive and unlabelled rows for weights.

    With a prior, the non-negative PU risk with the logistic loss; without, that
    of telling positives from unlabelled rows.
    """
    best, least, direction, step = w, math.inf, np.zeros(K), 1.0
    for _ in range(PASSES):
        (_, loss_p, x_p, g_p, h_p), (_, loss_u, _, g_u, h_u) = map(_means, gather(w))
        decay = np.append(np.full(K - 1, DECAY), 1e-9)
        # As a positive a row's loss is its loss as a negative less w x.
        if prior is None:
            risk, allowed, gradient, curvature = loss_u + loss_p - w @ x_p, True, g_u + g_p - x_p, h_u + h_p
        else:
            risk, allowed, gradient, curvature = loss_u - prior * (w @ x_p), loss_u - prior * loss_p >= 0, g_u - prior * x_p, h_u
        risk += float(decay @ w**2) / 2
        if allowed and risk <= least + 1e-12:
            best, least, step = w, risk, 1.0
            direction = -np.linalg.solve(curvature + np.diag(decay), gradient + decay * w)
            if np.abs(direction).max() < 1e-3:
                break
        else:
            step /= 2
            if step < 1 / 32:
                break
        w = best + step * direction
    return best


def _start(prior: float) -> np.ndarray:
    return np.append(np.zeros(K - 1), math.log(prior / (1 - prior)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The prior from histograms of the first model's scores, low to high: the least ratio of upper tails."""
    p, u = (np.cumsum(h[::-1]) / max(1, h.sum()) for h in (positive, unlabelled))
    told = p >= TAIL
    return float(np.clip((u[told] / p[told]).min(), 0.01, 0.99)) if told.any() else DEFAULT_PRIOR


_EDGES = np.linspace(-20, 20, 401)


def _fit(gather_moments: Callable, gather_sums: Callable, gather_histograms: Callable, prior: float | None) -> Model:
    """A model from three kinds of sums over the rows; without positives it knows nothing."""
    n, sums, squares, positives = gather_moments()
    if not n or not positives:
        known = DEFAULT_PRIOR if prior is None else prior
        return Model([0.0] * len(FEATURES), math.log(known / (1 - known)), known)
    centre = sums / n
    scale = np.sqrt(np.maximum(squares / n - centre**2, 0)) + 1e-6
    gather = lambda w: gather_sums(w, centre, scale)
    if prior is None:
        prior = estimate_prior(*gather_histograms(_newton(gather, np.zeros(K), None), centre, scale))
    w = _newton(gather, _start(prior), prior)
    weights = w[:-1] / scale
    return Model(weights.tolist(), float(w[-1] - weights @ centre), prior)


def _standard(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.hstack([(x - centre) / scale, np.ones((len(x), 1))])


def _histogram(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.histogram(np.clip(x @ w, -20, 20), _EDGES)[0].astype(float)


def fit_nnpu(positives: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> Model:
    """The fit from arrays of features; without a prior it is estimated."""
    standard = lambda c, s: (_standard(positives, c, s), _standard(unlabelled, c, s))
    return _fit(
        lambda: (len(unlabelled), unlabelled.sum(axis=0), (unlabelled**2).sum(axis=0), len(positives)),
        lambda w, c, s: tuple(_sums(x, w) for x in standard(c, s)),
        lambda w, c, s: tuple(_histogram(x, w) for x in standard(c, s)),
        prior,
    )


def _total(rows: DataFrame, of: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum of ``of(features, positive)`` over batches of (x, positive), added up in the cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            out += of(x, batch.column(1).to_numpy(zero_copy_only=False).astype(bool))
        yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.float64()))], names=["s"])

    added = rows.mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    out = np.zeros(size)
    for row in added.collect():  # ``size`` rows
        out[row["i"]] = row["v"]
    return out


def fit_rows(rows: DataFrame) -> Model:
    """The fit from rows of (x, positive); all rows count as unlabelled, the positive ones as positives too."""

    def moments() -> tuple:
        k = len(FEATURES)
        got = _total(rows, lambda x, y: np.concatenate([[len(x), y.sum()], x.sum(axis=0), (x**2).sum(axis=0)]), 2 + 2 * k)
        return got[0], got[2 : 2 + k], got[2 + k :], got[1]

    def both(of: Callable, size: int) -> Callable:
        def gather(w: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> tuple:
            def parts(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                x = _standard(x, centre, scale)
                return np.concatenate([of(x[y], w), of(x, w)])

            got = _total(rows, parts, 2 * size)
            return got[:size], got[size:]

        return gather

    return _fit(moments, both(_sums, sum(_PARTS)), both(_histogram, len(_EDGES) - 1), None)


def fold(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def fold_of(key: object) -> int:
    return zlib.crc32(str(key).encode()) % FOLDS


def train(measured: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """A model from the rows outside the held-out fold.

    ``measured`` has key and x, ``labels`` doc_id and a 0/1 column; a document
    with several labels is positive if one is, null labels do not count. Labels
    of 0 are not looked at.
    """
    positive = labels.filter((F.col(label).cast("int") == 1) & (fold(F.col("doc_id")) != 0)).select(F.col("doc_id").alias("key"), F.lit(True).alias("positive")).distinct()
    rows = measured.filter(F.col("key").isNotNull() & (fold(F.col("key")) != 0)).join(positive.hint("merge"), "key", "left")
    rows = scratch.materialize(rows.select("x", F.coalesce("positive", F.lit(False)).alias("positive")), "training")
    model = fit_rows(rows)
    scratch.drop(rows)
    return model


def score_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """One row per row of ``docs``: key, held_out, score, predicted.

    Null and empty texts have all features zero and a score like others. A null
    key is scored and belongs to the fold of the empty string. Without positive
    labels the model knows nothing and gives the prior. Repeated rows are scored,
    and count in the fit, each for itself. An empty table gives no rows; other
    columns are not read.
    """
    scratch.small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[key]
    narrow = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    measured = scratch.materialize(narrow.mapInArrow(_measure, f"key {kind}, x array<double>"), "features")
    model = train(measured, labels, label)
    scored = measured.select("key", (fold(F.col("key")) == 0).alias("held_out"), model.score(F.col("x")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int")).withColumnRenamed("key", key)
