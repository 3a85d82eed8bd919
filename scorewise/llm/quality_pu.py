"""Operator 5, quality classifier by positive-unlabelled learning.

Trusted positives are the documents marked good among the learning rows;
everything else the web gives is unlabelled.  A small network over style
features of the whole text is fitted by minimising the non-negative unbiased
risk ``prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))``
(logistic loss; when the second term turns negative, the step goes up on it).
``prior`` is the share of good documents, estimated from the learning labels.
The network's output is turned into a chance by one logistic curve over the
learning labels (both classes), so that a score can be held against 0.7.

Every document of the table is unlabelled text of the fit: tasks add the
features of all documents up by cells (the signs of ``bits`` fixed projections),
and the risk runs over the means of the cells, each weighted by its exact number
of documents.  Sums are whole numbers, so reruns and other partitions give the
same model; at most 2^bits rows reach the driver.  Of labelled rows, at most
``max_positive`` trusted positives and ``max_labelled`` labels for the curve are
used, the first in the order of a hash of the id.  Every document is scored.

Features come from the text alone.  A null text counts as empty and is scored.
Labels that are null, or whose doc_id is null or unknown, teach nothing; a
doc_id labelled twice counts by its smallest label.  Without labels of both
classes every score is the prior (1.0 where there is no label at all).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewise.llm.common import cut, text_of

MAX_POSITIVE, MAX_LABELLED, THRESHOLD, FOLDS, HELD = 8_000, 8_000, 0.7, 4, 2
HIDDEN, STEPS, SEED, BITS, UNITS_OF_ONE = 16, 1500, 11, 14, 1 << 24

#: Byte classes: 0 other, 1 lower-case or non-ASCII letter, 2 capital, 3 digit, 4 space, 5 line end,
#: 6 sentence mark, 7 bar or arrow, 8 exclamation mark, 9 sign (# $ % & * and the like), 10 bracket or quote.
_CLASS = np.zeros(256, np.uint8)
for _k, _chars in ((1, bytes(range(97, 123)) + bytes(range(128, 256))), (2, bytes(range(65, 91))), (3, b"0123456789"), (4, b" \t\x0b\x0c"),
                   (5, b"\r\n"), (6, b".,;:?"), (7, b"|<>"), (8, b"!"), (9, b"#$%&*+=@^~_\\/"), (10, b"()[]{}'\"`-")):
    _CLASS[list(_chars)] = _k
N_FEATURES = 20


def features(text: bytes) -> list[float]:
    """Style of a text: shares of byte classes, word lengths, repetition."""
    n = len(text)
    share = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=11)[:11] / max(n, 1)
    words = text.lower().split()
    k = len(words)
    if not k:
        return [0.0] * N_FEATURES
    distinct = set(words)
    again = sum(a == b for a, b in pairwise(words)) / k
    lines = [x for x in text.split(b"\n") if x.strip()]
    signs = sum(x[-1] in b"#$%&*!|+=~^" for x in words) / k
    alone = sum(len(x) == 1 for x in words) / k
    return [*share.tolist(), np.log1p(k) / 10, min(n / k, 30) / 10, len(distinct) / k, len(distinct) / k ** 0.8,
            again, signs, alone, 1 - len(set(lines)) / len(lines), k / len(lines) / 50 if k < 50 * len(lines) else 1.0]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Network:
    """One hidden layer; ``mean`` and ``scale`` normalise the features."""

    def __init__(self, mean, scale, params):
        self.mean, self.scale, self.params = mean, scale, params

    def hidden(self, x):
        a, b, _, _ = self.params
        return np.tanh((x - self.mean) / self.scale @ a + b)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        _, _, c, d = self.params
        return self.hidden(x) @ c + d[0]


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, weight: np.ndarray | None = None, hidden: int = HIDDEN,
           steps: int = STEPS, seed: int = SEED, rate: float = 0.01, batch: int = 512, decay: float = 1e-4) -> Network:
    """Minimise the non-negative risk by Adam over minibatches; ``weight``: documents
    that each unlabelled row stands for (it is drawn that often)."""
    rng = np.random.default_rng(seed)
    weight = np.ones(len(unlabelled)) if weight is None else weight
    cum = np.cumsum(weight / weight.sum())
    mean = np.average(unlabelled, axis=0, weights=weight)
    std = np.sqrt(np.average((unlabelled - mean) ** 2, axis=0, weights=weight))
    net = Network(mean, np.maximum(std, positive.std(axis=0)) + 1e-6, [
        rng.normal(0, 1 / np.sqrt(len(mean)), (len(mean), hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)])
    m, v = [np.zeros_like(p) for p in net.params], [np.zeros_like(p) for p in net.params]
    for step in range(1, steps + 1):
        p = positive[rng.integers(0, len(positive), min(batch, len(positive)))]
        u = unlabelled[np.minimum(np.searchsorted(cum, rng.random(2 * batch), "right"), len(cum) - 1)]
        x = np.concatenate([p, u])
        h = net.hidden(x)
        z = h @ net.params[2] + net.params[3][0]
        zp, zu = z[:len(p)], z[len(p):]
        as_negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        down_u, down_p = sigmoid(zu) / len(u), -prior * sigmoid(zp) / len(p)       # gradient of the second term
        if as_negative < 0:                                                       # it must not be negative: step up on it
            g = np.concatenate([-down_p, -down_u])
        else:
            g = np.concatenate([prior * -sigmoid(-zp) / len(p) + down_p, down_u])
        back = g[:, None] * net.params[2] * (1 - h * h)
        xs = (x - net.mean) / net.scale
        grads = [xs.T @ back + decay * net.params[0], back.sum(axis=0), h.T @ g + decay * net.params[2], np.array([g.sum()])]
        lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for i, gr in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * gr
            v[i] = 0.999 * v[i] + 0.001 * gr * gr
            net.params[i] = net.params[i] - lr * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)
    return net


def fit_curve(z: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and offset of the logistic curve from outputs to chances (Newton steps, lightly damped)."""
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((y == 0).sum() + 2))
    w, x = np.zeros(2), np.stack([z, np.ones_like(z)], axis=1)
    for _ in range(steps):
        q = sigmoid(x @ w)
        hess = x.T @ (x * (q * (1 - q))[:, None]) + 1e-3 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hess, x.T @ (q - t) + 1e-3 * w), -2, 2)
    return float(w[0]), float(w[1])


class QualityModel:
    def __init__(self, net: Network | None, curve: tuple[float, float], prior: float):
        self.net, self.curve, self.prior = net, curve, prior

    def scores(self, texts) -> np.ndarray:
        x = np.array([features(t or b"") for t in texts], float).reshape(-1, N_FEATURES)
        if self.net is None:
            return np.full(len(x), self.prior)
        return sigmoid(self.curve[0] * self.net(x) + self.curve[1])

    def score(self, text: Column) -> Column:
        """Column of scores of a text column (row by row, no shuffle)."""
        return score_udf(self)(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def score_udf(model: QualityModel):
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series(model.scores(t))
    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")


def held_out(id_col: Column, folds: int = FOLDS, held: int = HELD) -> Column:
    """Rows kept from learning: crc32 of the id as text, by its remainder (a null id is kept from it too)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == held, F.lit(True))


def _first(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


class Cells:
    """Cell of a feature row: on which side of a reference sample's median it
    lies along each of ``bits`` random directions."""

    def __init__(self, sample: np.ndarray, bits: int = BITS, seed: int = SEED):
        self.mean, self.scale = sample.mean(axis=0), sample.std(axis=0) + 1e-6
        self.directions = np.random.default_rng(seed).normal(size=(sample.shape[1], bits))
        self.middle = np.median(self._along(sample), axis=0)

    def _along(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -20, 20) @ self.directions

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (self._along(x) > self.middle) @ (1 << np.arange(self.directions.shape[1]))


def cell_means(texts: DataFrame, cells: Cells) -> tuple[np.ndarray, np.ndarray]:
    """Means of the features of all ``texts(text binary)`` in each cell, and the
    number of texts there.  A task keeps one row of sums per cell it meets."""
    names = [f"x{i}" for i in range(N_FEATURES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column("text")], float).reshape(-1, N_FEATURES)
            rows = np.concatenate([np.ones((len(x), 1), np.int64), np.rint(x * UNITS_OF_ONE).astype(np.int64)], axis=1)
            for c, row in zip(cells(x).tolist(), rows, strict=True):
                if c in held:
                    held[c] += row
                else:
                    held[c] = row.copy()
        if held:
            sums = np.stack(list(held.values()))
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), *[pa.array(col) for col in sums.T]], ["cell", "n", *names])
    kind = ", ".join(f"{c} long" for c in ["cell", "n", *names])
    got = texts.mapInArrow(run, kind).groupBy("cell").agg(*[F.sum(c).alias(c) for c in ["n", *names]]).orderBy("cell").toPandas()
    n = got.n.to_numpy(float)
    return got[names].to_numpy(float) / UNITS_OF_ONE / n[:, None], n


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                max_positive: int = MAX_POSITIVE, max_labelled: int = MAX_LABELLED, bits: int = BITS) -> QualityModel:
    lab = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    lab = lab.filter(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    lab = cut(lab.groupBy("doc_id").agg(F.min("y").alias("y")))
    n = {r["y"]: r["n"] for r in lab.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(n.values())
    prior = n.get(1, 0) / total if total else 1.0
    if not n.get(0) or not n.get(1):
        return QualityModel(None, (0.0, 0.0), prior)
    ids = docs.select(F.col(id_col).alias("doc_id")).filter("doc_id is not null").distinct()
    pick = (_first(lab.filter("y = 1").join(ids, "doc_id"), max_positive).select("doc_id", F.lit("p").alias("use"), F.lit(1).alias("y"))
            .unionByName(_first(lab.join(ids, "doc_id"), max_labelled).select("doc_id", F.lit("l").alias("use"), "y")))
    pick = cut(pick)                                       # at most max_positive + max_labelled rows
    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).cast("binary").alias("text"))
    sample = texts.join(F.broadcast(pick.select("doc_id").distinct()), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])
    x = sample.mapInArrow(run, f"doc_id {dict(texts.dtypes)['doc_id']}, x array<double>").groupBy("doc_id").agg(F.min("x").alias("x"))
    got = pick.join(x, "doc_id").orderBy("use", F.xxhash64("doc_id"), "doc_id").select("use", "y", "x").toPandas()
    part = lambda u: np.stack(got.x[got.use == u].to_numpy())
    if not {"p", "l"} <= set(got.use):
        return QualityModel(None, (0.0, 0.0), prior)
    means, n = cell_means(texts.select("text"), Cells(part("l"), bits))
    net = fit_pu(part("p"), means, prior, n)
    return QualityModel(net, fit_curve(net(part("l")), got.y[got.use == "l"].to_numpy()), prior)


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text",
                  threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``."""
    d = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), model.score(F.col(text_col)).alias("score"))
    return d.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    return docs.filter(model.score(F.col(text_col)) >= threshold)
