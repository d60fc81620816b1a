"""Quality classifier: naive Bayes support vectors (NBSVM).

A text's features are indicators of its byte 1-, 2- and 3-grams,
hashed to 2**17 columns. Columns are scaled by the classes' log-count
ratios, rows to unit length; a linear hinge-loss model is fitted by dual coordinate descent with
class weights, then interpolated with its mean weight. Margins become probabilities by Platt's
sigmoid, fitted on margins of rows left out of the fit. Fitting is numpy on the driver over at most
``sample_docs`` labelled rows; scoring streams every partition's whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.llm.common import bucket, chunks, documents, map_arrow
from genoloom.llm.langid import labelled

BITS = 17
ORDERS = (1, 2, 3)


def ngram_columns(data: np.ndarray, n: int) -> np.ndarray:
    size = max(0, len(data) - n + 1)
    h = np.full(size, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for j in range(n):
        h = (h ^ data[j : j + size]) * np.uint32(0x01000193 + 2 * 0x10001)
    return (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)


class Marks:
    """Distinct columns of one text after another, by a bitmap of all columns."""

    def __init__(self):
        self.seen = np.zeros(1 << BITS, bool)

    def __call__(self, parts: list[np.ndarray]) -> np.ndarray:
        for x in parts:
            self.seen[x] = True
        out = np.flatnonzero(self.seen)
        self.seen[out] = False
        return out


def indicator_rows(texts: pa.Array):
    """The distinct feature columns of each text."""
    marks = Marks()
    for _, _, data, bounds in chunks(texts):
        columns = [ngram_columns(data, n) for n in ORDERS]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield marks([c[a : max(a, b - n + 1)] for c, n in zip(columns, ORDERS, strict=True)])


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, columns: np.ndarray) -> float:
        if not len(columns):
            return 1 / (1 + np.exp(-(self.slope * self.bias + self.offset)))
        return 1 / (1 + np.exp(-(self.slope * (self.weights[columns].sum() / np.sqrt(len(columns)) + self.bias) + self.offset)))


def ratios(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    counts = {s: np.full(1 << BITS, alpha) for s in (-1, 1)}
    for columns, s in zip(rows, y, strict=True):
        counts[s][columns] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[-1] / counts[-1].sum())


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float, epochs: int, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L1-loss linear SVM; the bias is a column that is always 1."""
    w, bias = np.zeros(1 << BITS), 0.0
    alpha = np.zeros(len(rows))
    share = {s: len(y) / (2 * max(1, (y == s).sum())) for s in (-1, 1)}
    values = [ratio[c] / np.sqrt(max(1, len(c))) for c in rows]
    square = [v @ v + 1 for v in values]
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost * share[y[i]])
            if step := (new - alpha[i]) * y[i]:
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
    return w, bias


def folded(w: np.ndarray, bias: float, ratio: np.ndarray, beta: float) -> np.ndarray:
    """Weights times ratios, after the interpolation with the mean weight."""
    return ((1 - beta) * np.abs(w).mean() + beta * w) * ratio


def fit(rows: list[np.ndarray], labels: list[int], cost: float = 1.0, epochs: int = 8, beta: float = 0.9, seed: int = 11) -> Model:
    """With labels of one kind only (or none) every score is that kind's smoothed share."""
    y = np.where(np.array(labels, int) == 1, 1, -1)
    rng = np.random.default_rng(seed)
    prior = ((y == 1).sum() + 1) / (len(y) + 2)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(1 << BITS), 0.0, 1.0, float(np.log(prior / (1 - prior))))
    fold, margin = rng.integers(0, 3, len(y)), np.zeros(len(y))
    for k in range(3):
        a, b = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(b) and len(set(y[a].tolist())) == 2:
            r = ratios([rows[i] for i in a], y[a])
            w, bias = descend([rows[i] for i in a], y[a], r, cost, max(3, epochs // 2), rng)
            f = folded(w, bias, r, beta)
            for i in b:
                margin[i] = f[rows[i]].sum() / np.sqrt(max(1, len(rows[i]))) + bias
    slope, offset = platt(margin, y)
    ratio = ratios(rows, y)
    w, bias = descend(rows, y, ratio, cost, epochs, rng)
    return Model(folded(w, bias, ratio, beta), bias, slope, offset)


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton steps for P(label 1) = sigmoid(slope * margin + offset), with Platt's smoothed targets."""
    up, down = (y == 1).sum(), (y != 1).sum()
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    slope, offset = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margin + offset, -30, 30)))
        g = np.array([(margin * (p - target)).sum(), (p - target).sum()])
        v = p * (1 - p)
        h = np.array([[(v * margin**2).sum(), (v * margin).sum()], [(v * margin).sum(), v.sum()]]) + 1e-6 * np.eye(2)
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        slope, offset = max(1e-3, slope - step[0]), offset - step[1]
        if abs(step).max() < 1e-6:
            break
    return float(slope), float(offset)


def score(docs: DataFrame, labels: DataFrame, sample_docs: int = 4000, threshold: float = 0.7, folds: int = 4, test_fold: int = 2, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted.

    ``sample_docs`` bounds the labelled ids the model is fitted on, none of them of the test fold, and twice as
    many rows their documents, should ids repeat; both are chosen and ordered by a hash. An
    id labelled more than once counts with its largest label, null labels and ids teach nothing.
    Null texts are scored as empty ones. Null and repeated ids are carried through, row for row;
    other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    own = documents(docs, id_col, text_col).withColumn("__held", bucket("__id", folds) == test_fold)
    marked = labels.filter(labels[label_col].isNotNull() & labels[id_col].isNotNull()).groupBy(labels[id_col].alias("__id")).agg(F.max(label_col).alias("__label"))
    marked = marked.filter(bucket("__id", folds) != test_fold).withColumn("__text", F.lit(""))
    chosen = labelled(marked, sample_docs, "__id", "__label")
    found = own.select("__id", "__text").join(F.broadcast(chosen), "__id")  # chosen: sample_docs rows at most
    rows = found.orderBy(F.xxhash64("__id", "__text"), "__text").limit(2 * sample_docs).select("__text", "__label").collect()
    texts = pa.array([r[0] for r in rows], pa.string())
    model = spark.sparkContext.broadcast(fit(list(indicator_rows(texts)), [int(r[1]) for r in rows]))

    def run(batch: pa.RecordBatch):
        s = np.fromiter(map(model.value.score, indicator_rows(batch.column("__text"))), np.float64, batch.num_rows)
        yield {"doc_id": batch.column("__id"), "held_out": batch.column("__held"), "score": s, "predicted": (s >= threshold).astype(np.int32)}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(own, run, f"doc_id {kind}, held_out boolean, score double, predicted int")
