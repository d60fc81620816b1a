"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is its lower-cased UTF-8 bytes; its subwords are the byte 2-, 3- and 4-grams, hashed to a
table of embeddings. The mean embedding goes through a linear softmax; both are trained by
stochastic gradient descent in numpy on the driver, over at most ``sample_docs`` labelled rows.
A part of the sample is kept apart to calibrate: a temperature for the probabilities, and the
smallest score at which the answers above it are right as often as ``precision``; answers below
it are marked ``rejected``. For scoring, embeddings and softmax fold into one table of logits a
subword, and every partition streams its whole texts through it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.llm.common import bucket, chunks, documents, map_arrow

ORDERS = (2, 3, 4)
BITS = 16
UNKNOWN = "und"
_LETTER = r"\pL"


def subwords(data: np.ndarray, n: int) -> np.ndarray:
    """Table row of each byte n-gram."""
    size = max(0, len(data) - n + 1)
    h = np.full(size, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for j in range(n):
        h = (h ^ data[j : j + size]) * np.uint32(0x01000193 + 2 * 0x10001)
    return (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct table rows of a text and their shares."""
    data = np.frombuffer(text.lower().encode(), np.uint8)
    rows, n = np.unique(np.concatenate([subwords(data, k) for k in ORDERS]), return_counts=True)
    return rows, (n / max(1, n.sum())).astype(np.float32)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # logits a subword, divided by the temperature
    bias: np.ndarray
    threshold: float


def fit(texts: list[str], labels: list[str], dim: int = 16, epochs: int = 4, rate: float = 0.5, precision: float = 0.99, seed: int = 5) -> Model:
    """Texts without a letter teach nothing and are left out; without any text every answer is ``und``."""
    rng = np.random.default_rng(seed)
    langs = sorted(set(labels))
    if not langs:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0, np.float32), 0.0)
    y = np.array([langs.index(x) for x in labels])
    part = rng.random(len(texts)) < 0.85 if len(texts) > 20 else np.ones(len(texts), bool)
    bags, ys, held = [], [], []
    for text, label, train in zip(texts, y, part, strict=True):
        # besides the whole text a short piece, so that short texts are known and calibrated too
        at = int(rng.integers(0, max(1, len(text) - 40)))
        for x in (text, text[at : at + 40]):
            if x:
                bags.append(bag(x))
                ys.append(label)
                held.append(not train)
    emb = rng.normal(0, 0.1, (1 << BITS, dim)).astype(np.float32)
    out = np.zeros((dim, len(langs)), np.float32)
    bias = np.zeros(len(langs), np.float32)
    train = [i for i in range(len(bags)) if not held[i]]
    for epoch in range(epochs):
        for step, i in enumerate(rng.permutation(train)):
            rows, share = bags[i]
            lr = rate * (1 - (epoch + step / len(train)) / epochs)
            e = emb[rows]
            hidden = share @ e
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[ys[i]] -= 1
            back = out @ p
            out -= lr * np.outer(hidden, p)
            bias -= 0.1 * lr * p
            # rows' shares are small: their step is widened by the number of rows
            emb[rows] = e - (lr * len(rows)) * np.outer(share, back).clip(-0.1, 0.1)
    table = emb @ out
    check = [i for i in range(len(bags)) if held[i]] or train
    z = np.array([bags[i][1] @ table[bags[i][0]] + bias for i in check])
    truth = np.array([ys[i] for i in check])

    def probabilities(t: float) -> np.ndarray:
        q = np.exp((z - z.max(1, keepdims=True)) / t)
        return q / q.sum(1, keepdims=True)

    loss = lambda t: -np.log(probabilities(t)[np.arange(len(truth)), truth] + 1e-12).mean()
    t = min((0.05 * 1.25**k for k in range(30)), key=loss)
    p = probabilities(t)
    score, right = p.max(1), p.argmax(1) == truth
    order = np.argsort(-score)
    good = np.flatnonzero(np.cumsum(right[order]) >= precision * np.arange(1, len(order) + 1))
    threshold = float(score[order[good[-1]]]) if len(good) else 1.0
    return Model(langs, (table / t).astype(np.float32), (bias / t).astype(np.float32), threshold)


def logits(model: Model, texts: pa.Array) -> np.ndarray:
    """Mean logits of each text, over the whole text."""
    result = np.zeros((len(texts), len(model.langs)), np.float64)
    for i, j, data, bounds in chunks(pc.utf8_lower(texts)):
        size = np.diff(bounds)
        total = np.zeros((j - i, len(model.langs)))
        for n in ORDERS:
            rows = subwords(data, n)
            has = size >= n
            if has.any():
                # sums over [start, end - n + 1) of each text; the stretches between are summed apart
                cuts = np.column_stack([bounds[:-1][has], bounds[1:][has] - n + 1]).ravel()
                values = np.vstack([model.table[rows], np.zeros((1, len(model.langs)), np.float32)])
                total[has] += np.add.reduceat(values, cuts, axis=0)[::2]
        grams = sum(np.maximum(size - n + 1, 0) for n in ORDERS)
        result[i:j] = total / np.maximum(grams, 1)[:, None] + model.bias
    return result


def labelled(docs: DataFrame, sample_docs: int, *columns: str) -> DataFrame:
    """About ``sample_docs`` of the rows, and never more, chosen and ordered by a hash of id and text, so that a fit can be repeated."""
    n = docs.count()
    share = min(1.0, 1.25 * sample_docs / max(n, 1))
    key = F.xxhash64("__id", "__text", F.lit(3))
    return docs.filter(F.pmod(key, F.lit(1_000_000)) < int(share * 1_000_000) + 1).orderBy(key, "__id", "__text").limit(sample_docs).select(*columns)


def predict(docs: DataFrame, sample_docs: int = 3000, folds: int = 4, test_fold: int = 2, precision: float = 0.99, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score, rejected.

    ``sample_docs`` bounds the labelled rows the model is fitted on; all have a label and lie outside
    the test fold. A text that is null or has no letter gets ``und``, score 0 and rejected; so does
    every text if there are no labels. Null and repeated ids are carried through, row for row; other
    columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    own = documents(docs, id_col, text_col, label=label_col).withColumn("__held", bucket("__id", folds) == test_fold)
    train = own.filter(F.col("__label").isNotNull() & ~F.col("__held") & F.col("__text").rlike(r"\p{L}"))
    rows = labelled(train, sample_docs, "__text", "__label").collect()
    model = spark.sparkContext.broadcast(fit([r[0] for r in rows], [r[1] for r in rows], precision=precision))  # of fixed size

    def score(batch: pa.RecordBatch):
        m: Model = model.value
        texts = pc.fill_null(batch.column("__text"), "")
        letters = pc.match_substring_regex(texts, _LETTER).to_numpy(zero_copy_only=False)
        if not m.langs:
            letters = np.zeros(len(texts), bool)
            best, p = np.zeros(len(texts), int), np.zeros(len(texts))
        else:
            z = logits(m, texts)
            q = np.exp(z - z.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            best, p = q.argmax(1), q.max(1)
        yield {
            "doc_id": batch.column("__id"),
            "held_out": batch.column("__held"),
            "lang_pred": pa.array([m.langs[k] if ok else UNKNOWN for k, ok in zip(best, letters, strict=True)], pa.string()),
            "score": np.where(letters, p, 0.0),
            "rejected": ~letters | (p < m.threshold),
        }

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(own.select("__id", "__text", "__held"), score, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")
