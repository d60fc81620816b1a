"""LM scoring: a gated recurrent model over frequent words, with exact counts of the whole corpus.

Words are counted over all training documents. The most frequent ``vocabulary`` words are tokens of
their own; any other word is one of 32 *endings* (a class of its last two bytes), and its own
probability given the ending is (c + 0.1) / (N + 0.1 (V + 1)) with the counts c, N and V of the
training words of that ending. The model (``gru``) is started on the driver on ``seed_docs``
documents, then trained on all training documents, each partition of the input by a task of its own
(in the rows' order, so a retry gives the same model). The partitions' parameters, which are of a fixed
size, are averaged by the tokens they have seen: first in as many tasks as a shuffle has, then in
``mergers``, then on the driver, each in the order of the partitions.

Scoring streams every whole text through the model, the state carried from window to window.
Counts of the ``known`` most frequent words go with the tasks; the counts of all other words are
joined to the documents' rare words by hash, so nothing that grows with the corpus is broadcast.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.llm.common import HashTable, Words, bucket, chunks, documents, map_arrow, mix, most_frequent, parallelism, signed, stored, word_counts
from genoloom.llm.gru import Gru
from genoloom.llm.langid import labelled

N_ENDINGS = 32


class Tokens:
    """Word hash -> token: 0 is the end, 1 .. 32 the endings, then words."""

    def __init__(self, hashes: np.ndarray):
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.table = HashTable(self.hashes, np.arange(len(hashes)), -1)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        found = self.table(h).astype(np.int32)
        return np.where(found < 0, 1 + (h & np.uint64(N_ENDINGS - 1)).astype(np.int32), found + 1 + N_ENDINGS)


def texts_of(col: pa.Array, tokens: Tokens) -> list[np.ndarray]:
    out = []
    for _, _, data, bounds in chunks(col):
        w = Words(data, bounds, lower=True)
        ids = tokens(w.tagged())
        out += [ids[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    return out


def trained(docs: DataFrame, model: Gru, tokens: Tokens, mergers: int, lanes: int = 512, rate: float = 0.3, batch_tokens: int = 400_000) -> Gru:
    """``model`` after one pass over the documents, by a task a partition that starts from it; their mean by tokens seen."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((pickle.dumps(model), tokens))

    def run(batches):
        blob, table = sent.value
        own, seen, waiting, size = pickle.loads(blob), 0, [], 0
        for batch in batches:
            for x in texts_of(batch.column(0), table):
                waiting.append(x)
                size += len(x) + 1
                if size >= batch_tokens:
                    seen += own.train(waiting, lanes, rate=rate)
                    waiting, size = [], 0
        if waiting:
            seen += own.train(waiting, max(1, min(lanes, size // 64)), rate=rate)  # no more lanes than there is text for
        if seen:
            flat = np.concatenate([a.ravel() for a in own.p.values()]).astype(np.float64) * seen
            yield pa.RecordBatch.from_arrays([pa.array([flat.tobytes()], pa.binary()), pa.array([seen])], names=["p", "n"])

    def merged(batches):
        total, seen = None, 0
        for batch in batches:
            for p, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(p, np.float64)  # parameters times tokens
                total, seen = own.copy() if total is None else total + own, seen + n
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([seen])], names=["p", "n"])

    schema = "p binary, n bigint"
    rows = docs.select("__text").mapInArrow(run, schema).withColumn("k", F.spark_partition_id())
    for n in (max(mergers, parallelism(spark)), mergers):
        rows = rows.repartition(n, "k").sortWithinPartitions("k").select("p", "n").mapInArrow(merged, schema).withColumn("k", F.spark_partition_id())
    rows = sorted(rows.collect(), key=lambda r: r[2])  # mergers times the fixed size of the model
    if rows:
        mean = sum(np.frombuffer(r[0], np.float64) for r in rows) / sum(r[1] for r in rows)
        at = 0
        for k, a in model.p.items():
            model.p[k] = mean[at : at + a.size].reshape(a.shape).astype(np.float32)
            at += a.size
    return model


def score(docs: DataFrame, vocabulary: int = 2000, known: int = 65_536, seed_docs: int = 400, mergers: int = 16, hidden: int = 16, folds: int = 10, test_fold: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null texts are empty: one token, the end. Without training documents N is 0 and both scores are
    of words never seen. Rows equal in id and text are scored once and returned each; null ids are
    carried through; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    own = documents(docs, id_col, text_col).withColumns({"__text": F.coalesce("__text", F.lit("")), "__held": bucket("__id", folds) == test_fold})
    train = own.filter(~F.col("__held"))
    counts = stored(word_counts(train, lower=True, tagged=True))
    n_docs = train.count()
    total = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    n_train, distinct = (total[0] or 0) + n_docs, total[1] + (n_docs > 0)
    endings = {int(r[0]): (r[1], r[2]) for r in counts.groupBy(F.col("h").bitwiseAND(F.lit(N_ENDINGS - 1))).agg(F.sum("n"), F.count(F.lit(1))).collect()}  # 32 rows
    words, word_n, _ = most_frequent(counts, vocabulary)
    tokens = Tokens(words)
    own_n = dict(zip(words.tolist(), word_n, strict=True))
    end_n, end_v = np.zeros(N_ENDINGS), np.zeros(N_ENDINGS)
    for e, (n, v) in endings.items():
        mine = [k for h, k in own_n.items() if h & (N_ENDINGS - 1) == e]
        end_n[e], end_v[e] = n - sum(mine), v - len(mine)
    start = np.concatenate([[n_docs], end_n, [own_n[h] for h in tokens.hashes.tolist()]]).astype(float)
    model = Gru(start, hidden)
    seed = [r[0] for r in labelled(train, seed_docs, "__text").collect()]
    if seed:
        model.train(texts_of(pa.array(seed, pa.string()), tokens), lanes=32)
        model = trained(train, model, tokens, mergers)
    frequent, frequent_n, _ = most_frequent(counts, known)
    order = np.argsort(frequent)
    sent = spark.sparkContext.broadcast((model, tokens, HashTable(frequent[order], np.arange(len(order)), -1), frequent_n[order], np.log10(end_n + 0.1 * (end_v + 1))))  # sizes are parameters

    def run(batch: pa.RecordBatch):
        m, table, index, n_of, end_log = sent.value
        key = batch.column("__d").to_numpy()
        size = batch.num_rows
        base, extra, n_known, n_tokens = (np.zeros(size) for _ in range(4))
        texts: list[np.ndarray] = []
        for i, j, data, bounds in chunks(batch.column("__text")):
            w = Words(data, bounds, lower=True)
            h = w.tagged()
            ids, k = table(h), index(h).astype(np.int64)
            texts += [ids[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
            top = k >= 0
            log_c = np.zeros(len(h))
            log_c[top] = np.log10(n_of[k[top]] + 0.1)
            rest = (ids > 0) & (ids <= N_ENDINGS)
            count = lambda x: np.bincount(w.doc, x, minlength=j - i)  # noqa: B023, E731
            base[i:j], n_known[i:j], n_tokens[i:j] = count(log_c), count(top), np.diff(w.first) + 1
            extra[i:j] = count(np.where(rest, log_c - end_log[np.maximum(ids - 1, 0) % N_ENDINGS], 0.0))
            doc, rare = w.doc[~top], h[~top]
            _, at, n = np.unique(mix(rare + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_counts=True)
            none = pa.nulls(len(at), pa.float64())
            yield {
                "d": key[i + doc[at]], "h": signed(rare[at]), "n": n.astype(np.int64), "id": pa.nulls(len(at), batch.column("__id").type), "held": pa.nulls(len(at), pa.bool_()),
                "n_tokens": none, "n_known": none, "base": none, "lm": none,
            }
        lm = m.score(texts) / np.log(10) + extra
        yield {
            "d": key, "h": signed(mix(key.view(np.uint64))), "n": np.zeros(size, np.int64), "id": batch.column("__id"), "held": batch.column("__held"),
            "n_tokens": n_tokens, "n_known": n_known, "base": base, "lm": lm,
        }

    kind = docs.schema[id_col].dataType.simpleString()
    rows = map_arrow(own.withColumn("__d", F.xxhash64("__id", "__text")), run, f"d bigint, h bigint, n bigint, id {kind}, held boolean, n_tokens double, n_known double, base double, lm double")
    is_rare = F.col("n") > 0
    joined = rows.join(counts.select("h", F.col("n").alias("c")), "h", "left")
    c = F.coalesce("c", F.lit(0))
    sums = joined.groupBy("d").agg(
        F.sum(F.when(~is_rare, 1).otherwise(0)).alias("times"),
        F.max("id").alias("id"), F.max("held").alias("held"), F.max("n_tokens").alias("n_tokens"), F.max("lm").alias("lm"), F.max("base").alias("base"), F.max("n_known").alias("n_known"),
        F.sum(F.when(is_rare, F.col("n") * F.log10(c + F.lit(0.1))).otherwise(0.0)).alias("rare"),
        F.sum(F.when(is_rare & (c > 0), F.col("n")).otherwise(0)).alias("rare_known"),
    )
    per = lambda x: F.col(x) / F.col("times")
    end = np.log10(n_docs + 0.1)
    whole = np.log10(n_train + 0.1 * (distinct + 1))
    out = sums.select(
        F.col("id").alias("doc_id"),
        F.col("held").alias("held_out"),
        F.col("n_tokens").cast("bigint").alias("n_tokens"),
        (F.col("n_known") + F.round(per("rare_known")) + F.lit(int(n_docs > 0))).cast("bigint").alias("n_known"),
        F.lit(n_train).cast("bigint").alias("train_tokens"),
        (F.col("base") + per("rare") + F.lit(float(end)) - F.col("n_tokens") * F.lit(float(whole))).alias("base_score"),
        (F.col("lm") + per("rare")).alias("score"),
        F.explode(F.sequence(F.lit(1), F.col("times"))).alias("__copy"),
    )
    return out.drop("__copy")


