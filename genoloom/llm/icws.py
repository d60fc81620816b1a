"""Near duplicates by improved consistent weighted sampling (ICWS) over TF-IDF shingles.

A shingle is five words; its weight is its frequency in the text times the sum of the inverse document
frequencies of its words, as whole numbers. Word frequencies are counted over all documents. The IDF of
a word saturates: a word in less than ``rarest`` of the documents (one in 10,000) weighs as one in that
share, at every size of the corpus. So the table that workers get holds words of at least that share
only, which are 1/``rarest`` times the mean number of distinct words of a document at most.

ICWS draws ``bands * rows`` samples a text; each sample of two texts is equal with the probability of
their weighted Jaccard similarity. Equal bands make candidates (a *bucket*), and candidates are verified
by the exact weighted Jaccard similarity of whole texts. Rows equal in text are one node (a 64-bit hash).

Links only matter between texts that are not joined yet, so a bucket is done in two steps. First its
members are compared with its *hub*, the one that shares the most buckets with others: in a group of
near copies that is the one with the fewest changes, and most buckets are one component after that.
A bucket that is not keeps a *main* component; every member outside it is compared with all members.
Those comparisons go in tiles of about ``TILE`` texts by as many, cut by a hash, and a tile works all its
overlaps out as products of matrices and gives out a spanning forest only. So every pair of every bucket
is verified or joined over others, however large the bucket is; no pair is ever a row, and no task holds
more than a tile.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.llm.common import HashTable, Words, chunks, documents, grams, map_arrow, mix, salted_join, stored, word_counts

SHINGLE = 5
#: Texts and bytes of text on a side of a tile, about.
TILE, TILE_BYTES = 1024, 2 << 20
_COLUMNS = 2048
_SLOTS = 1 << 16


def _tables(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1) and their logarithms: draws are looked up by 16 bits of a hash."""
    grid = np.linspace(0, 40, 400_001)
    cdf = 1 - np.exp(-grid) * (1 + grid)
    q = np.interp((np.arange(_SLOTS) + 0.5) / _SLOTS, cdf, grid)
    return q.astype(np.float32), np.log(q).astype(np.float32)


_GAMMA, _LN_GAMMA = _tables(0)


class Shingles:
    """Distinct shingles of the texts of a chunk, ordered by text: hash, weight (tf times unit), unit, tf and text index."""

    def __init__(self, w: Words, idf: HashTable):
        word_idf = np.round(idf(w.hash).astype(np.float64) * 1024)
        g = grams(w.hash, SHINGLE)
        inside = w.doc[: len(g)] == w.doc[SHINGLE - 1 :] if len(g) else np.zeros(0, bool)
        total = np.concatenate([[0.0], np.cumsum(word_idf)])
        weight = total[SHINGLE:] - total[:-SHINGLE] if len(g) else np.zeros(0)
        g, weight, doc = g[inside], weight[inside], w.doc[: len(inside)][inside]
        # a text of one to four words is one shingle
        n = np.diff(w.first)
        few = np.flatnonzero((n > 0) & (n < SHINGLE))
        if len(few):
            g = np.concatenate([g, [grams(w.hash[w.first[d] : w.first[d + 1]], int(n[d]))[0] for d in few]])
            weight = np.concatenate([weight, total[w.first[few + 1]] - total[w.first[few]]])
            doc = np.concatenate([doc, few])
        _, at, tf = np.unique(mix(g + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_counts=True)
        order = np.argsort(doc[at].astype(np.uint16) if w.n_docs < 65536 else doc[at], kind="stable")
        at = at[order]
        self.hash, self.doc, self.unit, self.tf = g[at], doc[at], weight[at], tf[order]
        self.weight = self.unit * self.tf


def signatures(s: Shingles, n_docs: int, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(texts that have a shingle, a row of band hashes for each)."""
    docs, first = np.unique(s.doc, return_index=True)
    if not len(docs):
        return docs, np.zeros((0, bands), np.uint64)
    size = np.diff(np.append(first, len(s.doc)))
    ln_w = np.log(s.weight / (SHINGLE * 1024)).astype(np.float32)
    out = np.zeros((len(docs), bands), np.uint64)
    for k in range(bands * rows):
        z = s.hash * np.uint64((0xBF58476D1CE4E5B9 + 2 * 0x632BE59BD9B4E019 * (k + 1)) % (1 << 64) | 1)
        z ^= z >> np.uint64(32)
        z *= np.uint64(0xD6E8FEB86659FD93)
        z ^= z >> np.uint64(29)
        r = _GAMMA[(z >> np.uint64(48)).astype(np.intp)]
        ln_c = _LN_GAMMA[((z >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.intp)]
        beta = (z & np.uint64(0xFFFFFFFF)).astype(np.float32) * np.float32(2**-32)
        t = np.floor(ln_w / r + beta)
        ln_a = ln_c - r * (t - beta + np.float32(1))
        low = np.minimum.reduceat(ln_a, first)
        at = np.flatnonzero(ln_a == np.repeat(low, size))
        _, one = np.unique(s.doc[at], return_index=True)
        at = at[one]
        sample = mix(s.hash[at] + t[at].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        out[:, k // rows] = mix(out[:, k // rows] * np.uint64(31) + sample + np.uint64(k))
    return docs, out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of (sorted hashes, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


def idf_table(docs: DataFrame, rarest: float) -> HashTable:
    """``docs`` has __text. IDF of the words in ``rarest`` of the documents at least; any other has that of this share."""
    counts = stored(word_counts(docs, lower=True, per_document=True))
    n = docs.count()
    rows = counts.filter(F.col("n") >= max(1.0, rarest * n)).toArrow()  # 1 / rarest times a document's mean number of distinct words at most
    words, df = rows.column("h").to_numpy().view(np.uint64), rows.column("n").to_numpy().astype(float)
    return HashTable(words, np.log1p(n / df), float(np.log1p(min(1 / rarest, max(n, 1)))))


def classes(docs: DataFrame, threshold: float = 0.8, bands: int = 10, rows: int = 3, rarest: float = 1e-4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """__id, __t (hash of the text), __class (a text's hash) for each row of ``docs``; see ``near_duplicates``."""
    spark = docs.sparkSession
    own = documents(docs, id_col, text_col).withColumn("__text", F.coalesce("__text", F.lit("")))
    idf = spark.sparkContext.broadcast(idf_table(own, rarest))
    keyed = own.withColumn("__t", F.xxhash64("__text"))

    def sign(batch: pa.RecordBatch):
        for i, j, data, bounds in chunks(batch.column("__text")):
            w = Words(data, bounds, lower=True)
            s = Shingles(w, idf.value)
            who, sig = signatures(s, w.n_docs, bands, rows)
            took = pa.array(i + who)
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(who) + 1, dtype=np.int32) * bands), pa.array(sig.ravel().view(np.int64)))
            yield {
                "t": batch.column("__t").take(took), "id": batch.column("__id").take(took), "bands": values,
                "w": np.bincount(s.doc, s.weight, minlength=w.n_docs)[who], "size": np.diff(bounds)[who].astype(np.int64),
            }

    kind = docs.schema[id_col].dataType.simpleString()
    signed_rows = map_arrow(keyed.select("__id", "__t", "__text"), sign, f"t bigint, id {kind}, bands array<bigint>, w double, size bigint")
    nodes = stored(signed_rows.groupBy("t").agg(F.min("id").alias("id"), F.min(F.struct("bands", "w", "size")).alias("x")).select("t", "id", "x.*"))
    bucket = nodes.select("t", "w", "size", F.posexplode("bands").alias("band", "value")).select("t", "w", "size", F.xxhash64("band", "value").alias("b"))
    shared = bucket.groupBy("b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # one row a text from here on, with the buckets that it shares
    met = salted_join(bucket, shared, ["b"], F.col("t"))
    state = stored(met.groupBy("t", "w", "size").agg(F.sum("n").alias("score"), F.collect_list("b").alias("bs")))
    # the texts themselves, once each, taken from the row of the least id
    wanted = state.select("t").join(nodes.select("t", "id"), "t")
    same = (keyed["__t"] == wanted["t"]) & keyed["__id"].eqNullSafe(wanted["id"])  # both: copies of a text lie apart
    texts = stored(keyed.join(wanted, same).select("__t", "__text").dropDuplicates(["__t"]))
    labels = _joined(state, texts, idf, threshold)
    return salted_join(keyed.select("__id", "__t"), labels.withColumnRenamed("t", "__t"), ["__t"], F.coalesce(F.hash("__id"), F.lit(0)), "left").withColumn("__class", F.coalesce("__class", "__t"))


def _verified(pairs: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are similar enough. One hub ``a`` may stand in most pairs."""

    def verify(batch: pa.RecordBatch):
        known: dict = {}
        table = idf.value

        def shingles(key: int, text: str):
            if key not in known:
                data = np.frombuffer(text.encode(), np.uint8)
                s = Shingles(Words(data, np.array([0, len(data)]), lower=True), table)
                order = np.argsort(s.hash)
                known[key] = s.hash[order], s.weight[order]
            return known[key]

        keep = []
        last = None
        for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "x", "y")), strict=True):
            if a != last:
                known.clear()
                last = a
            keep.append(similarity(shingles(a, x), shingles(b, y)) >= threshold)
            known.pop(b, None)
        mask = pa.array(keep)
        yield {"a": batch.column("a").filter(mask), "b": batch.column("b").filter(mask)}

    left = texts.select(F.col("__t").alias("a"), F.col("__text").alias("x"))
    right = texts.select(F.col("__t").alias("b"), F.col("__text").alias("y"))
    with_b = pairs.join(right, "b")
    both = salted_join(with_b, left, ["a"], F.col("b"))
    return map_arrow(both.select("a", "b", "x", "y"), verify, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """u, c: each node of ``edges`` (a, b) with the least node of its component.

    Labels go to neighbours and then to their labels' labels, until none changes. Without edges it is empty.
    """
    both = stored(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct())
    labels = stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("c")))
    while True:
        seen = salted_join(both, labels.select(F.col("u").alias("v"), "c"), ["v"], F.col("u")).groupBy("u").agg(F.min("c").alias("n"))
        step = labels.join(seen, "u").select("u", F.least("c", "n").alias("c"), F.col("c").alias("was"))
        step = stored(step)
        jump = salted_join(step, step.select(F.col("u").alias("c"), F.col("c").alias("top")), ["c"], F.col("u"))
        new = stored(jump.select("u", F.least("c", "top").alias("c"), "was"))
        if new.filter("c <> was").isEmpty():
            return new.select("u", "c")
        labels = new.select("u", "c")


def _joined(state: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """t, __class for the texts that share a bucket. ``state``: t, w, size, score, bs."""
    members = state.select("t", "w", "score", F.explode("bs").alias("b"))
    hubs = members.groupBy("b").agg(F.max(F.struct("score", "t", "w")).alias("h")).select("b", F.col("h.t").alias("hub"), F.col("h.w").alias("hub_w"))
    # similar texts are of similar weight: the lesser is at least the threshold's share of the larger
    alike = F.least("w", "hub_w") >= (threshold - 1e-9) * F.greatest("w", "hub_w")
    pairs = salted_join(members, hubs, ["b"], F.col("t")).filter((F.col("t") != F.col("hub")) & alike).select(F.col("hub").alias("a"), F.col("t").alias("b")).distinct()
    labels = components(stored(_verified(pairs, texts, idf, threshold)))
    named = stored(state.join(labels.withColumnRenamed("u", "t"), "t", "left").select("t", F.coalesce("c", "t").alias("c"), "size", "bs"))
    merged = components(stored(_tiled(named, texts, idf, threshold)))
    top = salted_join(named.select("t", "c"), merged.select(F.col("u").alias("c"), F.col("c").alias("top")), ["c"], F.col("t"), "left")
    return top.select("t", F.coalesce("top", "c").alias("__class"))


def _tiled(named: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """a, b: components joined by a pair of a bucket that the hubs have left open. ``named``: t, c, size, bs."""
    members = named.select("t", "c", "size", F.explode("bs").alias("b"))
    parts = members.groupBy("b", "c").agg(F.count(F.lit(1)).alias("k"), F.sum("size").alias("s"))
    whole = parts.groupBy("b").agg(F.sum("k").alias("n"), F.sum("s").alias("bytes"), F.max(F.struct("k", "s", "c")).alias("main")).filter("main.k < n")
    cuts = lambda n, size: F.greatest(F.ceil(n / TILE), F.ceil(size / TILE_BYTES)).cast("int")
    open_ = whole.select("b", F.col("main.c").alias("main"), cuts(F.col("n"), F.col("bytes")).alias("blocks"), cuts(F.col("n") - F.col("main.k"), F.col("bytes") - F.col("main.s")).alias("chunks"))
    placed = salted_join(members, open_, ["b"], F.col("t"))
    block, chunk = F.pmod(F.xxhash64("t", F.lit(1)), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("t", F.lit(2)), F.col("chunks")).cast("int")
    every = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(block.alias("i"), j.alias("j"), F.lit(False).alias("outside")))
    outside = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(i.alias("i"), chunk.alias("j"), F.lit(True).alias("outside")))
    roles = F.when(F.col("c") != F.col("main"), F.concat(every, outside)).otherwise(every)
    dealt = placed.select("b", "t", "c", F.explode(roles).alias("x")).select(F.xxhash64("b", "x.i", "x.j").alias("tile"), "t", "c", "x.outside")
    rows = dealt.join(texts.withColumnRenamed("__t", "t"), "t")

    def links(tile: pa.Table) -> pa.Table:
        a, b = tile_links(tile.column("t").to_numpy(), tile.column("c").to_numpy(), tile.column("outside").to_numpy(), tile.column("__text").combine_chunks(), idf.value, threshold)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("tile").applyInArrow(links, "a bigint, b bigint")


def tile_links(t: np.ndarray, c: np.ndarray, outside: np.ndarray, texts: pa.Array, idf: HashTable, threshold: float) -> tuple[list[int], list[int]]:
    """Links (component, component) that join what similar texts of a tile allow: texts that are ``outside`` against all others.

    A weighted Jaccard similarity is that of sets when a shingle that stands k times in a text is k elements; the
    overlaps of two lists of sets are the product of their matrices. All numbers are whole, so sums are exact.
    """
    _, first, node = np.unique(t, return_index=True, return_inverse=True)
    element, doc, unit = [], [], []
    for i, _, data, bounds in chunks(texts.take(pa.array(first))):
        s = Shingles(Words(data, bounds, lower=True), idf)
        copy = np.arange(s.tf.sum()) - np.repeat(np.cumsum(s.tf) - s.tf, s.tf)
        element.append(mix(np.repeat(s.hash, s.tf) + copy.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        doc.append(i + np.repeat(s.doc, s.tf))
        unit.append(np.repeat(s.unit, s.tf))
    element, doc, unit = np.concatenate(element), np.concatenate(doc), np.concatenate(unit)
    weight, own = np.bincount(doc, unit, minlength=len(first)), c[first]
    _, column, times = np.unique(element, return_inverse=True, return_counts=True)
    several = times[column] > 1
    column = (np.cumsum(times > 1) - 1)[column[several]]
    doc, unit = doc[several], unit[several]
    order = np.argsort(column, kind="stable")
    column, doc, unit = column[order], doc[order], unit[order]
    some, few = np.unique(node[~outside]), np.unique(node[outside])
    row_some, row_few = np.full(len(first), -1), np.full(len(first), -1)
    row_some[some], row_few[few] = np.arange(len(some)), np.arange(len(few))
    both = np.zeros((len(some), len(few)))
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        a, b = np.searchsorted(column, [start, start + _COLUMNS])
        x, y = np.zeros((len(some), _COLUMNS)), np.zeros((len(few), _COLUMNS))
        for rows, out, values in ((row_some, x, np.ones(b - a)), (row_few, y, unit[a:b])):
            here = rows[doc[a:b]] >= 0
            out[rows[doc[a:b]][here], column[a:b][here] - start] = values[here]
        both += x @ y.T
    similar = (both / (weight[some][:, None] + weight[few][None] - both) >= threshold) & (own[some][:, None] != own[few][None])
    i, j = np.nonzero(similar)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    out_a, out_b = [], []
    for a, b in np.unique(np.column_stack([own[some][i], own[few][j]]), axis=0).tolist():
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[ra] = rb
            out_a.append(a)
            out_b.append(b)
    return out_a, out_b


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """One row a document: doc_id, class_id (the least id among the rows it is linked to, directly or over others).

    Texts with no word (null and empty ones too) are linked only to equal texts, null counting as
    empty. Texts of one to four words are one shingle: similar if equal but for the case of A-Z. Null ids are
    carried through and never name a class unless it has no other; rows repeated in full are one
    class. Other columns are ignored; an empty table gives an empty result.
    """
    rows = classes(docs, threshold, id_col=id_col, text_col=text_col, **parameters)
    least = rows.groupBy("__class").agg(F.min("__id").alias("__least"))
    return salted_join(rows, least, ["__class"], F.hash("__id", "__t")).select(F.col("__id").alias("doc_id"), F.col("__least").alias("class_id"))


def unique(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """One document of each class with all its columns: that of the least id (any text of it, if ids repeat).

    Null and empty texts are one class; a null id is chosen only where its class has no other; of rows
    repeated in full one stays; an empty table gives an empty result.
    """
    rows = stored(classes(docs, threshold, id_col=id_col, text_col=text_col, **parameters))
    first = rows.groupBy("__class").agg(F.min(F.struct(F.coalesce(F.col("__id").isNull(), F.lit(True)).alias("n"), F.col("__id").alias("i"), F.col("__t").alias("t"))).alias("k"))
    chosen = stored(first.select(F.col("k.i").alias("__i"), F.col("k.t").alias("__k")))
    inner = docs.select(*(docs[c].alias(f"__in_{k}") for k, c in enumerate(docs.columns)), docs[id_col].alias("__id"), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("__t"))
    kept = inner.join(chosen, (F.col("__t") == F.col("__k")) & F.col("__id").eqNullSafe(F.col("__i")), "left_semi")
    twice = rows.groupBy("__id", "__t").count().filter("count > 1").join(chosen, (F.col("__t") == F.col("__k")) & F.col("__id").eqNullSafe(F.col("__i")), "left_semi")
    if not twice.isEmpty():  # rows repeated in id and text: one stays
        kept = kept.dropDuplicates(["__id", "__t"])
    return kept.select(*(F.col(f"__in_{k}").alias(c) for k, c in enumerate(docs.columns)))
