"""Benchmark decontamination by SimHash over item-sized windows.

Items and documents are lower-cased words without ASCII punctuation; a shingle is five words, weighted by its inverse
frequency over all items of the benchmark. For each size of item, the document windows of that size get a 64-bit
SimHash of their weighted shingles. Items are found by a multi-index: the 64 bits are cut into
``BLOCKS`` parts, and fingerprints within ``RADIUS`` of each other differ in at most
RADIUS // BLOCKS bits in some part, so looking all such neighbours of a part up finds all of them.
Candidates within the radius are verified by their exact weighted Jaccard similarity.

Windows are only fingerprinted where they hold a shingle of an item of their size: any other
window has similarity 0 with every such item, so none is lost.

The benchmark is taken in blocks of about ``block_chars`` characters; one block is sent to the workers
at a time, with the frequencies that its own shingles have in the whole benchmark, so results do not
depend on the blocks. Items equal in id and text are one item.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.llm.common import Words, chunks, documents, grams, map_arrow, signed, stored

SHINGLE = 5
RADIUS = 17
BLOCKS = 6
_EDGES = np.linspace(0, 64, BLOCKS + 1).astype(int)


def _parts(fp: np.ndarray) -> list[np.ndarray]:
    return [((fp >> np.uint64(a)) & np.uint64((1 << int(b - a)) - 1)).astype(np.int64) for a, b in zip(_EDGES[:-1], _EDGES[1:], strict=True)]


def signs(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """+weight or -weight for each of 64 bits of each shingle."""
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return (2 * bits.astype(np.int32) - 1) * weights[:, None]


def packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64).ravel()


class Index:
    """Items of one block: their shingles, fingerprints and the multi-index."""

    def __init__(self, texts: list[str], threshold: float, n_items: int | None = None, df: dict[int, int] | None = None):
        """``n_items`` and ``df``: how many items of five words or more the benchmark has, and how many of them hold a shingle; by default those of ``texts``."""
        self.threshold = threshold
        self.words = item_words(pa.array([x or "" for x in texts], pa.string()))
        self.size = np.array([len(h) for h in self.words], np.int64)
        #: items shorter than a shingle are one shingle each: similar only if equal
        self.short = {n: {} for n in range(1, SHINGLE)}
        for i, h in enumerate(self.words):
            if 0 < len(h) < SHINGLE:
                self.short[len(h)].setdefault(int(grams(h, len(h))[0]), []).append(i)
        long = np.flatnonzero(self.size >= SHINGLE)
        sets = {int(i): np.unique(grams(self.words[i], SHINGLE), return_counts=True) for i in long}
        self.shingles, own = np.unique(np.concatenate([s for s, _ in sets.values()]) if sets else np.zeros(0, np.uint64), return_counts=True)
        times = own if df is None else np.array([df[x] for x in self.shingles.tolist()], np.int64)
        total = len(sets) if n_items is None else n_items
        #: whole numbers, so that sums don't depend on their order
        self.weight = np.round(16 * np.log1p(total / np.maximum(times, 1))).astype(np.int32)
        self.default = np.int32(round(16 * np.log1p(max(1, total))))
        self.sets = {i: (s, n, self.weights(s) * n) for i, (s, n) in sets.items()}
        self.items = long
        self.fp = np.zeros(len(long), np.uint64)
        for k, i in enumerate(long):
            s, _, w = self.sets[int(i)]
            self.fp[k] = packed(signs(s, w).sum(0, keepdims=True))[0]
        #: sizes of the items that hold a shingle
        pairs = sorted({(int(x), int(self.size[i])) for i, (s, _, _) in self.sets.items() for x in s})
        keys = np.array([p[0] for p in pairs], np.uint64)
        self.size_of = np.array([p[1] for p in pairs], np.int64)
        self.at = np.searchsorted(keys, self.shingles)
        self.n_sizes = np.diff(np.append(self.at, len(keys)))
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.shingles >> np.uint64(44)] = True
        self.tables = []
        for part, a, b in zip(_parts(self.fp), _EDGES[:-1], _EDGES[1:], strict=True):
            width = int(b - a)
            masks = np.array([sum(1 << x for x in c) for n in range(RADIUS // BLOCKS + 1) for c in combinations(range(width), n)], np.int64)
            value = (part[:, None] ^ masks[None]).ravel()
            order = np.argsort(value, kind="stable")
            self.tables.append((np.searchsorted(value[order], np.arange((1 << width) + 1)), np.repeat(np.arange(len(self.fp)), len(masks))[order]))

    def weights(self, s: np.ndarray) -> np.ndarray:
        if not len(self.shingles):
            return np.full(len(s), self.default)
        k = np.minimum(np.searchsorted(self.shingles, s), len(self.shingles) - 1)
        return np.where(self.shingles[k] == s, self.weight[k], self.default)

    def near(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (fingerprint, item) pairs within the radius."""
        a, b = [], []
        for part, (at, items) in zip(_parts(fp), self.tables, strict=True):
            n = at[part + 1] - at[part]
            who = np.repeat(np.arange(len(fp)), n)
            a.append(who)
            b.append(items[np.repeat(at[part] - np.cumsum(n) + n, n) + np.arange(len(who))])
        a, b = np.concatenate(a), np.concatenate(b)
        close = np.bitwise_count(fp[a] ^ self.fp[b]) <= RADIUS
        pairs = np.unique(np.column_stack([a[close], b[close]]), axis=0) if close.any() else np.zeros((0, 2), int)
        return pairs[:, 0], pairs[:, 1]

    def similarity(self, window: np.ndarray, item: int) -> float:
        s, n, w = self.sets[item]
        t, m = np.unique(window, return_counts=True)
        _, i, j = np.intersect1d(s, t, assume_unique=True, return_indices=True)
        both = int(((w[i] // n[i]) * np.minimum(n[i], m[j])).sum())
        return both / (int(w.sum()) + int((self.weights(t) * m).sum()) - both)

    def matches(self, w: Words) -> Iterator[tuple[int, int, int, float, int]]:
        """(text, item, first word, similarity, distance), each text's best window for an item."""
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for n, items in self.short.items():
            if items and len(w) >= n:
                g = grams(w.hash, n)
                for p in np.flatnonzero(np.isin(g, np.array(list(items), np.uint64)) & (w.doc[: len(g)] == w.doc[n - 1 :])):
                    for i in items[int(g[p])]:
                        d = int(w.doc[p])
                        best.setdefault((d, i), (1.0, -int(p - w.first[d]), 0))
        if len(w) >= SHINGLE and len(self.shingles):
            g = grams(w.hash, SHINGLE)
            may = np.flatnonzero(self.bits[g >> np.uint64(44)])
            k = np.minimum(np.searchsorted(self.shingles, g[may]), len(self.shingles) - 1)
            hit = self.shingles[k] == g[may]
            pos, k = may[hit], k[hit]
            n = self.n_sizes[k]
            size = self.size_of[np.repeat(self.at[k] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            pos = np.repeat(pos, n)
            for length in np.unique(size):
                self._windows(w, g, pos[size == length], int(length), best)
        for (d, i), (s, start, h) in best.items():
            yield d, i, -start, s, h

    def _windows(self, w: Words, g: np.ndarray, pos: np.ndarray, size: int, best: dict) -> None:
        span = size - SHINGLE + 1
        starts = np.unique((pos[:, None] - np.arange(span)[None]).ravel())
        starts = starts[(starts >= 0) & (starts + size <= len(w))]
        starts = starts[w.doc[starts] == w.doc[starts + size - 1]]
        if not len(starts):
            return
        used = np.zeros(len(g) + 1, np.int32)
        np.add.at(used, starts, 1)
        np.add.at(used, starts + span, -1)
        used = np.flatnonzero(np.cumsum(used)[:-1] > 0)
        for part in np.array_split(starts, len(used) // 200_000 + 1):  # bounds the table of signs
            own = used[np.searchsorted(used, part[0]) : np.searchsorted(used, part[-1] + span)]
            sums = np.zeros((len(own) + 1, 64), np.int64)
            np.cumsum(signs(g[own], self.weights(g[own]).astype(np.int32)), axis=0, out=sums[1:])
            at = np.searchsorted(own, part)
            fp = packed(sums[at + span] - sums[at])
            for a, b in zip(*self.near(fp), strict=True):
                item = int(self.items[b])
                if self.size[item] != size:
                    continue
                start = int(part[a])
                s = self.similarity(g[start : start + span], item)
                if s >= self.threshold:
                    d = int(w.doc[start])
                    found = (s, -int(start - w.first[d]), int(np.bitwise_count(fp[a] ^ self.fp[b])))
                    if found[:2] > best.get((d, item), (0.0, 0, 0))[:2]:
                        best[(d, item)] = found


def item_words(texts: pa.Array) -> list[np.ndarray]:
    """The word hashes of each item."""
    out: list[np.ndarray] = []
    for _, _, data, bounds in chunks(pc.utf8_lower(texts)):
        w = Words(data, bounds, lower=True, marks=True)
        out += [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    return out


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int) -> Iterator[tuple]:
    """(ids, texts, items of the whole benchmark, how many of them hold each shingle of the block), block by block; each fits the driver and a broadcast."""
    items = benchmark.select(benchmark[item_col].alias("i"), benchmark[text_col].alias("t")).filter(F.col("t").isNotNull()).distinct()
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = int(total // block_chars) + 1
    items = items.withColumn("k", F.pmod(F.xxhash64("i", "t"), F.lit(n)).cast("int"))

    def cut(batch: pa.RecordBatch):
        sets = [np.unique(grams(h, SHINGLE)) for h in item_words(batch.column("t"))]
        size = np.array([len(s) for s in sets], np.int64)
        first = np.zeros(size.sum(), np.int64)
        first[(np.cumsum(size) - size)[size > 0]] = 1
        yield {"k": np.repeat(batch.column("k").to_numpy(), size), "h": signed(np.concatenate(sets)), "first": first}

    rows = stored(map_arrow(items.select("k", "t"), cut, "k int, h bigint, first bigint"))
    n_items = rows.agg(F.sum("first")).first()[0] or 0
    counts = stored(rows.select("k", "h").distinct().join(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")), "h"))
    for k in range(n):
        own, df = items.filter(F.col("k") == k).orderBy("i", "t").collect(), counts.filter(F.col("k") == k).toArrow()
        yield [r["i"] for r in own], [r["t"] for r in own], n_items, dict(zip(df.column("h").to_numpy().view(np.uint64).tolist(), df.column("n").to_pylist(), strict=True))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, block_chars: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row a document and item it holds: doc_id, item_id, start_word, n_words, similarity, distance.

    Items without a word match nothing; items of fewer than five words match only where their words
    stand in full. Null texts hold nothing. Repeated rows are judged row for row; null ids are
    carried through; other columns are ignored; without documents or items the result is empty.
    """
    spark = docs.sparkSession
    own = documents(docs, id_col, text_col)
    kinds = f"doc_id {docs.schema[id_col].dataType.simpleString()}, item_id {benchmark.schema[item_col].dataType.simpleString()}"
    schema = f"{kinds}, start_word bigint, n_words bigint, similarity double, distance int"
    out = None
    for block in blocks(benchmark, item_col, item_text_col, block_chars):
        items = spark.sparkContext.broadcast(block)  # block_chars, about
        found = map_arrow(own, _finder(items, threshold, benchmark.schema[item_col].dataType), schema)
        out = found if out is None else out.unionByName(found)
    return out


def _finder(items, threshold: float, item_type):
    index: list[Index] = []

    def find(batch: pa.RecordBatch):
        if not index:
            index.append(Index(items.value[1], threshold, *items.value[2:]))
        rows, found = [], []
        for i, _, data, bounds in chunks(pc.utf8_lower(batch.column("__text"))):
            for d, *match in index[0].matches(Words(data, bounds, lower=True, marks=True)):
                rows.append(i + d)
                found.append(match)
        if rows:
            from pyspark.sql.pandas.types import to_arrow_type

            item, start, s, h = zip(*found, strict=True)
            yield {
                "doc_id": batch.column("__id").take(pa.array(rows)),
                "item_id": pa.array([items.value[0][i] for i in item], to_arrow_type(item_type)),
                "start_word": np.array(start, np.int64),
                "n_words": index[0].size[list(item)],
                "similarity": np.array(s),
                "distance": np.array(h, np.int32),
            }

    return find


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, block_chars: int = 4_000_000, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns; rows are dropped where they are read, without a join.

    Null and empty texts hold nothing and stay; rows repeated in full are judged row for row; null ids and any
    other columns are carried through; without items all documents stay; an empty table gives an empty result.
    """
    out = docs
    for block in blocks(benchmark, item_col, item_text_col, block_chars):
        items = docs.sparkSession.sparkContext.broadcast(block)
        out = out.mapInArrow(_keeper(items, threshold, docs.columns.index(text_col)), docs.schema)
    return out


def _keeper(items, threshold: float, text_at: int):
    def keep(batches):
        index = None
        for batch in batches:
            index = index or Index(items.value[1], threshold, *items.value[2:])
            clean = np.ones(batch.num_rows, bool)
            for i, _, data, bounds in chunks(pc.utf8_lower(batch.column(text_at))):
                for d, *_ in index.matches(Words(data, bounds, lower=True, marks=True)):
                    clean[i + d] = False
            yield batch.filter(pa.array(clean))

    return keep
