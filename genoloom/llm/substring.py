"""Substring dedup: words covered by a window of 35 words that also starts elsewhere are removed.

Every window of ``window`` words has an *anchor*: the least hash among its 8-grams (the leftmost, if
equal). Equal windows have equal anchors, so only windows whose anchor occurs twice or more can be
repeated, and all places a window can match have the same anchor. That deals the text into shards:
a shard holds whole anchors, and for each occurrence the piece of text its windows cover. Each
shard gets a compressed FM-index (``fmindex``, a wavelet matrix), and the pieces are streamed through it: backward
search gives, for each window's end, how many words before it occur at least twice in the shard
(equal pieces are stored once, with a weight). Windows whose statistic reaches the threshold are
reported.

Rows of equal text are one text (a 64-bit hash): with two rows or more all its windows are
repeated, and it is searched once for the sake of others. An anchor with more than ``hot``
occurrences is not gathered in a shard: its pieces are counted by anchor and hash, with partial sums,
and equal pieces are repeated as a whole; the windows of distinct pieces are counted in the same way.
That decides the same question exactly for any number of occurrences.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.llm.common import Words, chunks, documents, grams, map_arrow, parallelism, salted_join, signed, stored
from genoloom.llm.fmindex import FMIndex

GRAM = 8
#: Words of one shard's index, about.
SHARD_WORDS = 400_000


def anchors(w: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(8-gram hashes, window starts, position of each window's anchor)."""
    if len(w) < window:
        return np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int)
    g = grams(w.hash, GRAM)
    span = window - GRAM + 1
    at, width = np.arange(len(g)), 1
    while width < span:
        step = min(width, span - width)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(g[a] <= g[b], a, b)
        width += step
    starts = np.flatnonzero(w.doc[: len(at)] == w.doc[window - 1 : window - 1 + len(at)])
    return g, starts, at[starts]


def _occurrences(docs: DataFrame, window: int) -> DataFrame:
    """anchor, t: a row for each place that is some window's anchor. ``docs`` has __t, __text."""

    def find(batch: pa.RecordBatch):
        key = batch.column("__t").to_numpy()
        for i, _, data, bounds in chunks(batch.column("__text")):
            w = Words(data, bounds)
            g, _, at = anchors(w, window)
            places = np.unique(at)
            yield {"anchor": signed(g[places]), "t": key[i + w.doc[places]]}

    return map_arrow(docs.select("__t", "__text"), find, "anchor bigint, t bigint")


def _pieces(texts: DataFrame, window: int) -> DataFrame:
    """The pieces of text at repeated anchors. ``texts``: t, text, cold and hot (the anchors' hashes).

    A cold anchor gives anchor, t, start, n (windows) and the piece's words as 64-bit hashes; a hot one the
    hashes of its windows, and of all of them.
    """

    def cut(batch: pa.RecordBatch):
        t = batch.column("t").to_numpy()
        cold, hot = batch.column("cold").to_pylist(), batch.column("hot").to_pylist()
        out: dict[str, list] = {k: [] for k in ("anchor", "t", "start", "n", "piece", "windows", "words")}
        for i, j, data, bounds in chunks(batch.column("text")):
            w = Words(data, bounds)
            g, starts, at = anchors(w, window)
            first = w.first
            full = grams(w.hash, window)
            cut_at = np.searchsorted(starts, first)
            for d in range(j - i):
                s, a = starts[cut_at[d] : cut_at[d + 1]], at[cut_at[d] : cut_at[d + 1]]
                if not len(s):
                    continue
                own = g[a].view(np.int64)
                is_cold, is_hot = (np.isin(own, np.array(x[i + d], np.int64)) for x in (cold, hot))
                # windows of one anchor follow each other
                edge = np.flatnonzero(np.diff(a, prepend=-1) != 0)
                for b, e in zip(edge, np.append(edge[1:], len(a)), strict=True):
                    if not (is_cold[b] or is_hot[b]):
                        continue
                    out["anchor"].append(int(own[b]))
                    out["t"].append(int(t[i + d]))
                    out["start"].append(int(s[b] - first[d]))
                    out["n"].append(int(e - b))
                    out["words"].append(w.hash[s[b] : s[b] + (e - b) + window - 1].tobytes() if is_cold[b] else None)
                    windows = full[s[b] : s[b] + (e - b)].view(np.int64) if is_hot[b] else None
                    out["windows"].append(windows)
                    out["piece"].append(int(grams(windows.view(np.uint64), len(windows))[0].view(np.int64)) if is_hot[b] else None)
        kinds = {"anchor": pa.int64(), "t": pa.int64(), "start": pa.int32(), "n": pa.int32(), "piece": pa.int64(), "windows": pa.list_(pa.int64()), "words": pa.binary()}
        yield {k: pa.array(v, kinds[k]) for k, v in out.items()}

    return map_arrow(texts, cut, "anchor bigint, t bigint, start int, n int, piece bigint, windows array<bigint>, words binary")


def search(pieces: list[tuple[bytes, int]], window: int) -> list[np.ndarray]:
    """For distinct (words, weight): which of its windows occur twice or more among all of them."""
    words = [np.frombuffer(p, np.uint64) for p, _ in pieces]
    size = np.array([len(x) for x in words])
    bounds = np.concatenate([[0], np.cumsum(size)])
    weight = np.array([n for _, n in pieces])
    index = FMIndex(np.concatenate(words), bounds, weight, window)
    n_windows = size - window + 1
    alone = np.flatnonzero(weight == 1)
    ends = np.concatenate([bounds[k] + window + np.arange(n_windows[k]) for k in alone]) if len(alone) else np.zeros(0, int)
    reach = index.repeated_from(ends, np.full(len(ends), window)) >= window
    out = [np.ones(n, bool) for n in n_windows]
    cut = np.concatenate([[0], np.cumsum(n_windows[alone])])
    for i, k in enumerate(alone):
        out[k] = reach[cut[i] : cut[i + 1]]
    return out


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(start, length) of the runs of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _searched(pieces: DataFrame, window: int, shard_words: int) -> DataFrame:
    """t, start, n: repeated windows of cold anchors; one index for each stretch of whole anchors of a partition."""

    def run(batches):
        shard: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
        size, last = 0, None

        def report():
            distinct = list(shard)
            # an anchor met once has no other place: nothing to search
            rows: dict[str, list] = {"t": [], "start": [], "n": []}
            for (key, places), flags in zip(shard.items(), search([(k[1], len(shard[k])) for k in distinct], window), strict=True):
                for start, n in runs(flags):
                    for t, at in places:
                        rows["t"].append(t)
                        rows["start"].append(at + start)
                        rows["n"].append(n)
            return pa.RecordBatch.from_arrays([pa.array(rows["t"], pa.int64()), pa.array(rows["start"], pa.int32()), pa.array(rows["n"], pa.int32())], names=["t", "start", "n"])

        for batch in batches:
            for anchor, t, start, words in zip(*(batch.column(c).to_pylist() for c in ("anchor", "t", "start", "words")), strict=True):
                if size >= shard_words and anchor != last:
                    yield report()
                    shard.clear()
                    size = 0
                places = shard.setdefault((anchor, words), [])
                if not places:
                    size += len(words) // 8
                places.append((t, start))
                last = anchor
        if shard:
            yield report()

    n = parallelism(pieces.sparkSession)
    dealt = pieces.filter("piece is null").select("anchor", "t", "start", "words").repartition(n, "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, "t bigint, start int, n int")


def _tables(docs: DataFrame, window: int, hot: int, shard_words: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: __id, __t, __text; copies: t, m, id; found: t, text, ranges of repeated windows)."""
    own = documents(docs, id_col, text_col).withColumn("__text", F.coalesce("__text", F.lit(""))).withColumn("__t", F.xxhash64("__text"))
    copies = own.groupBy("__t").agg(F.count(F.lit(1)).alias("m"), F.min("__id").alias("id")).withColumnRenamed("__t", "t")
    places = stored(_occurrences(own, window))
    repeated = places.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    # joined by another expression than they are counted by: both sides are dealt anew, and a hot anchor's side can be split
    turn = lambda c: F.col(c).bitwiseXOR(F.lit(0x5DEECE66D))
    both = places.select("t", turn("anchor").alias("x")).join(repeated.select(turn("anchor").alias("x"), "k"), "x")
    pick = lambda cond: F.collect_set(F.when(cond, turn("x")))
    wanted = both.groupBy("t").agg(pick(F.col("k") <= hot).alias("cold"), pick(F.col("k") > hot).alias("hot"))
    wanted = stored(wanted.join(copies, "t").select("t", "id", "m", "cold", "hot"))
    same = (own["__t"] == wanted["t"]) & own["__id"].eqNullSafe(wanted["id"])  # both: copies of a text lie apart
    texts = stored(own.join(wanted, same).select("t", "m", F.col("__text").alias("text"), "cold", "hot"))
    pieces = stored(_pieces(texts.select("t", "text", "cold", "hot"), window))
    cold = _searched(pieces, window, shard_words)
    frequent = pieces.filter("piece is not null")
    kinds = stored(frequent.groupBy("anchor", "piece").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("t", "start")).alias("at"), F.first("windows").alias("windows")))
    whole = salted_join(frequent.select("anchor", "piece", "t", "start", "n"), kinds.filter("k > 1").select("anchor", "piece"), ["anchor", "piece"], F.xxhash64("t", "start"))
    each = kinds.select("anchor", "k", "at", F.posexplode("windows").alias("i", "window"))
    many = each.groupBy("anchor", "window").agg(F.sum("k").alias("c")).filter("c > 1").select("anchor", "window")
    alone = salted_join(each.filter("k = 1"), many, ["anchor", "window"], F.xxhash64("at", "i"))
    often = whole.select("t", "start", "n").union(alone.select("at.t", F.col("at.start") + F.col("i"), F.lit(1)))
    ranges = cold.union(often).groupBy("t").agg(F.sort_array(F.collect_set(F.struct("start", "n"))).alias("ranges"))
    found = texts.filter("m = 1").select("t", "text").join(ranges, "t")
    return own, copies, found


def covered(n_words: int, ranges: list, window: int) -> np.ndarray:
    """Which words stand in a repeated window; ranges: (first start, number of starts)."""
    step = np.zeros(n_words + 1, np.int32)
    for start, n in ranges:
        step[start] += 1
        step[min(n_words, start + n - 1 + window)] -= 1
    return np.cumsum(step)[:-1] > 0


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def substring_dedup(docs: DataFrame, window: int = 35, hot: int = 1000, shard_words: int = SHARD_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by a space).

    Null texts have no words. Texts of fewer words than a window are kept whole. Rows repeated in full
    remove each other, as do rows that differ in id only. Null and repeated ids are carried through,
    row for row; other columns are ignored; an empty table gives an empty result.
    """
    own, copies, found = _tables(docs, window, hot, shard_words, id_col, text_col)

    def count(batch: pa.RecordBatch):
        n, sha = [], []
        for _, j, data, bounds in chunks(batch.column("__text")):
            w = Words(data, bounds, hashed=False)
            for a, b in zip(w.first[:-1], w.first[1:], strict=True):
                n.append(int(b - a))
                sha.append(_digest([w.text(k) for k in range(a, b)]))
        yield {"id": batch.column("__id"), "t": batch.column("__t"), "n_words": pa.array(n, pa.int64()), "sha": pa.array(sha, pa.string())}

    def remove(batch: pa.RecordBatch):
        n, sha = [], []
        ranges = batch.column("ranges").to_pylist()
        for i, _, data, bounds in chunks(batch.column("text")):
            w = Words(data, bounds, hashed=False)
            for d, (a, b) in enumerate(zip(w.first[:-1], w.first[1:], strict=True)):
                gone = covered(b - a, [(r["start"], r["n"]) for r in ranges[i + d]], window)
                n.append(int(gone.sum()))
                sha.append(_digest([w.text(a + k) for k in np.flatnonzero(~gone)]))
        yield {"t": batch.column("t"), "gone": pa.array(n, pa.int64()), "left": pa.array(sha, pa.string())}

    kind = docs.schema[id_col].dataType.simpleString()
    rows = map_arrow(own.select("__id", "__t", "__text"), count, f"id {kind}, t bigint, n_words bigint, sha string")
    parts = map_arrow(found, remove, "t bigint, gone bigint, left string")
    verdict = copies.filter("m > 1").select("t", F.lit(None).cast("bigint").alias("gone"), F.lit(None).cast("string").alias("left")).union(parts).withColumn("hit", F.lit(True))
    out = salted_join(rows, verdict, ["t"], F.hash("id"), "left")
    whole = F.col("hit") & F.col("gone").isNull() & (F.col("n_words") >= window)
    return out.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0).cast("bigint"))).alias("n_removed"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("left", "sha")).alias("kept_sha256"),
    )


def cut_repeats(docs: DataFrame, window: int = 35, hot: int = 1000, shard_words: int = SHARD_WORDS, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The documents with all their columns, repeated words cut out of their texts; a document with no word left goes.

    So null and empty texts go, and so do rows of equal text that have a window's words or more. Null ids and
    any other columns are carried through; ``length_col``, where there is one, is set anew; an empty table gives
    an empty result.
    """
    own, copies, found = _tables(docs, window, hot, shard_words, id_col, text_col)

    def remove(batch: pa.RecordBatch):
        left = []
        ranges = batch.column("ranges").to_pylist()
        for i, _, data, bounds in chunks(batch.column("text")):
            w = Words(data, bounds, hashed=False)
            for d, (a, b) in enumerate(zip(w.first[:-1], w.first[1:], strict=True)):
                out, at = [], int(bounds[d])
                for start, n in runs(covered(b - a, [(r["start"], r["n"]) for r in ranges[i + d]], window)):
                    out.append(data[at : w.starts[a + start]].tobytes())
                    after = a + start + n  # what follows the last word up to the next goes with it
                    at = int(w.starts[after]) if after < b else int(w.ends[after - 1])
                out.append(data[at : bounds[d + 1]].tobytes())
                left.append(b"".join(out).decode())
        yield {"t": batch.column("t"), "left": pa.array(left, pa.string())}

    parts = map_arrow(found, remove, "t bigint, left string")
    verdict = copies.filter("m > 1").select("t", F.lit(None).cast("string").alias("left")).union(parts).withColumn("hit", F.lit(True))
    rows = docs.select(*(docs[c].alias(f"__in_{k}") for k, c in enumerate(docs.columns)), F.coalesce(docs[text_col], F.lit("")).alias("__text"), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("t"), docs[id_col].alias("__id"))
    out = salted_join(rows, verdict, ["t"], F.hash("__id"), "left")
    n_words = F.size(F.filter(F.split("__text", r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    text = F.when(F.col("hit") & F.col("left").isNull(), F.when(n_words >= window, F.lit("")).otherwise(F.col("__text"))).otherwise(F.coalesce("left", "__text"))
    out = out.withColumn("__new", text).filter(F.col("__new").rlike(r"[^\x20\x09-\x0D]"))
    new = {text_col: F.col("__new"), length_col: F.length("__new").cast("bigint")}
    return out.select(*(new.get(c, F.col(f"__in_{k}")).alias(c) for k, c in enumerate(docs.columns)))


#: Under DuckDB: a window's words as text are its identity.
OP8_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT rid, i, array_to_string(ws[i:i + 34], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)),
r AS (SELECT DISTINCT rid, i + j AS k FROM (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY g) AS c FROM p) WHERE c > 1), (SELECT unnest(range(35)) AS j)),
w AS (SELECT rid, unnest(range(1, len(ws) + 1)) AS k, unnest(ws) AS x FROM d),
k AS (SELECT w.rid, string_agg(x, ' ' ORDER BY w.k) AS t FROM w ANTI JOIN r ON w.rid = r.rid AND w.k = r.k GROUP BY 1),
n AS (SELECT rid, count(*) AS n FROM r GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid) LEFT JOIN n USING (rid)
"""
