"""What the text operators share: row helpers on the Spark side, word hashing on the numpy side.

A *word* is a maximal run of characters outside ``[\\x20\\x09-\\x0D]``. All separators are ASCII,
so words can be cut on UTF-8 bytes and no Python string is made for them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separator class for Java regular expressions.
WS = r"[\x20\x09-\x0D]+"
#: Bytes of text handled at once by the numpy kernels; documents are never cut.
CHUNK_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_IS_SEP = np.zeros(256, bool)
_IS_SEP[[32, 9, 10, 11, 12, 13]] = True
#: Everything but letters, digits and bytes of non-ASCII characters.
_IS_MARK = ~np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the longest table so far is kept."""
    table = _powers.get(base)
    if table is None or len(table) < n:
        table = np.full(max(n, CHUNK_BYTES + 64), base, np.uint64)
        table[0] = 1
        np.cumprod(table, out=table)
        if len(table) <= 4 * CHUNK_BYTES:
            _powers[base] = table
    return table[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """Words of consecutive texts: byte ranges, text index and 64-bit hash of each; ``marks``: ASCII marks separate words too."""

    __slots__ = ("data", "starts", "ends", "doc", "hash", "first", "n_docs")

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool = False, hashed: bool = True, marks: bool = False):
        self.data, self.n_docs = data, len(bounds) - 1
        sep = (_IS_MARK if marks else _IS_SEP)[data]
        solid = ~sep
        start, last = solid.copy(), solid.copy()
        start[1:] &= sep[:-1]
        last[:-1] &= sep[1:]
        inner = bounds[1:-1]
        begin = inner[inner < len(data)]
        start[begin] = solid[begin]
        end = inner[inner > 0] - 1
        last[end] = solid[end]
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(last) + 1
        #: first[d] .. first[d + 1]: the words of text d
        self.first = np.searchsorted(self.starts, bounds)
        self.doc = np.repeat(np.arange(self.n_docs), np.diff(self.first))
        if hashed:
            table = _BYTE_LOWER if lower else _BYTE
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(table[data] * powers(_P, len(data)), out=total[1:])
            h = (total[self.ends] - total[self.starts]) * powers(_P_INV, len(data) + 1)[self.starts]
            self.hash = mix(h + (self.ends - self.starts).astype(np.uint64))

    def __len__(self) -> int:
        return len(self.starts)

    def tagged(self) -> np.ndarray:
        """Hashes whose low five bits are a class of the word's last two bytes (lower-cased)."""
        last = self.data[self.ends - 1] | np.uint8(32)
        previous = np.where(self.ends - self.starts > 1, self.data[np.maximum(self.ends - 2, 0)] | np.uint8(32), np.uint8(0))
        ending = mix(last.astype(np.uint64) * np.uint64(256) + previous) & np.uint64(31)
        return (self.hash & ~np.uint64(31)) | ending

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words (entry i: words i .. i+n-1); texts' bounds are not looked at."""
    size = max(0, len(h) - n + 1)
    out = np.zeros(size, np.uint64)
    for j in range(n):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += h[j : j + size]
    return mix(out)


def string_parts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of a string column; null is the empty text."""
    col = col.fill_null("") if col.null_count else col
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    buffers = col.buffers()
    bounds = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(col: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, bounds) for runs of whole texts of about ``size`` bytes."""
    data, bounds = string_parts(col)
    i, n = 0, len(bounds) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(bounds, bounds[i] + size, "right")) - 1))
        yield i, j, data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        i = j


def signed(x: np.ndarray) -> pa.Array:
    """64-bit hashes as a BIGINT column."""
    return pa.array(x.view(np.int64))


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """Map record batches; ``f`` yields dicts of Arrow arrays or numpy arrays in the order of ``schema``."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                for columns in f(batch):
                    arrays = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in columns.values()]
                    yield pa.RecordBatch.from_arrays(arrays, names=list(columns))

    return df.mapInArrow(run, schema)


def bucket(col: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    col = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def documents(docs: DataFrame, id_col: str, text_col: str, **more: str) -> DataFrame:
    """Only the columns that an operator needs, under names of its own (``__id``, ``__text``, ...)."""
    cols = {"__id": id_col, "__text": text_col, **{f"__{k}": v for k, v in more.items()}}
    return docs.select(*(docs[v].alias(k) for k, v in cols.items()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def salted_join(big: DataFrame, small: DataFrame, key: list[str], spread: Column, how: str = "inner", salts: int | None = None) -> DataFrame:
    """Equi-join where one key may hold a large part of ``big``; ``small`` has a row or so a key.

    Rows of ``big`` get a salt from ``spread``; ``small`` is copied only to the (key, salt) pairs
    that occur, so that a cold key costs one copy and a hot one at most ``salts``.
    Keys must not be null.
    """
    salts = salts or max(16, parallelism(big.sparkSession))
    big = big.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    need = big.select(*key, "__salt").distinct()
    return big.join(need.join(small, key, "inner"), [*key, "__salt"], how).drop("__salt")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines see; one of this machine only where the session names none and the master is local (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="genoloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table written once to the shared folder: lineage ends there, and later reads take only the columns they need."""
    import uuid

    path = f"{shared_folder(df.sparkSession)}/genoloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class HashTable:
    """64-bit hash -> float32, for vectorised look-ups; entries that collide go to further layers."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, default: float):
        self.default, self.layers = np.float32(default), []
        keys, first = np.unique(np.asarray(keys, np.uint64), return_index=True)
        values = np.asarray(values, np.float32)[first]
        bits = max(8, int(np.ceil(np.log2(4 * len(keys) + 1))))
        while len(keys):
            shift = np.uint64(max(0, 64 - bits - 3 * len(self.layers)))
            slot = (keys >> shift) & np.uint64((1 << bits) - 1)
            _, at = np.unique(slot, return_index=True)
            own, val = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.float32)
            own[slot[at]], val[slot[at]] = keys[at], values[at]
            self.layers.append((shift, np.uint64((1 << bits) - 1), own, val))
            rest = np.ones(len(keys), bool)
            rest[at] = False
            keys, values = keys[rest], values[rest]
            bits = max(8, bits - 1)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), self.default, np.float32)
        for shift, mask, own, val in self.layers:
            slot = (h >> shift) & mask
            found = own[slot] == h
            out[found] = val[slot[found]]
        return out


def word_counts(docs: DataFrame, lower: bool = False, per_document: bool = False, tagged: bool = False, limit: int = 1_500_000) -> DataFrame:
    """h, n: for each word's hash its occurrences, or the number of texts that hold it. ``docs`` has __text.

    Each partition merges its own counts (up to ``limit`` words at a time) before they are shuffled.
    """

    def run(batches):
        keys, sums, size = [], [], 0

        def merged():
            k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            return k, np.bincount(inverse, np.concatenate(sums)).astype(np.int64)

        for batch in batches:
            for _, _, data, bounds in chunks(batch.column(0)):
                w = Words(data, bounds, lower)
                h = w.tagged() if tagged else w.hash
                if per_document and len(h):
                    _, at = np.unique(mix(h + w.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
                    h = h[at]
                k, n = np.unique(h, return_counts=True)
                keys.append(k)
                sums.append(n)
                size += len(k)
                if size > 2 * limit:
                    k, n = merged()
                    keys, sums, size = [k], [n], len(k)
                    if size > limit:
                        yield pa.RecordBatch.from_arrays([signed(k), pa.array(n)], names=["h", "n"])
                        keys, sums, size = [], [], 0
        if keys:
            k, n = merged()
            yield pa.RecordBatch.from_arrays([signed(k), pa.array(n)], names=["h", "n"])

    return docs.select("__text").mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(hashes, counts) of the most frequent words, ``size`` at most, and the count below which words are left out.

    The cut is a whole step of a logarithmic scale of counts, so words of equal count stand on one side.
    """
    step = F.floor(F.log2("n") * 16)
    bins = counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("k")).collect()  # a row for each step: under a thousand
    cut, total = None, 0
    for s, k in sorted(((r[0], r[1]) for r in bins), reverse=True):
        if total + k > size:
            break
        total, cut = total + k, s
    if cut is None:
        return np.zeros(0, np.uint64), np.zeros(0), max((2 ** ((r[0] + 1) / 16) for r in bins), default=1.0)
    rows = counts.filter(step >= cut).toArrow()
    return rows.column("h").to_numpy().view(np.uint64), rows.column("n").to_numpy().astype(float), float(max(1.0, 2 ** (cut / 16)))
