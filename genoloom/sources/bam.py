"""Binary aligned reads (BAM) without a native library: ranges of blocks are decoded where they lie, and written by Spark's writer.

A file is cut into byte ranges. A task inflates the blocks that begin in its range, finds the first record there by
its form (fields, name, tags, and the records behind it), and decodes every record that begins in the range. It also
looks for the first record of the next range in the way the next task does, and fails if that is not where its own
records end; so each start is proven, from the header on, and no record is lost or read twice.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.sources.sinks import _renamed

# fixed values of the format
MAGIC = b"\x1f\x8b\x08\x04"
EOF_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BLOCK_BYTES = 65280
CIGAR_OPS = "MIDNSHP=X"
BASES = "=ACMGRSVTWYHKDBN"
SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
CODES = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}

#: Records behind a presumed start that must be records too.
CHAIN = 16
RANGE_BYTES = 64 << 20
ROW = pa.schema([
    ("name", pa.string()), ("flag", pa.int32()), ("contig", pa.string()), ("pos", pa.int64()), ("mapq", pa.int32()), ("cigar", pa.string()), ("seq", pa.string()), ("qual", pa.string()),
    ("tags", pa.map_(pa.string(), pa.string())),
])
ROW_DDL = "name string, flag int, contig string, pos bigint, mapq int, cigar string, seq string, qual string, tags map<string,string>"
PAIRS = [BASES[b >> 4] + BASES[b & 15] for b in range(256)]
UP33 = bytes((b + 33) % 256 for b in range(256))
DOWN33 = bytes((b - 33) % 256 for b in range(256))
NIBBLES = {c: i for i, c in enumerate(BASES)} | {c.lower(): i for i, c in enumerate(BASES)}


class _Stream:
    """The inflated bytes of the blocks from the first one at or behind ``start``; ``buf`` grows on demand."""

    def __init__(self, path: str, start: int):
        system, inner = arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path)
        self.file = system.open_input_file(inner)
        self.size = self.file.size()
        self.buf = bytearray()
        self.blocks: list[tuple[int, int]] = []  # (place in the inflated bytes, place in the file) of blocks with content
        self.raw, self.raw_at = b"", start
        self.next = self._first(start)

    def _bytes(self, at: int, n: int) -> bytes:
        """``n`` bytes of the file from ``at`` on, fewer at its end; ``at`` never goes back by more than a read."""
        if at < self.raw_at or at + n > self.raw_at + len(self.raw):
            self.file.seek(at)
            self.raw, self.raw_at = self.file.read(max(n, 1 << 20)), at
        return self.raw[at - self.raw_at : at - self.raw_at + n]

    def _block(self, at: int) -> int | None:
        """The size of the block at ``at``, None if there is none."""
        head = self._bytes(at, 12)
        if len(head) < 12 or head[:4] != MAGIC:
            return None
        extra = self._bytes(at + 12, struct.unpack_from("<H", head, 10)[0])
        k = 0
        while k + 4 <= len(extra):
            n = struct.unpack_from("<H", extra, k + 2)[0]
            if extra[k : k + 2] == b"BC" and n == 2 and k + 6 <= len(extra):
                return struct.unpack_from("<H", extra, k + 4)[0] + 1
            k += 4 + n
        return None

    def _first(self, start: int) -> int:
        """The place of the first block from ``start`` on: one that another block or the file's end follows."""
        if start == 0:
            return 0
        at = start
        while at < self.size:
            window = self._bytes(at, 1 << 17)
            k = window.find(MAGIC)
            if k < 0:
                at += max(len(window) - 3, 1)
                continue
            at += k
            n = self._block(at)
            if n and (at + n == self.size or self._block(at + n)):
                try:
                    self._inflated(at, n)
                    return at
                except (zlib.error, ValueError):
                    pass
            at += 1
        return self.size

    def _inflated(self, at: int, n: int) -> bytes:
        block = self._bytes(at, n)
        head = 12 + struct.unpack_from("<H", block, 10)[0]
        out = zlib.decompress(block[head:-8], -15)
        check, length = struct.unpack_from("<II", block, len(block) - 8)
        if len(out) != length or zlib.crc32(out) != check:
            raise ValueError(f"Damaged block at byte {at}")
        return out

    def more(self) -> bool:
        """One more block with content; False at the end of the file."""
        while self.next < self.size:
            at, n = self.next, self._block(self.next)
            if not n or at + n > self.size:
                raise ValueError(f"No block at byte {at}")
            data = self._inflated(at, n)
            self.next = at + n
            if data:
                self.blocks.append((len(self.buf), at))
                self.buf += data
                return True
        return False

    def has(self, end: int) -> bool:
        """Whether there are bytes up to ``end``."""
        while len(self.buf) < end:
            if not self.more():
                return False
        return True

    def place(self, k: int) -> tuple[int, int]:
        """(block's place in the file, place in the block) of the k-th inflated byte; the file's size at its end."""
        if not self.has(k + 1):
            return self.size, 0
        lo, hi = 0, len(self.blocks)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.blocks[mid][0] <= k else (lo, mid)
        return self.blocks[lo][1], k - self.blocks[lo][0]

    def drop(self, k: int) -> None:
        """Forget the bytes before ``k``; places count from there on."""
        del self.buf[:k]
        self.blocks = [(a - k, p) for i, (a, p) in enumerate(self.blocks) if i + 1 == len(self.blocks) or self.blocks[i + 1][0] > k]


def _head(stream: _Stream) -> tuple[list[tuple[str, int]], str, int]:
    """(contigs with lengths, header text, place of the first record)."""
    if not stream.has(12) or stream.buf[:4] != b"BAM\x01":
        raise ValueError("Not a file of binary aligned reads")
    n = struct.unpack_from("<i", stream.buf, 4)[0]
    if not stream.has(12 + n):
        raise ValueError("The header is cut off")
    text = bytes(stream.buf[8 : 8 + n]).rstrip(b"\x00").decode()
    count, at, contigs = struct.unpack_from("<i", stream.buf, 8 + n)[0], 12 + n, []
    for _ in range(count):
        size = struct.unpack_from("<i", stream.buf, at)[0] if stream.has(at + 4) else -1
        if size < 1 or not stream.has(at + 8 + size):
            raise ValueError("The header is cut off")
        contigs.append((bytes(stream.buf[at + 4 : at + 3 + size]).decode(), struct.unpack_from("<i", stream.buf, at + 4 + size)[0]))
        at += 8 + size
    return contigs, text, at


def _tags(buf: bytearray, at: int, end: int) -> list[tuple[str, str]]:
    """The tags of a record as text; a ValueError where they do not fill it exactly."""
    out = []
    while at < end:
        if at + 4 > end:
            raise ValueError("A tag is cut off")
        key, kind, at = bytes(buf[at : at + 2]).decode("ascii"), chr(buf[at + 2]), at + 3
        if kind in "ZH":
            stop = buf.find(0, at, end)
            if stop < 0:
                raise ValueError("A tag has no end")
            value, at = bytes(buf[at:stop]).decode("utf-8"), stop + 1
        elif kind == "B":
            inner = chr(buf[at])
            if inner not in CODES or at + 5 > end:
                raise ValueError("A tag's type is unknown")
            n, at = struct.unpack_from("<I", buf, at + 1)[0], at + 5
            if at + n * SIZES[inner] > end:
                raise ValueError("A tag is cut off")
            numbers = struct.unpack_from(f"<{n}{CODES[inner]}", buf, at)
            value, at = ",".join([inner, *(f"{x:g}" if inner == "f" else str(x) for x in numbers)]), at + n * SIZES[inner]
        elif kind in SIZES:
            if at + SIZES[kind] > end:
                raise ValueError("A tag is cut off")
            x = chr(buf[at]) if kind == "A" else struct.unpack_from("<" + CODES[kind], buf, at)[0]
            value, at = f"{x:g}" if kind == "f" else str(x), at + SIZES[kind]
        else:
            raise ValueError("A tag's type is unknown")
        out.append((key, value))
    return out


def _is_record(stream: _Stream, at: int, n_contigs: int) -> int | None:
    """The place behind the record at ``at``, None if it is none."""
    if not stream.has(at + 36):
        return None
    size, ref, pos, l_name, _, _, n_cigar, _, l_seq, next_ref, next_pos, _ = struct.unpack_from("<iiiBBHHHiiii", stream.buf, at)
    fixed = 32 + l_name + 4 * n_cigar + (max(l_seq, 0) + 1) // 2 + max(l_seq, 0)
    if not (-1 <= ref < n_contigs and -1 <= next_ref < n_contigs and pos >= -1 and next_pos >= -1 and l_name > 0 and l_seq >= 0 and fixed <= size < 1 << 29):
        return None
    if not stream.has(at + 4 + size):
        return None
    buf, name = stream.buf, at + 36
    if buf[name + l_name - 1] or any(not 33 <= c <= 126 for c in buf[name : name + l_name - 1]):
        return None
    if any(buf[name + l_name + 4 * k] & 15 > 8 for k in range(n_cigar)):
        return None
    try:
        _tags(buf, at + 4 + fixed, at + 4 + size)
    except ValueError:
        return None
    return at + 4 + size


def _likely(buf: bytearray, lo: int, hi: int, n_contigs: int) -> list[int]:
    """The places from ``lo`` to before ``hi`` whose numbers could be those of a record; 32 bytes behind ``hi`` are there."""
    a = np.frombuffer(bytes(buf[lo : hi + 32]), np.uint8).astype(np.uint32)
    n = hi - lo
    at = lambda o: (a[o : o + n] | a[o + 1 : o + 1 + n] << 8 | a[o + 2 : o + 2 + n] << 16 | a[o + 3 : o + 3 + n] << 24).view(np.int32)
    size, ref, length, other = at(0), at(4), at(20), at(24)
    ok = (size >= 32) & (ref >= -1) & (ref < n_contigs) & (at(8) >= -1) & (length >= 0) & (length <= size) & (other >= -1) & (other < n_contigs) & (at(28) >= -1) & (a[12 : 12 + n] > 0)
    return (np.flatnonzero(ok) + lo).tolist()


def _start(stream: _Stream, n_contigs: int) -> int:
    """The place of the first record, behind all bytes if there is none."""
    lo = 0
    while stream.has(lo + 36):
        stream.has(lo + 65536 + 36)
        hi = min(lo + 65536, len(stream.buf) - 35)
        for k in _likely(stream.buf, lo, hi, n_contigs):
            at, found = k, 0
            while found < CHAIN and (end := _is_record(stream, at, n_contigs)):
                at, found = end, found + 1
                if not stream.has(at + 1):
                    found = CHAIN  # records to the end of the file
            if found == CHAIN:
                return k
        lo = hi
    return len(stream.buf)


def _decoded(buf: bytearray, at: int, size: int, contigs: list[str], cigars: dict[bytes, str]) -> tuple:
    ref, pos, l_name, mapq, _, n_cigar, flag, l_seq = struct.unpack_from("<iiBBHHHi", buf, at + 4)
    k = at + 36
    name = bytes(buf[k : k + l_name - 1]).decode()
    k += l_name
    packed = bytes(buf[k : k + 4 * n_cigar])
    k += 4 * n_cigar
    seq = "".join([PAIRS[b] for b in buf[k : k + (l_seq + 1) // 2]])[:l_seq] or "*"
    k += (l_seq + 1) // 2
    qual = "*" if l_seq == 0 or buf[k] == 255 else bytes(buf[k : k + l_seq]).translate(UP33).decode("latin-1")
    tags = _tags(buf, k + l_seq, at + 4 + size)
    for i, (key, value) in enumerate(tags):
        if key == "CG" and n_cigar and value[:2] == "I,":  # operations beyond 65,535 stand in a tag
            packed, tags = struct.pack(f"<{value.count(',')}I", *map(int, value.split(",")[1:])), tags[:i] + tags[i + 1 :]
            break
    cigar = cigars.get(packed)
    if cigar is None:
        cigar = "".join(f"{x >> 4}{CIGAR_OPS[x & 15]}" for x in struct.unpack(f"<{len(packed) // 4}I", packed)) or "*"
        if len(cigars) < 65536 and len(packed) < 256:
            cigars[packed] = cigar
    return name, flag, contigs[ref] if ref >= 0 else None, pos + 1, mapq, cigar, seq, qual, tags


def _range(path: str, start: int, stop: int, rows: int) -> Iterator[list[tuple]]:
    """Lists of the decoded records that begin in blocks from ``start`` to before ``stop``."""
    stream = _Stream(path, 0)
    contigs, _, at = _head(stream)
    names, first = [c for c, _ in contigs], stream.place(at)
    if start > 0:
        # a header of many blocks may reach into the range
        stream = _Stream(path, max(start, first[0]))
        at = first[1] if first[0] >= start else _start(stream, len(names))
    cigars: dict[bytes, str] = {}
    out = []
    while stream.place(at)[0] < min(stop, stream.size):
        size = struct.unpack_from("<i", stream.buf, at)[0] if stream.has(at + 4) else -1
        if size < 32 or not stream.has(at + 4 + size):
            raise ValueError(f"A record of {path} is cut off at {stream.place(at)}")
        out.append(_decoded(stream.buf, at, size, names, cigars))
        at += 4 + size
        if at > 1 << 22:
            stream.drop(at)
            at = 0
        if len(out) == rows:
            yield out
            out = []
    yield out
    end = stream.place(at)
    if first[0] < stop < stream.size:
        after = _Stream(path, stop)
        if after.place(_start(after, len(names))) != end:
            raise ValueError(f"The first record behind byte {stop} of {path} is not where it was looked for; read with larger ranges")


def _files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(address, bytes) of the files of a path or pattern; hidden ones are left out."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for found in system.globStatus(place) or []:
        for f in system.listStatus(found.getPath()) if found.isDirectory() else [found]:
            if f.isFile() and not f.getPath().getName().startswith(("_", ".")) and not f.getPath().getName().endswith((".bai", ".csi", ".sbi")):
                uri = f.getPath().toUri()
                out.append((uri.getPath() if uri.getScheme() in (None, "file") else uri.toString(), f.getLen()))
    if not out:
        raise ValueError(f"No file at {path}")
    return sorted(out)


def contigs(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, length) of the contigs in the header of the first file."""
    return _head(_Stream(_files(spark, path)[0][0], 0))[0]


def bam(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, batch: int = 4096) -> DataFrame:
    """name, flag, contig, pos, mapq, cigar, seq, qual, tags (map) of a file, a folder or a pattern.

    Positions count from 1 (0: none), a contig is null where there is none, tags' values are text. The driver lists files
    and their sizes only; the ranges are made by Spark, one task each. Files are opened by address on the executors.
    """
    listed = _files(spark, path)
    files = spark.createDataFrame(listed, "path string, size bigint")
    cuts = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(range_bytes).cast("bigint"))).alias("start"))
    ranges = cuts.select("path", "start", F.least(F.col("start") + range_bytes, "size").alias("stop"))
    total = sum(-(-size // range_bytes) for _, size in listed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                for rows in _range(r["path"], r["start"], r["stop"], batch):
                    columns = list(zip(*rows, strict=True)) or [[] for _ in ROW]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ROW, strict=True)], schema=ROW)

    # one range a partition, about: the ranges are numbers, not data
    return ranges.repartition(max(total, 1), "path", "start").mapInArrow(run, ROW_DDL)


def _bin(start: int, end: int) -> int:
    """The number of the smallest bin of the index that holds [start, end)."""
    end -= 1
    for level, shift in ((5, 14), (4, 17), (3, 20), (2, 23), (1, 26)):
        if start >> shift == end >> shift:
            return ((1 << 3 * level) - 1) // 7 + (start >> shift)
    return 0


def _encoded(r: dict, ids: dict[str, int], cigars: dict[str, tuple[bytes, int]]) -> bytes:
    contig, pos = r["contig"], (r["pos"] or 0) - 1
    if contig is not None and contig not in ids:
        raise ValueError(f"Contig {contig} is not in the header")
    text = r["cigar"] if r["cigar"] not in (None, "*") else ""
    if text not in cigars:
        ops, n, span = [], "", 0
        for c in text:
            if c.isdigit():
                n += c
            else:
                ops.append(int(n) << 4 | CIGAR_OPS.index(c))
                span, n = span + (int(n) if c in "MDN=X" else 0), ""
        if len(cigars) > 65536:
            cigars.clear()
        cigars[text] = (struct.pack(f"<{len(ops)}I", *ops), span)
    packed, span = cigars[text]
    seq = r["seq"] if r["seq"] not in (None, "*") else ""
    qual = b"\xff" * len(seq) if r["qual"] in (None, "*") and len(seq) != 1 or r["qual"] is None else r["qual"].encode("latin-1").translate(DOWN33)
    if seq and len(qual) != len(seq):
        raise ValueError(f"Bases and qualities of {r['name']} differ in length")
    codes = [NIBBLES.get(c, 15) for c in seq] + [0] * (len(seq) % 2)
    tags = b"".join(k.encode() + b"Z" + v.encode() + b"\x00" for k, v in sorted(r["tags"] or [], key=lambda x: x[0]) if v is not None)
    name = (r["name"] or "*").encode() + b"\x00"
    n_cigar, extra = len(packed) // 4, b""
    if n_cigar > 65535:  # the place for the operations is the tag CG
        extra = b"CGBI" + struct.pack("<I", n_cigar) + packed
        packed, n_cigar = struct.pack("<2I", len(seq) << 4 | 4, span << 4 | 3), 2
    fixed = struct.pack("<iiBBHHHiiii", ids[contig] if contig is not None else -1, pos, len(name), r["mapq"] or 0, _bin(max(pos, 0), max(pos, 0) + max(span, 1)), n_cigar, r["flag"] or 0, len(seq), -1, -1, 0)
    body = fixed + name + packed + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True)) + (qual if seq else b"") + tags + extra
    return struct.pack("<i", len(body)) + body


def _blocks(data: bytes) -> bytes:
    """One block of at most ``BLOCK_BYTES``, without its last byte, which is always 0: the writer's line end is that byte."""
    pack = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = pack.compress(data) + pack.flush()
    if len(body) > 65000:  # does not shrink: as it is
        body = b"\x01" + struct.pack("<HH", len(data), ~len(data) & 0xFFFF) + data
    head = MAGIC + b"\x00\x00\x00\x00\x00\xff\x06\x00BC\x02\x00" + struct.pack("<H", len(body) + 25)
    return (head + body + struct.pack("<II", zlib.crc32(data), len(data)))[:-1]


def write(reads: DataFrame, path: str, contigs: list[tuple[str, int]], head: str = "@HD\tVN:1.6\tSO:coordinate\n") -> None:
    """A folder of files ``<n>.bam``, one a partition in the partitions' order, each with header and end mark.

    ``reads``: name, flag, contig (null: none), pos (from 1), mapq, cigar, seq, qual, tags (map). ``contigs``: all names, with
    lengths, in the order of the header; a read on another one is an error. Tags are written as text, mates are not.
    The file is committed by Spark's text writer: a row is a block short of its last byte, which is 0, and the line end is that 0.
    """
    listed = "".join(f"@SQ\tSN:{c}\tLN:{n}\n" for c, n in contigs)
    text = (head + listed).encode()
    top = b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(contigs)) + b"".join(struct.pack("<i", len(c.encode()) + 1) + c.encode() + b"\x00" + struct.pack("<i", n) for c, n in contigs)
    ids = {c: i for i, (c, _) in enumerate(contigs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, cigars, done = bytearray(top), {}, []

        def flushed(least: int) -> Iterator[pa.RecordBatch]:
            while len(rest) >= least and rest:
                done.append(_blocks(bytes(rest[:BLOCK_BYTES])))
                del rest[:BLOCK_BYTES]
                if len(done) == 64:
                    yield pa.RecordBatch.from_arrays([pa.array(done, pa.binary())], ["value"])
                    done.clear()

        yield from flushed(1)  # records begin in a block of their own
        for b in batches:
            for r in b.to_pylist():
                rest += _encoded(r, ids, cigars)
                yield from flushed(BLOCK_BYTES)
        yield from flushed(1)
        done.append(EOF_BLOCK[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.binary())], ["value"])

    rows = reads.select("name", "flag", "contig", "pos", "mapq", "cigar", "seq", "qual", "tags").mapInArrow(run, "value binary")
    rows.select(F.col("value").cast("string").alias("value")).write.mode("overwrite").option("lineSep", "\x00").text(path)
    _renamed(reads.sparkSession.createDataFrame([], "value string"), path, ".bam", False)
