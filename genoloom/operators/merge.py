"""Merging of pooled runs: prefixed barcodes, doublets, downsampling; and reads for export per cell."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Flags of aligned reads.
UNMAPPED, REVERSE, SECOND, SECONDARY, DUPLICATE, SUPPLEMENTARY = 4, 16, 128, 256, 1024, 2048


def flag(bits: int, column: str = "flag") -> Column:
    return F.col(column).bitwiseAND(bits) != 0


def merged(runs: dict[str, DataFrame], barcode: str = "barcode") -> DataFrame:
    """The rows of all runs, with ``sample`` and barcodes prefixed by it; null barcodes stay null."""
    parts = [df.withColumn("sample", F.lit(name)).withColumn(barcode, F.concat(F.lit(f"{name}-"), F.col(barcode))) for name, df in runs.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def coordinate_sorted(reads: DataFrame, rank: str = "contig_rank", pos: str = "pos", ties: tuple[str, ...] = ("sample", "ord"), partitions: int | None = None) -> DataFrame:
    """Range partitions in the order of coordinates, sorted within; unmapped reads (null rank) last."""
    n = partitions or int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(rank).asc_nulls_last(), F.col(pos).asc_nulls_last(), *(F.col(t) for t in ties)]
    return reads.repartitionByRange(n, *keys).sortWithinPartitions(*keys)


def doublet_pairs(barcodes: DataFrame, n: int, seed: int = 12345, barcode: str = "barcode") -> DataFrame:
    """doublet, barcode: 2n barcodes in a random order, two and two; the doublet is named ``b1_b2`` in order. A barcode left over is ignored."""
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.col(barcode)).cast("binary"))
    taken = barcodes.select(barcode).distinct().withColumn("__o", order).orderBy("__o", barcode).limit(2 * n)
    number = taken.withColumn("__k", F.row_number().over(Window.orderBy("__o", barcode)) - 1).withColumn("__p", F.floor(F.col("__k") / 2))
    pairs = number.groupBy("__p").agg(F.sort_array(F.collect_list(barcode)).alias("b")).filter(F.size("b") == 2)
    return pairs.select(F.array_join("b", "_").alias("doublet"), F.explode("b").alias(barcode))


def with_doublets(reads: DataFrame, pairs: DataFrame, barcode: str = "barcode", umi: str = "umi") -> DataFrame:
    """All reads, and of those in a doublet a copy with its barcode and ``G`` behind the UMI."""
    joined = reads.join(pairs, barcode, "left")
    versions = F.when(F.col("doublet").isNull(), F.array(F.struct(F.col(barcode).alias("b"), F.col(umi).alias("u")))).otherwise(
        F.array(F.struct(F.col(barcode).alias("b"), F.col(umi).alias("u")), F.struct(F.col("doublet").alias("b"), F.concat(F.col(umi), F.lit("G")).alias("u")))
    )
    out = joined.withColumn("__v", F.explode(versions)).withColumn(barcode, F.col("__v.b")).withColumn(umi, F.col("__v.u"))
    return out.select(*reads.columns)


def merged_barcodes(barcodes: DataFrame, pairs: DataFrame, barcode: str = "barcode") -> DataFrame:
    """All barcodes, then each doublet once."""
    return barcodes.select(barcode).union(pairs.select("doublet").distinct())


def downsampled(reads: DataFrame, fraction: float, key: list[str], seed: int = 12345) -> DataFrame:
    """A share of the rows by a seeded hash of ``key``, the same in every run; everything for a fraction of 1 or more."""
    if fraction >= 1:
        return reads
    text = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in key)).cast("binary"))
    return reads.filter(F.conv(F.substring(text, 1, 12), 16, 10).cast("bigint") <= int(fraction * (1 << 48)))


def tag(attributes: str, name: str) -> Column:
    """The value of a tag in tab-separated ``TAG:type:value`` attributes; what follows a further colon is cut off."""
    value = F.regexp_extract(F.concat(F.lit("\t"), F.col(attributes)), rf"\t{name}:[^:\t]*:([^:\t]*)", 1)
    return F.when(value != "", value)


def fastq_reads(reads: DataFrame, cells: DataFrame, barcode: str = "barcode", skip_duplicates: bool = False) -> DataFrame:
    """barcode, id, second, seq, qual: primary reads of listed cells, each fragment once."""
    rows = reads.filter(~flag(SECONDARY) & ~flag(SUPPLEMENTARY))
    if skip_duplicates:
        rows = rows.filter(~flag(DUPLICATE))
    rows = rows.join(cells.select(barcode), barcode, "left_semi")
    return rows.select(barcode, F.col("name").alias("id"), flag(SECOND).alias("second"), "seq", "qual").distinct()


def fastq_pairs(fragments: DataFrame, barcode: str = "barcode") -> DataFrame:
    """barcode, id, r1_seq, r1_qual, r2_seq, r2_qual; more than two fragments of an id are an error."""
    read = F.struct("seq", "qual")
    rows = fragments.groupBy(barcode, "id").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(~F.col("second"), read)).alias("a"), F.max(F.when(F.col("second"), read)).alias("b"))
    ok = F.when(F.col("n") <= 2, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("More than two reads of "), F.col("id"))).cast("boolean"))
    return rows.filter(ok).select(barcode, "id", F.col("a.seq").alias("r1_seq"), F.col("a.qual").alias("r1_qual"), F.col("b.seq").alias("r2_seq"), F.col("b.qual").alias("r2_qual"))
