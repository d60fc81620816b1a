"""Reads: counting by barcode, pileup into allele observations, CIGAR expansion, site assembly.

Reads are rows of barcode/cell, position, allele, strand, duplicate flag, UMI and an order.
Observations are long: site, cell, allele, f_umi, r_umi, f_reads, r_reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NO_BARCODE = "No-Barcode"


def reads_per_barcode(reads: DataFrame, barcode: str = "barcode", duplicate: str = "dup") -> DataFrame:
    """barcode, umi (reads that are no duplicates), read (all); a null barcode has a name of its own."""
    return reads.groupBy(F.coalesce(F.col(barcode).cast("string"), F.lit(NO_BARCODE)).alias("barcode")).agg(
        F.sum(F.when(F.col(duplicate), 0).otherwise(1)).cast("bigint").alias("umi"), F.count(F.lit(1)).alias("read")
    )


def histogram(counts: DataFrame, column: str) -> DataFrame:
    """value, count: how often each value stands in a column; nulls are left out."""
    return counts.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))


def pileup(reads: DataFrame, min_base_quality: int | None = None, quality: str = "quality") -> DataFrame:
    """Observations without UMIs: a duplicate counts as a read and not as a UMI. Duplicates, secondary and low-quality mappings stay."""
    if min_base_quality is not None:
        reads = reads.filter(F.col(quality) >= min_base_quality)
    new = ~F.col("dup")
    return _observed(reads, new)


def pileup_umi(reads: DataFrame, order: list[str], scope: tuple[str, ...] = ("site",)) -> DataFrame:
    """Observations with UMIs: of the reads of a UMI at a site the first, in ``order``, is counted as a UMI.

    All cells and alleles of a site share its UMIs; with "cell" in ``scope`` each cell has its own.
    A read without a UMI counts by its duplicate flag.
    """
    first = F.row_number().over(Window.partitionBy(*scope, "umi").orderBy(*order)) == 1
    tagged = reads.filter(F.col("umi").isNotNull()).withColumn("__new", first)
    plain = reads.filter(F.col("umi").isNull()).withColumn("__new", ~F.col("dup"))
    return _observed(tagged.unionByName(plain), F.col("__new"))


def _counts(new: Column) -> dict[str, Column]:
    """What a read adds to the counts of an observation; ``new``: it counts as a UMI."""
    n = lambda cond: F.when(cond, 1).otherwise(0).cast("bigint")
    forward = F.col("forward")
    return {"f_umi": n(forward & new), "r_umi": n(~forward & new), "f_reads": n(forward), "r_reads": n(~forward)}


def _observed(reads: DataFrame, new: Column) -> DataFrame:
    return reads.groupBy("site", "cell", "allele").agg(*(F.sum(x).alias(c) for c, x in _counts(new).items()))


def single(reads: DataFrame, cell: str = "cell") -> DataFrame:
    """Each read as an observation of its own, as ``pileup`` counts it: for what sums up observations and needs no pileup before."""
    return reads.select("site", cell, "allele", *(x.alias(c) for c, x in _counts(~F.col("dup")).items()))


def mean_quality(qualities: Column) -> Column:
    """Whole mean of the character codes of a quality string; null for an empty one."""
    codes = F.transform(F.filter(F.split(qualities, ""), lambda c: c != ""), F.ascii)
    return F.try_divide(F.aggregate(codes, F.lit(0), lambda a, x: a + x), F.size(codes)).cast("int")


CIGAR_ERRORS = {
    "length": "Read length and cigar length differ",
    "insertion": "Insertion without a base before it",
    "deletion": "Deletion without a base before it",
    "operator": "Unknown cigar operator",
}


def cigar_bases(reads: DataFrame, keep: list[str], start: str = "pos", seq: str = "seq", qual: str = "qual", cigar: str = "cigar") -> DataFrame:
    """``keep`` columns, position, allele, quals, del_bases: a row for each reference position a read covers.

    M, = and X give a row a base. An insertion is appended to the base before it. A deletion adds its
    length to del_bases of the base before it and leaves positions with no allele, one more than its
    length; the extra one gives way to the base that follows. S skips read bases, N reference bases,
    H and P nothing. Reads without a CIGAR (unmapped) give no rows.
    """
    ops = F.transform(F.expr(f"regexp_extract_all({cigar}, '\\\\d+[A-Za-z=]', 0)"), lambda x: F.struct(F.regexp_extract(x, r"\d+", 0).cast("int").alias("n"), F.right(x, F.lit(1)).alias("op")))
    walk = F.aggregate(
        ops,
        F.struct(F.col(start).cast("bigint").alias("ref"), F.lit(0).alias("read"), F.lit(False).alias("based"), F.array().cast("array<struct<ref:bigint,read:int,n:int,op:string,based:boolean>>").alias("out")),
        lambda a, x: F.struct(
            (a["ref"] + F.when(x["op"].isin("M", "=", "X", "D", "N"), x["n"]).otherwise(0)).alias("ref"),
            (a["read"] + F.when(x["op"].isin("M", "=", "X", "I", "S"), x["n"]).otherwise(0)).alias("read"),
            (a["based"] | x["op"].isin("M", "=", "X")).alias("based"),
            F.concat(a["out"], F.array(F.struct(a["ref"].alias("ref"), a["read"].alias("read"), x["n"].alias("n"), x["op"].alias("op"), a["based"].alias("based")))).alias("out"),
        ),
    )
    walked = reads.filter(F.col(cigar).isNotNull() & (F.col(cigar) != "*")).select(*keep, F.col(seq).alias("__seq"), F.col(qual).alias("__qual"), walk.alias("__w"))
    bad = (
        F.when(F.col("__w.read") != F.length("__seq"), CIGAR_ERRORS["length"])
        .when(F.exists("__w.out", lambda o: ~o["op"].isin(*"M=XIDNSHP")), CIGAR_ERRORS["operator"])
        .when(F.exists("__w.out", lambda o: (o["op"] == "I") & ~o["based"]), CIGAR_ERRORS["insertion"])
        .when(F.exists("__w.out", lambda o: (o["op"] == "D") & ~o["based"]), CIGAR_ERRORS["deletion"])
    )
    walked = walked.withColumn("__ok", F.when(bad.isNull(), F.lit(True)).otherwise(F.raise_error(bad).cast("boolean"))).filter("__ok")
    out = F.col("__w.out")
    is_base = lambda o: o["op"].isin("M", "=", "X")
    # an insertion's or deletion's anchor is the reference position before it
    added = lambda p, text: F.array_join(F.transform(F.filter(out, lambda x: (x["op"] == "I") & (x["ref"] - 1 == p)), lambda x: F.substring(text, x["read"] + 1, x["n"])), "")
    lost = lambda p: F.aggregate(F.filter(out, lambda x: (x["op"] == "D") & (x["ref"] - 1 == p)), F.lit(0), lambda a, x: a + x["n"])
    seq_, qual_ = F.col("__seq"), F.col("__qual")

    def entry(o, k, based: bool) -> Column:
        """The row of an operation's k-th position; only the last ones can be anchors."""
        p, last = o["ref"] + k, k >= o["n"] - 1
        own = lambda text: F.substring(text, o["read"] + k + 1, F.lit(1)) if based else F.lit("")
        whole = lambda text: F.when(last, F.concat(own(text), added(p, text))).otherwise(own(text))
        return F.struct(p.alias("position"), whole(seq_).alias("a"), whole(qual_).alias("q"), F.when(last, lost(p)).otherwise(0).alias("d"))

    covered = lambda p: F.exists(out, lambda x: (is_base(x) & (x["ref"] == p)) | ((x["op"] == "D") & (x["ref"] == p)))
    anchored = lambda p: F.exists(out, lambda x: x["op"].isin("I", "D") & (x["ref"] - 1 == p))
    after_gap = lambda p: F.exists(out, lambda x: (x["op"] == "D") & (x["ref"] + x["n"] == p))
    spread = F.flatten(
        F.transform(
            out,
            lambda o: F.when(is_base(o), F.transform(F.sequence(F.lit(0), o["n"] - 1), lambda k: entry(o, k, True)))
            # the placeholder behind a deletion stands only where nothing else does
            .when(o["op"] == "D", F.transform(F.sequence(F.lit(0), F.when(covered(o["ref"] + o["n"]), o["n"] - 1).otherwise(o["n"])), lambda k: entry(o, k, False)))
            .when((o["op"] == "N") & anchored(o["ref"] + o["n"] - 1) & ~after_gap(o["ref"] + o["n"] - 1), F.array(entry(o, o["n"] - 1, False)))
            .otherwise(F.array().cast("array<struct<position:bigint,a:string,q:string,d:int>>")),
        )
    )
    # each position once, made from its operation alone: linear in the read's length, no shuffle
    rows = walked.select(*keep, F.explode(spread).alias("__x"))
    return rows.select(*keep, F.col("__x.position").alias("position"), F.col("__x.a").alias("allele"), F.col("__x.q").alias("quals"), F.col("__x.d").alias("del_bases"))


def site_alleles(observed: DataFrame, reference: DataFrame) -> DataFrame:
    """Raw alleles of a site on its common reference span: contig, pos, cell, ref, allele (text), counts summed.

    ``observed``: contig, pos, cell, allele, del_bases and the four counts; ``reference``: contig, seq.
    The span is the longest deletion plus one. An allele that the span begins with is the reference; one
    with a deletion or of the span's length stays; any other is laid over the span and cut to its length.
    The sequence is met in blocks, and only by sites, so no row ever carries a contig.
    """
    longest = observed.groupBy("contig", "pos").agg(F.max("del_bases").alias("span"))
    wide = observed.join(reference_spans(longest, reference), ["contig", "pos"])
    plain = (F.col("del_bases") == 0) & F.startswith("ref", "allele")
    laid = F.substring(F.concat("allele", F.substring("ref", F.length("allele") + 1, F.length("ref"))), F.lit(1), F.length("ref"))
    text = F.when(plain, F.col("ref")).when((F.col("del_bases") > 0) | (F.length("allele") == F.length("ref")), F.col("allele")).otherwise(laid)
    counts = ("f_umi", "r_umi", "f_reads", "r_reads")
    return wide.withColumn("text", text).groupBy("contig", "pos", "cell", "ref", "text").agg(*(F.sum(c).alias(c) for c in counts))


def reference_spans(sites: DataFrame, reference: DataFrame, block: int = 1 << 16) -> DataFrame:
    """contig, pos, ref: the ``span`` + 1 bases of the reference from each site on, in upper case; shorter at a contig's end.

    ``sites``: contig, pos (1-based), span. Both sides are cut to blocks of ``block`` bases and joined by (contig, block).
    """
    at = F.col("pos").cast("bigint") - 1
    need = sites.select("contig", "pos", "span", F.explode(F.sequence(F.floor(at / block), F.floor((at + F.col("span")) / block))).alias("__block"))
    cut = reference.select("contig", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.greatest(F.length("seq") - 1, F.lit(0)) / block))).alias("__block"), "seq")
    cut = cut.select("contig", "__block", F.substring("seq", (F.col("__block") * block + 1).cast("int"), F.lit(block)).alias("__part"))
    first, last = F.greatest(at, F.col("__block") * block), F.least(at + F.col("span"), (F.col("__block") + 1) * block - 1)
    part = F.substring("__part", (first - F.col("__block") * block + 1).cast("int"), (last - first + 1).cast("int"))
    rows = need.join(cut, ["contig", "__block"]).groupBy("contig", "pos").agg(F.sort_array(F.collect_list(F.struct(F.col("__block").alias("b"), part.alias("t")))).alias("__parts"))
    return rows.select("contig", "pos", F.upper(F.array_join(F.transform("__parts", lambda x: x["t"]), "")).alias("ref"))


def site_calls(alleles: DataFrame, min_cell_depth: int = 0) -> tuple[DataFrame, DataFrame]:
    """(variants: contig, pos, ref, alts; observations: contig, pos, cell, allele index, counts) of sites with an alternative allele.

    Cells stay where some allele has ``min_cell_depth`` UMIs.
    """
    variants = alleles.groupBy("contig", "pos", "ref").agg(F.sort_array(F.collect_set(F.when(F.col("text") != F.col("ref"), F.col("text")))).alias("alts")).filter(F.size("alts") > 0)
    rows = alleles.join(variants, ["contig", "pos", "ref"]).withColumn("allele", F.when(F.col("text") == F.col("ref"), F.lit(0)).otherwise(F.array_position("alts", F.col("text")).cast("int")))
    deep = F.max(F.col("f_umi") + F.col("r_umi")).over(Window.partitionBy("contig", "pos", "cell")) >= min_cell_depth
    rows = rows.withColumn("__deep", deep).filter("__deep")
    return variants, rows.select("contig", "pos", "cell", "allele", "f_umi", "r_umi", "f_reads", "r_reads")


def known_cells(reads: DataFrame, cells: DataFrame, barcode: str = "barcode") -> DataFrame:
    """Reads of listed cells, with their cell id; others are dropped. Spark broadcasts the list while it is small."""
    return reads.join(cells.select("cell", F.col("barcode").alias(barcode)), barcode)


def in_region(rows: DataFrame, start: int, end: int, column: str = "pos") -> DataFrame:
    """start < position <= end."""
    return rows.filter((F.col(column) > start) & (F.col(column) <= end))


def overlapping(reads: DataFrame, regions: DataFrame, bin_size: int = 100_000) -> DataFrame:
    """Reads (contig, start, end; 1-based, both included) that overlap a region (contig, start, end; 0-based, half open), row for row.

    Both sides are cut into bins, so the join is by contig and bin and never compares all pairs. Regions are
    merged first: the regions a read meets follow each other, and it is kept at the first of them, in the
    first bin that both have. Regions without a base and reads without a place meet nothing.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / bin_size), F.floor(b / bin_size)))
    left = reads.filter("contig is not null and start <= end").withColumn("__bin", bins(F.col("start"), F.col("end")))
    own = merged_regions(regions.select("contig", "start", "end").filter("start < end"))
    right = own.select(F.col("contig").alias("__c"), F.col("start").alias("__s"), F.col("end").alias("__e"), F.lag("end").over(Window.partitionBy("contig").orderBy("start")).alias("__before"))
    right = right.withColumn("__bin", bins(F.col("__s") + 1, F.col("__e")))
    meets = (left["contig"] == right["__c"]) & (left["__bin"] == right["__bin"]) & (F.col("start") <= F.col("__e")) & (F.col("end") > F.col("__s"))
    first = (F.col("__before").isNull() | (F.col("start") > F.col("__before"))) & (left["__bin"] == F.greatest(F.floor(F.col("start") / bin_size), F.floor((F.col("__s") + 1) / bin_size)))
    return left.join(right, meets & first, "left_semi").drop("__bin")


def covered_positions(rows: DataFrame, regions: DataFrame, bin_size: int = 100_000) -> DataFrame:
    """Rows (contig, pos; 1-based) that lie in a region (0-based, half open); a position has one bin."""
    point = rows.withColumns({"start": F.col("pos"), "end": F.col("pos")})
    return overlapping(point, regions, bin_size).drop("start", "end")


def merged_regions(regions: DataFrame) -> DataFrame:
    """Overlapping or touching intervals of a contig as one."""
    order = Window.partitionBy("contig").orderBy("start", "end")
    far = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") <= F.col("__far"), 0).otherwise(1)).over(order)
    return regions.withColumn("__far", far).withColumn("__i", island).groupBy("contig", "__i").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__i")


def region_bins(regions: DataFrame, size: int) -> DataFrame:
    """contig, start, end, bin: intervals cut to ``size`` bases at most."""
    cut = regions.withColumn("__k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("end") - F.col("start") - 1) / size))))
    start = F.col("start") + F.col("__k") * size
    return cut.select("contig", start.alias("start"), F.least(F.col("end"), start + size).alias("end"), F.col("__k").alias("bin"))
