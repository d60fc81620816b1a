"""Variant call text: reading to long observations, and writing of cells' and groups' calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.functions.genotype import binomial_survival
from genoloom.sources.sinks import write_parts

NEEDED = ("ADF", "ADR", "ADF-READ", "ADR-READ")
#: Fixed values of the format.
INFO = [("AD", "R", "Integer"), ("AD-READ", "R", "Integer"), ("DP", "1", "Integer"), ("DP-READ", "1", "Integer"), ("SN", "1", "Integer"), ("CN", "1", "Integer")]
FORMAT = [
    ("GT", "1", "String"), ("DP", "1", "Integer"), ("DP-READ", "1", "Integer"), ("DPF", "1", "Integer"), ("DPR", "1", "Integer"), ("SEQ-ERR", "R", "Float"), ("AD", "R", "Integer"),
    ("AD-READ", "R", "Integer"), ("ADF-READ", "R", "Integer"), ("ADR-READ", "R", "Integer"), ("ADF", "R", "Integer"), ("ADR", "R", "Integer"), ("CN", "1", "Integer"),
]


def samples(spark: SparkSession, path: str) -> list[str]:
    """Sample names of the header (of one of the files, for a folder)."""
    line = spark.read.text(path).filter(F.startswith("value", F.lit("#CHROM"))).first()
    return line[0].split("\t")[9:] if line else []


def read(spark: SparkSession, path: str, cells: DataFrame, copies: bool = False) -> tuple[DataFrame, DataFrame]:
    """(variants: contig, pos, ref, alts; observations: contig, pos, cell, allele, counts) of a file or a folder of parts.

    Samples without the four strand counts (and with ``copies``, CN) are left out; a sample that is no
    listed barcode is an error.
    """
    names = samples(spark, path)
    known = {r[1]: r[0] for r in cells.filter(F.col("barcode").isin(names)).select("cell", "barcode").collect()}  # the header's names
    if missing := [n for n in names if n not in known]:
        raise ValueError(f"Unknown sample: {missing[0]}")
    number = F.array(*(F.lit(known[n]) for n in names)) if names else F.array().cast("array<int>")
    f = F.split("value", "\t")
    lines = spark.read.text(path).filter(~F.startswith("value", F.lit("#")) & (F.col("value") != "")).select(f.alias("f"))
    rows = lines.select(
        F.element_at("f", 1).alias("contig"), F.element_at("f", 2).cast("bigint").alias("pos"), F.element_at("f", 4).alias("ref"), F.split(F.element_at("f", 5), ",").alias("alts"),
        F.split(F.element_at("f", 9), ":").alias("keys"), F.slice("f", F.lit(10), F.greatest(F.size("f") - 9, F.lit(0))).alias("values"),
    )
    variants = rows.select("contig", "pos", "ref", "alts")
    cells_of = rows.select("contig", "pos", "keys", F.posexplode(F.arrays_zip(number.alias("cell"), F.col("values").alias("v"))).alias("i", "x"))
    value = lambda k: F.try_element_at(F.split("x.v", ":"), F.array_position("keys", F.lit(k)).cast("int"))
    present = lambda k: F.when(F.array_position("keys", F.lit(k)) > 0, F.when(value(k) != ".", value(k)))
    numbers = lambda k: F.transform(F.split(present(k), ","), lambda y: y.cast("bigint"))
    wide = cells_of.select("contig", "pos", F.col("x.cell").alias("cell"), *(numbers(k).alias(k) for k in NEEDED), present("CN").cast("bigint").alias("CN"))
    for k in NEEDED + (("CN",) if copies else ()):
        wide = wide.filter(F.col(f"`{k}`").isNotNull())
    zipped = F.arrays_zip(F.col("ADF").alias("f_umi"), F.col("ADR").alias("r_umi"), F.col("`ADF-READ`").alias("f_reads"), F.col("`ADR-READ`").alias("r_reads"))
    obs = wide.select("contig", "pos", "cell", *(["CN"] if copies else []), F.posexplode(zipped).alias("allele", "c"))
    return variants, obs.select("contig", "pos", "cell", "allele", "c.f_umi", "c.r_umi", "c.f_reads", "c.r_reads", *(["CN"] if copies else []))


def header(names: list[str], contigs: list[tuple[str, int]] = ()) -> list[str]:
    lines = ["##fileformat=VCFv4.2"]
    lines += [f'##INFO=<ID={k},Number={n},Type={t},Description="{k}">' for k, n, t in INFO]
    lines += [f'##FORMAT=<ID={k},Number={n},Type={t},Description="{k}">' for k, n, t in FORMAT]
    lines += [f"##contig=<ID={c},length={n}>" for c, n in contigs]
    return [*lines, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *names])]


def _join(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda x: x.cast("string")), ",")


def lines(variants: DataFrame, obs: DataFrame, names: list[str], seq_error: float | None = 0.005, genotypes: DataFrame | None = None) -> DataFrame:
    """contig, pos, value: a line a variant, with a column for each of ``names`` (cells 0, 1, ...).

    ``genotypes`` (contig, pos, cell, genotype, cn) adds GT and CN, for groups; ``seq_error`` adds SEQ-ERR.
    """
    last = variants.select("contig", "pos", F.size("alts").alias("last"))
    counts = ("f_umi", "r_umi", "f_reads", "r_reads")
    each = obs.groupBy("contig", "pos", "cell").agg(F.map_from_entries(F.collect_list(F.struct("allele", F.struct(*counts).alias("c")))).alias("m")).join(last, ["contig", "pos"])
    at = lambda field: F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.coalesce(F.try_element_at("m", i)[field], F.lit(0).cast("bigint")))
    each = each.select("contig", "pos", "cell", *(at(c).alias(c) for c in counts))
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    sum_ = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)
    each = each.withColumns({"ad": plus("f_umi", "r_umi"), "ad_read": plus("f_reads", "r_reads")}).withColumn("dp_read", sum_("ad_read"))
    fields = {
        "DP-READ": F.col("dp_read").cast("string"), "DPF": sum_("f_umi").cast("string"), "DPR": sum_("r_umi").cast("string"), "AD-READ": _join("ad_read"), "ADF-READ": _join("f_reads"),
        "ADR-READ": _join("r_reads"), "ADF": _join("f_umi"), "ADR": _join("r_umi"), "AD": _join("ad"), "DP": sum_("ad").cast("string"),
    }
    if seq_error is not None:
        fields = {"SEQ-ERR": _join(F.transform("ad_read", lambda k: binomial_survival(k, F.col("dp_read"), seq_error)))} | fields
    info = {"DP": F.sum(sum_("ad")), "DP-READ": F.sum("dp_read"), "SN": F.count(F.lit(1))}
    if genotypes is not None:
        each = each.join(genotypes.select("contig", "pos", "cell", "genotype", "cn"), ["contig", "pos", "cell"])
        called = F.filter("genotype", lambda x: x.isNotNull())
        fields = {"GT": F.when(F.size(called) > 0, F.array_join(F.transform(called, lambda x: x.cast("string")), "/")).otherwise("."), "CN": F.col("cn").cast("string")} | fields
        info["CN"] = F.sum("cn")
    text = F.array_join(F.array(*fields.values()), ":")
    sums = each.groupBy("contig", "pos").agg(F.map_from_entries(F.collect_list(F.struct("cell", text.alias("t")))).alias("m"), *(v.alias(k) for k, v in info.items()))
    depths = obs.groupBy("contig", "pos", "allele").agg(F.sum(F.col("f_umi") + F.col("r_umi")).alias("a"), F.sum(F.col("f_reads") + F.col("r_reads")).alias("b"))
    depths = depths.groupBy("contig", "pos").agg(F.map_from_entries(F.collect_list(F.struct("allele", F.struct("a", "b")))).alias("d"))
    rows = variants.join(sums, ["contig", "pos"]).join(depths, ["contig", "pos"])
    allele = lambda k: _join(F.transform(F.sequence(F.lit(0), F.size("alts")), lambda i: F.coalesce(F.try_element_at("d", i)[k], F.lit(0).cast("bigint"))))
    info_text = F.concat_ws(";", *(F.concat(F.lit(f"{k}="), F.col(f"`{k}`").cast("string")) for k in info), F.concat(F.lit("AD="), allele("a")), F.concat(F.lit("AD-READ="), allele("b")))
    body = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit("."))), "\t")
    value = F.concat_ws("\t", "contig", F.col("pos").cast("string"), F.lit("."), "ref", F.array_join("alts", ","), F.lit("."), F.lit("."), info_text, F.lit(":".join(fields)), body)
    return rows.select("contig", "pos", value.alias("value"))


def write(rows: DataFrame, path: str, names: list[str], contigs: list[tuple[str, int]] = (), partitions: int = 200) -> None:
    """``<n>.vcf.gz`` in the order of (contig, pos), each with the header."""
    order = F.coalesce(F.array_position(F.array(*(F.lit(c) for c, _ in contigs)), F.col("contig")), F.lit(0)) if contigs else F.lit(0)
    parts = rows.withColumn("__o", order).repartitionByRange(partitions, "__o", "contig", "pos").sortWithinPartitions("__o", "contig", "pos").select("value")
    write_parts(parts, path, ".vcf.gz", header(names, contigs))
