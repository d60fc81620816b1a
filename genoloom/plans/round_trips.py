"""Queries over sources and sinks: the tables written in a format, read back, and compared with SQL over the tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.operators import cluster, groups, matrix, merge
from genoloom.operators import reads as R
from genoloom.plans import adapter as A
from genoloom.plans.queries import _dist, query
from genoloom.sources import bam, sinks, text, vcf


def _scratch(spark: SparkSession) -> str:
    """A new folder in the one that all machines share; a local one only under a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        shared = tempfile.gettempdir()
    return f"{shared.rstrip('/')}/genoloom-io-{uuid.uuid4().hex}"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, barcode: numbers of fixed width, so that their order is the cells'."""
    return A.cells(spark, sf_dir).select("cell", F.concat(F.lit("c"), F.lpad(F.col("cell").cast("string"), 7, "0")).alias("barcode"))


_BARCODES = ", bc AS (SELECT cell, 'c' || lpad(cell::VARCHAR, 7, '0') AS barcode FROM cellsd) "


@query(_BARCODES + "SELECT cell, barcode FROM bc")
def io_cell_list(spark, sf_dir):
    path = _scratch(spark)
    sinks.write_lines(_cells(spark, sf_dir).select("cell", F.col("barcode").alias("value")), path, ["cell"])
    return text.cell_list(spark, path)


@query(_BARCODES + "SELECT 'k' AS known, 's-' || barcode AS prefixed, barcode FROM bc")
def io_barcode_lists(spark, sf_dir):
    path = _scratch(spark)
    sinks.write_lines(_cells(spark, sf_dir).select("cell", F.col("barcode").alias("value")), path, ["cell"])
    prefixed = text.sample_barcodes(spark, {"s": path}).select(F.col("barcode").alias("prefixed"), F.substring("barcode", 3, 100).alias("barcode"))
    return text.known_lists(spark, {"k": path}).join(prefixed, "barcode").select("known", "prefixed", "barcode")


@query(_BARCODES + "SELECT barcode, CASE WHEN cell % 5 = 0 THEN 'trash' ELSE 'cluster_' || grp END AS grp FROM bc JOIN grps USING (cell)")
def io_clusters(spark, sf_dir):
    path, assign = _scratch(spark), A.groups(spark, sf_dir)
    sinks.clusters(assign.filter("cell % 5 <> 0"), assign.filter("cell % 5 = 0").select("cell"), _cells(spark, sf_dir), path)
    return text.clusters(spark, path)


@query("SELECT s1, s2, d FROM dist")
def io_matrix(spark, sf_dir):
    path = _scratch(spark)
    sinks.matrix(cluster.checkpointed(_dist(spark, sf_dir, "pow4", None, 0)), _cells(spark, sf_dir), path, single=False)
    return text.matrix(spark, path)[0]


@query("SELECT s1, s2, round(d / positions, 9) AS d FROM dist")
def io_matrix_by_counts(spark, sf_dir):
    path, cells = _scratch(spark), _cells(spark, sf_dir)
    dist = cluster.checkpointed(_dist(spark, sf_dir, "pow4", None, 0))
    sinks.matrix(dist, cells, f"{path}/d", single=False)
    sinks.matrix(dist, cells, f"{path}/n", "positions", single=False)
    return text.matrix(spark, f"{path}/d", f"{path}/n")[0].select("s1", "s2", F.round("d", 9).alias("d"))


@query("SELECT d AS value, count(*) AS count FROM dist GROUP BY 1")
def io_histogram(spark, sf_dir):
    path = _scratch(spark)
    sinks.histogram(matrix.histogram(_dist(spark, sf_dir)), path)
    f = F.split("value", "\t")
    return spark.read.text(path).filter("value <> 'value\tcount'").select(f[0].cast("double").alias("value"), f[1].cast("bigint").alias("count"))


@query("SELECT coalesce(cell::VARCHAR, 'No-Barcode') AS barcode, count(*) FILTER (NOT dup) AS umi, count(*) AS read FROM reads GROUP BY 1")
def io_table(spark, sf_dir):
    path = _scratch(spark)
    sinks.table(R.reads_per_barcode(A.reads(spark, sf_dir), "cell"), path, ["barcode"])
    return spark.read.csv(path, sep="\t", header=True, schema="barcode string, umi bigint, read bigint")


def _called(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(variants, observations) at places: site s is position 10 s of contig c<s mod 3>, with alternative alleles A and R."""
    place = lambda df: df.withColumns({"contig": F.concat(F.lit("c"), (F.col("site") % 3).cast("string")), "pos": (F.col("site") * 10).cast("bigint")})
    obs = place(A.observations(spark, sf_dir))
    return obs.select("contig", "pos", F.lit("N").alias("ref"), F.array(F.lit("A"), F.lit("R")).alias("alts")).distinct(), obs


_DENSE = "SELECT 'c' || site % 3 AS contig, (site * 10)::BIGINT AS pos, {who}, k AS allele, " + ", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in ("f_umi", "r_umi", "f_reads", "r_reads"))


@query(_DENSE.format(who="cell") + " FROM (SELECT DISTINCT site, cell FROM obs) CROSS JOIN (SELECT unnest(range(3)) AS k) LEFT JOIN (SELECT *, allele AS k FROM obs) USING (site, cell, k)")
def io_vcf(spark, sf_dir):
    path, cells = _scratch(spark), _cells(spark, sf_dir)
    names = [r[0] for r in cells.orderBy("cell").select("barcode").collect()]  # the header's columns
    calls, obs = _called(spark, sf_dir)
    vcf.write(vcf.lines(calls, obs, names), path, names, [("c0", 1000), ("c1", 1000), ("c2", 1000)], partitions=4)
    return vcf.read(spark, path, cells)[1]


@query(
    _DENSE.format(who="grp AS cell, cn AS \"CN\"") + " FROM (SELECT site, grp, cn FROM gcn) CROSS JOIN (SELECT unnest(range(3)) AS k) LEFT JOIN (SELECT *, allele AS k FROM gobs) USING (site, grp, k)"
)
def io_vcf_groups(spark, sf_dir):
    path, member = _scratch(spark), A.groups(spark, sf_dir)
    calls, obs = _called(spark, sf_dir)
    places = obs.select("site", "contig", "pos").distinct()
    merged = groups.group_calls(obs, member)[0].join(places, "site").withColumnRenamed("grp", "cell")
    called = groups.group_genotypes(obs, member).join(places, "site").select("contig", "pos", F.col("grp").alias("cell"), "genotype", "cn")
    names = [f"g{k}" for k in range(3)]
    vcf.write(vcf.lines(calls, merged, names, None, called), path, names, partitions=4)
    return vcf.read(spark, path, spark.createDataFrame(list(enumerate(names)), "cell int, barcode string"), copies=True)[1]


_NAME = "'r' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey"


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as aligned reads of ten bases: order keys are places on one contig for each return flag."""
    lines = A.table(spark, sf_dir, "lineitem")
    return lines.select(
        F.concat_ws("-", F.concat(F.lit("r"), "l_orderkey"), "l_linenumber", "l_partkey", "l_suppkey").alias("name"),
        (F.when(F.col("l_linestatus") == "O", 0).otherwise(merge.REVERSE) + F.when(F.col("l_linenumber") > 4, merge.DUPLICATE).otherwise(0)).alias("flag"),
        F.col("l_returnflag").alias("contig"), (F.col("l_orderkey") * 3 + 1).cast("bigint").alias("pos"), F.lit(60).alias("mapq"), F.lit("6M2D4M").alias("cigar"),
        F.lit("ACGTACGTAC").alias("seq"), F.lit("IIIIIIIIII").alias("qual"), F.create_map(F.lit("CB"), F.concat(F.lit("b"), "l_suppkey"), F.lit("UB"), F.concat(F.lit("u"), "l_partkey")).alias("tags"),
    )


_READS = f"SELECT {_NAME} AS name, l_returnflag AS contig, l_orderkey * 3 + 1 AS pos, l_orderkey * 3 + 12 AS \"end\", l_linestatus = 'O' AS forward, l_linenumber > 4 AS dup, 'b' || l_suppkey AS cb, 'u' || l_partkey AS ub, 'ACGTACGTAC' AS seq FROM lineitem"


def _read(rows: DataFrame) -> DataFrame:
    return rows.select("name", "contig", "pos", "end", "forward", "dup", F.col("tags")["CB"].alias("cb"), F.col("tags")["UB"].alias("ub"), "seq")


@query(_READS, prelude=False)
def io_sam(spark, sf_dir):
    path = _scratch(spark)
    sinks.sam(merge.coordinate_sorted(_aligned(spark, sf_dir), rank="contig", ties=("name",)), path, ["@HD\tVN:1.6"])
    return _read(text.sam(spark, path))


@query(_READS, prelude=False)
def io_bam(spark, sf_dir):
    path = f"{_scratch(spark)}.bam"
    bam.write(merge.coordinate_sorted(_aligned(spark, sf_dir), rank="contig", ties=("name",)), path, [(c, 1 << 29) for c in ("A", "N", "R")])
    return _read(text.aligned(spark, path))


_REGIONS = "SELECT CASE n_regionkey % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'A' ELSE 'R' END AS contig, n_nationkey * 700 AS s, n_nationkey * 700 + 90 + n_regionkey * 200 AS e FROM nation"


def _bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark)
    n = A.table(spark, sf_dir, "nation")
    contig = F.when(F.col("n_regionkey") % 3 == 0, "N").when(F.col("n_regionkey") % 3 == 1, "A").otherwise("R")
    start = F.col("n_nationkey") * 700
    lines = n.select("n_nationkey", F.concat_ws("\t", contig, start.cast("string"), (start + 90 + F.col("n_regionkey") * 200).cast("string")).alias("value"))
    sinks.write_lines(lines, path, ["n_nationkey"])
    return text.regions(spark, path)


@query(_REGIONS.replace("AS s,", "AS \"start\",").replace("AS e FROM", "AS \"end\" FROM"), prelude=False)
def io_regions(spark, sf_dir):
    return _bed(spark, sf_dir)


@query(
    f"WITH g AS ({_REGIONS}) SELECT {_NAME} AS name, l_returnflag AS contig, l_orderkey * 3 + 1 AS pos FROM lineitem l WHERE EXISTS (SELECT 1 FROM g WHERE g.contig = l_returnflag AND l_orderkey * 3 + 1 <= e AND l_orderkey * 3 + 12 > s)",
    prelude=False,
)
def reads_in_regions(spark, sf_dir):
    rows = _aligned(spark, sf_dir).select("name", "contig", F.col("pos").alias("start"), (F.col("pos") + 11).alias("end"), "tags")
    return R.overlapping(rows, _bed(spark, sf_dir), bin_size=500).select("name", "contig", F.col("start").alias("pos"))


@query("SELECT r_name AS contig, upper(substr(repeat(s, 20), 3, 9)) AS win, length(s) * 20 AS n FROM (SELECT r_name, replace(r_name, ' ', '') || 'acgt' AS s FROM region)", prelude=False)
def io_fasta(spark, sf_dir):
    path = _scratch(spark)
    seq = F.repeat(F.concat("r_name", F.lit("acgt")), 20)
    # a sequence over two lines
    lines = A.table(spark, sf_dir, "region").select("r_regionkey", F.concat(F.lit(">"), F.regexp_replace("r_name", " ", "_"), F.lit(" x\n"), F.substring(seq, F.lit(1), F.lit(30)), F.lit("\n"), F.substring(seq, F.lit(31), F.length(seq))).alias("value"))
    sinks.write_lines(lines, path, ["r_regionkey"])
    fasta = text.fasta(spark, path)
    sites = fasta.select("contig", F.lit(3).cast("bigint").alias("pos"), F.lit(8).alias("span"))
    spans = R.reference_spans(sites, fasta, block=7)
    return spans.join(fasta, "contig").select(F.regexp_replace("contig", "_", " ").alias("contig"), F.col("ref").alias("win"), F.length("seq").cast("bigint").alias("n"))


@query("SELECT barcode, mate, count(*) AS n FROM (SELECT DISTINCT cell::VARCHAR AS barcode, CASE WHEN l_linestatus = 'O' THEN 'R2' ELSE 'R1' END AS mate, l_orderkey, l_partkey, l_linenumber, l_returnflag, l_linestatus FROM reads) GROUP BY 1, 2")
def io_fastq(spark, sf_dir):
    path = _scratch(spark)
    rows = A.reads(spark, sf_dir).select(
        F.col("cell").cast("string").alias("barcode"), F.concat(F.lit("r"), "l_orderkey", F.lit("-"), "l_partkey", F.lit("-"), "l_linenumber").alias("name"),
        F.when(F.col("l_linestatus") == "O", merge.SECOND).otherwise(0).alias("flag"), F.col("l_returnflag").alias("seq"), F.col("l_linestatus").alias("qual"),
    )
    sinks.fastq(merge.fastq_reads(rows, A.cells(spark, sf_dir).select(F.col("cell").cast("string").alias("barcode"))), path)
    lines = spark.read.text(path).filter(F.startswith("value", F.lit("@")))
    return lines.groupBy(F.col("barcode").cast("string").alias("barcode"), "mate").agg(F.count(F.lit(1)).alias("n"))


_CIGAR = """WITH r AS (SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp, l_orderkey AS p, (l_linenumber % 3 + 2) AS a, (l_partkey % 2 + 1) AS b, (l_suppkey % 4 + 1) AS c, (l_orderkey % 5 + 1) AS d FROM lineitem),
s AS (SELECT *, substr(repeat('ACGTTGCA', 4), 1, a + b + c + 5) AS seq FROM r)
SELECT id, line, part, supp, p + i AS position, substr(seq, i + 1, CASE WHEN i = a - 1 THEN 1 + b ELSE 1 END) AS allele, 0 AS del_bases FROM (SELECT *, unnest(range(a)) AS i FROM s)
UNION ALL SELECT id, line, part, supp, p + a + i, substr(seq, a + b + i + 1, 1), CASE WHEN i = c - 1 THEN d ELSE 0 END FROM (SELECT *, unnest(range(c)) AS i FROM s)
UNION ALL SELECT id, line, part, supp, p + a + c + i, '', 0 FROM (SELECT *, unnest(range(d)) AS i FROM s)
UNION ALL SELECT id, line, part, supp, p + a + c + d + i, substr(seq, a + b + c + i + 1, 1), 0 FROM (SELECT *, unnest(range(5)) AS i FROM s)
"""


@query(_CIGAR, prelude=False)
def cigar_of_lines(spark, sf_dir):
    rows = A.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_orderkey").alias("pos"),
        (F.col("l_linenumber") % 3 + 2).alias("a"), (F.col("l_partkey") % 2 + 1).alias("b"), (F.col("l_suppkey") % 4 + 1).alias("c"), (F.col("l_orderkey") % 5 + 1).alias("d"),
    )
    seq = F.substring(F.repeat(F.lit("ACGTTGCA"), 4), F.lit(1), (F.col("a") + F.col("b") + F.col("c") + 5).cast("int"))
    rows = rows.withColumns({"seq": seq, "qual": seq, "cigar": F.concat("a", F.lit("M"), "b", F.lit("I"), "c", F.lit("M"), "d", F.lit("D5M"))})
    return R.cigar_bases(rows, ["id", "line", "part", "supp"]).drop("quals")
