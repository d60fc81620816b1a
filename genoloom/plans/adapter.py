"""The domain on the driver's star schema: line items are reads, suppliers cells, brands sites.

Return flags are alleles (N the reference, then A and R), the line status is the strand, line numbers
over 4 are duplicates, order keys modulo 64 are UMIs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genoloom.operators import pairs
from genoloom.operators.cluster import checkpointed, numbered
from genoloom.operators.folded import Folded
from genoloom.operators.points import Points
from genoloom.operators.reads import pileup, single

ALLELES = 3
#: Most parts whose sites are sent to every task: about 100 MB there.
PARTS = 2_000_000
#: Unique for each read.
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, l_suppkey."""
    return numbered(table(spark, sf_dir, "lineitem"), "l_suppkey")


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cells`` as a table of its own, for what asks for them more than once: line items are read for them once."""
    return checkpointed(cells(spark, sf_dir))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, p_partkey. Brands are numbered apart and joined back, so the parts need no global order."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    brands = part.select("p_brand").distinct().select(F.row_number().over(Window.orderBy("p_brand")).alias("site"), "p_brand")
    return part.join(brands, "p_brand").select("site", "p_partkey")


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, allele, forward, dup and the columns of ORDER: the reads before their cells are numbered.

    Up to PARTS parts their sites go to every task, so the reads stay where they are; more are joined by an exchange.
    """
    lines, at = table(spark, sf_dir, "lineitem").select(*ORDER), sites(spark, sf_dir)
    allele = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    # narrow columns before the join: who needs no more exchanges no more
    lines = lines.select(allele.alias("allele"), (F.col("l_linestatus") == "O").alias("forward"), (F.col("l_linenumber") > 4).alias("dup"), *ORDER)
    at = F.broadcast(at) if table(spark, sf_dir, "part").count() <= PARTS else at.hint("shuffle_hash")
    return lines.join(at, lines["l_partkey"] == F.col("p_partkey")).drop("p_partkey")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(spark, sf_dir).join(cells(spark, sf_dir), "l_suppkey").select("site", "cell", "allele", "forward", "dup", (F.col("l_orderkey") % 64).alias("umi"), *ORDER)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup(reads(spark, sf_dir))


def distances(spark: SparkSession, sf_dir: str, name: str, known: DataFrame | None = None, points: int | None = None) -> Folded | DataFrame | Points:
    """s1, s2, positions, d: distances of a method to 6 digits, by classes of equal cells where that saves work. Reads are counted once, a row a site and cell.

    ``known``: the cells, if they are at hand. ``points``: see ``pairs.folded``.
    """
    return pairs.folded(single(placed(spark, sf_dir), "l_suppkey"), name, alleles=ALLELES, digits=6, names=cells(spark, sf_dir) if known is None else known, points=points)


def groups(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    """cell, grp: a fixed assignment to three clusters. ``known``: the cells, if they are at hand."""
    return (cells(spark, sf_dir) if known is None else known).select("cell", (F.col("l_suppkey") % 3).cast("int").alias("grp"))


def donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """known, cell: the region of each supplier."""
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    rows = cells(spark, sf_dir).join(supplier, "l_suppkey").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(F.col("r_name").alias("known"), "cell")
