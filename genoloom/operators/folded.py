"""Copies: cells with equal depths at all sites they cover have equal distances to every other cell.

Where most cells are copies, distances are made once a pair of classes (a ``Folded``); what counts or adds up
over cells weighs classes by their cells, and what returns pairs of cells unfolds them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most cells of a class that one row lists; a larger class is listed in parts.
PART = 256
#: Sums of distances weighed by cells are exact to these digits, so that equal sums are equal in any order.
EXACT = "decimal(38,12)"


@dataclass(frozen=True)
class Folded:
    """Distances of all pairs of cells, by classes."""

    #: s1, s2, n1, n2 (classes s1 <= s2 and their sizes), d, d_r (the distance of a cell of s2 before one of s1): a class with itself too
    dist: DataFrame
    #: cell, cls, n (the size of the class): every cell that covers a site
    copies: DataFrame

    def filter(self, condition: Column) -> Folded:
        """The pairs that fulfil a condition on d, of a symmetric distance."""
        return Folded(self.dist.filter(condition), self.copies)


def part_of(n: Column) -> Column:
    """The number of parts of a class of ``n`` cells."""
    return F.ceil(n / PART)


def unfolded(dist: DataFrame | Folded) -> DataFrame:
    """s1 < s2 and the other columns, a row for each pair of cells."""
    if not isinstance(dist, Folded):
        return dist
    kept = [c for c in dist.dist.columns if c not in ("s1", "s2", "n1", "n2") and not c.endswith("_r")]
    n = int(dist.dist.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64("cell"), part_of(F.col("n"))).cast("int")
    parts = dist.copies.groupBy("cls", part.alias("part")).agg(F.collect_list("cell").alias("m"))
    side = lambda k: parts.select(F.col("cls").alias(f"s{k}"), F.col("part").alias(f"p{k}"), F.col("m").alias(f"m{k}"))
    rows = dist.dist.join(side(1), "s1").join(side(2), "s2").filter("s1 < s2 or p1 <= p2")
    # parts are small, so no task gets a large class's pairs; a given number is not merged by size before the rows are unfolded
    rows = rows.repartition(n, "s1", "s2", "p1", "p2").withColumn("x", F.explode("m1")).withColumn("y", F.explode("m2")).filter("s1 < s2 or p1 < p2 or x < y")
    value = lambda c: F.when(F.col("x") < F.col("y"), F.col(c)).otherwise(F.col(f"{c}_r")).alias(c) if f"{c}_r" in dist.dist.columns else F.col(c)
    return rows.select(F.least("x", "y").alias("s1"), F.greatest("x", "y").alias("s2"), *(value(c) for c in kept))


def ways(dist: Folded) -> DataFrame:
    """s1, s2, d, w for both directions of each pair of classes: how many cells of s2 a cell of s1 is paired with, itself not among them."""
    one = F.struct(F.col("s1").alias("a"), F.col("s2").alias("b"), (F.col("n2") - F.when(F.col("s1") == F.col("s2"), 1).otherwise(0)).alias("w"))
    two = F.struct(F.col("s2").alias("a"), F.col("s1").alias("b"), F.col("n1").alias("w"))
    each = F.explode(F.when(F.col("s1") == F.col("s2"), F.array(one)).otherwise(F.array(one, two)))
    return dist.dist.select(each.alias("p"), "d").select(F.col("p.a").alias("s1"), F.col("p.b").alias("s2"), "d", F.col("p.w").alias("w"))


def by_class(dist: Folded, groups: DataFrame) -> DataFrame:
    """cls, grp, k, lo, hi: how many cells of a class are in a group, the first and the last of them."""
    return groups.select("cell", "grp").join(dist.copies, "cell").groupBy("cls", "grp").agg(F.count(F.lit(1)).alias("k"), F.min("cell").alias("lo"), F.max("cell").alias("hi"))


def exact_sum(value: Column) -> Column:
    return F.sum(value.cast(EXACT)).cast("double")
