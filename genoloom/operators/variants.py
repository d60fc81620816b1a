"""Variants in long form: depths, cut-offs, cleaning, allele arrays.

``obs``: site, cell, allele, f_umi, r_umi, f_reads, r_reads. Depth means UMIs of both strands.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoloom.functions.genotype import binomial_survival

COUNTS = ("f_umi", "r_umi", "f_reads", "r_reads")


@dataclass(frozen=True)
class Cutoffs:
    min_alternative_depth: int = 2
    min_cell_alternative_depth: int = 2
    min_total_depth: int = 5
    min_base_quality: int = 42
    max_p_value: float = 0.05


def depth() -> Column:
    return F.col("f_umi") + F.col("r_umi")


def read_depth() -> Column:
    return F.col("f_reads") + F.col("r_reads")


def site_depths(obs: DataFrame, key: str = "site") -> DataFrame:
    """key, total, read_total, ref_depth, alt_depth, alt_ratio (null without depth)."""
    alt = F.when(F.col("allele") > 0, depth()).otherwise(0)
    sums = obs.groupBy(key).agg(F.sum(depth()).alias("total"), F.sum(read_depth()).alias("read_total"), F.sum(depth() - alt).alias("ref_depth"), F.sum(alt).alias("alt_depth"))
    return sums.withColumn("alt_ratio", F.try_divide(F.col("alt_depth").cast("double"), F.col("total").cast("double")))


def allele_depths(obs: DataFrame, key: str = "site") -> DataFrame:
    """key, allele, depth, read_depth."""
    return obs.groupBy(key, "allele").agg(F.sum(depth()).alias("depth"), F.sum(read_depth()).alias("read_depth"))


def passing_sites(obs: DataFrame, cutoffs: Cutoffs = Cutoffs(), key: str = "site") -> DataFrame:
    """Sites with alternative depth, total depth and an alternative allele deep enough in some cell."""
    alt = F.when(F.col("allele") > 0, depth()).otherwise(0)
    sums = obs.groupBy(key).agg(F.sum(alt).alias("a"), F.sum(depth()).alias("t"), F.max(alt).alias("m"))
    keep = (F.col("a") > 0) & (F.col("a") >= cutoffs.min_alternative_depth) & (F.col("t") >= cutoffs.min_total_depth) & (F.col("m") >= cutoffs.min_cell_alternative_depth)
    return sums.filter(keep).select(key)


def filtered(obs: DataFrame, cutoffs: Cutoffs = Cutoffs(), key: str = "site") -> DataFrame:
    return obs.join(passing_sites(obs, cutoffs, key), key, "left_semi")


def p_values(obs: DataFrame, seq_error: float = 0.005, key: str = "site") -> DataFrame:
    """obs with p_value: the chance of more reads of an allele than seen, among the cell's reads at the site."""
    n = F.sum(read_depth()).over(Window.partitionBy(key, "cell"))
    return obs.withColumn("__n", n).withColumn("p_value", binomial_survival(read_depth(), F.col("__n"), seq_error)).drop("__n")


def zeroed(obs: DataFrame, condition: Column) -> DataFrame:
    """Counts become 0 where the condition does not hold; the reference allele is no exception."""
    return obs.withColumns({c: F.when(condition, F.col(c)).otherwise(0).cast("bigint") for c in COUNTS})


def zero_shallow(obs: DataFrame, min_depth: int) -> DataFrame:
    return zeroed(obs, depth() >= min_depth)


def zero_improbable(obs: DataFrame, seq_error: float = 0.005, max_p_value: float = 0.05, key: str = "site") -> DataFrame:
    import struct

    cut = struct.unpack("f", struct.pack("f", max_p_value))[0]
    return zeroed(p_values(obs, seq_error, key), F.col("p_value") <= cut).drop("p_value")


def cleaned(obs: DataFrame, key: str = "site") -> DataFrame:
    """Without alternative alleles that no cell has, cells without depth and sites without cells; alleles are numbered anew."""
    by_allele = F.sum(depth()).over(Window.partitionBy(key, "allele"))
    by_cell = F.sum(depth()).over(Window.partitionBy(key, "cell"))
    out = obs.withColumns({"__a": by_allele, "__c": by_cell}).filter(((F.col("__a") > 0) | (F.col("allele") == 0)) & (F.col("__c") > 0))
    number = F.when(F.col("allele") == 0, F.lit(0)).otherwise(F.dense_rank().over(Window.partitionBy(key, F.col("allele") > 0).orderBy("allele")))
    return out.withColumn("allele", number).drop("__a", "__c")


def alt_ratio_at_least(obs: DataFrame, ratio: float = 0.01, key: str = "site") -> DataFrame:
    """Sites whose alternative share is at least ``ratio``; sites without depth go."""
    keep = site_depths(obs, key).filter(F.col("alt_ratio") >= ratio).select(key)
    return obs.join(keep, key, "left_semi")


def allele_arrays(obs: DataFrame, key: str = "site") -> DataFrame:
    """key, cell, ad: UMI depths of all alleles of the site, 0 where a cell has none."""
    each = obs.groupBy(key, "cell").agg(F.map_from_entries(F.collect_list(F.struct("allele", depth().alias("n")))).alias("m"))
    last = obs.groupBy(key).agg(F.max("allele").alias("last"))
    return each.join(last, key).select(key, "cell", F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("bigint"))).alias("ad"))


def unique_alleles(obs: DataFrame, groups: DataFrame, balance: float = 0.9, key: str = "site") -> DataFrame:
    """key, allele, grp: alleles that most cells of one group alone have, while some group hardly has them.

    A cell has an allele with a depth over 1. Shares are of the group's cells seen at the site.
    """
    rows = obs.join(groups.select("cell", "grp"), "cell")
    seen = rows.groupBy(key, "grp").agg(F.countDistinct("cell").alias("n"))
    has = rows.groupBy(key, "allele", "grp").agg(F.countDistinct(F.when(depth() > 1, F.col("cell"))).alias("k"))
    alleles = rows.select(key, "allele").distinct()
    share = alleles.join(seen, key).join(has, [key, "allele", "grp"], "left").withColumn("share", F.coalesce("k", F.lit(0)) / F.col("n"))
    sums = share.groupBy(key, "allele").agg(
        F.sum(F.when(F.col("share") >= balance, 1).otherwise(0)).alias("high"), F.sum(F.when(F.col("share") <= 1 - balance, 1).otherwise(0)).alias("low"), F.max(F.when(F.col("share") >= balance, F.col("grp"))).alias("grp")
    )
    return sums.filter((F.col("high") == 1) & (F.col("low") >= 1)).select(key, "allele", "grp")
