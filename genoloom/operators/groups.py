"""Groups of cells: merged allele counts, genotypes, informative sites, evaluation, move costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genoloom.functions.genotype import genotype, likelihoods
from genoloom.operators.matrix import cell_group_distance, group_distance
from genoloom.operators.variants import COUNTS, allele_arrays, depth


def group_calls(obs: DataFrame, groups: DataFrame, key: str = "site") -> tuple[DataFrame, DataFrame]:
    """(key, grp, allele, counts; key, grp, cn): counts of a group's cells, and how many cells it has at the site. Cells of no group are dropped."""
    rows = obs.join(groups.select("cell", "grp"), "cell")
    return rows.groupBy(key, "grp", "allele").agg(*(F.sum(c).alias(c) for c in COUNTS)), rows.groupBy(key, "grp").agg(F.countDistinct("cell").alias("cn"))


def group_genotypes(obs: DataFrame, groups: DataFrame, key: str = "site", ploidy: int = 2, min_depth: int = 1) -> DataFrame:
    """key, grp, ad, pl, genotype, cn."""
    counts, cells = group_calls(obs, groups, key)
    arrays = allele_arrays(counts.withColumnRenamed("grp", "cell"), key).withColumnRenamed("cell", "grp").withColumn("pl", likelihoods(F.col("ad"), ploidy))
    return arrays.withColumn("genotype", genotype(F.col("ad"), F.col("pl"), ploidy, min_depth)).join(cells, [key, "grp"])


def informative_sites(calls: DataFrame, min_group_depth: int = 50, key: str = "site") -> DataFrame:
    """Sites with more than one group, called genotypes that are not all equal, one that a single group has, and every group deep enough.

    ``calls``: key, grp, ad, genotype. A genotype is called if some allele of it is not null; only groups
    seen at the site are tested for depth.
    """
    called = F.exists("genotype", lambda x: x.isNotNull())
    text = F.when(called, F.array_join("genotype", "/", "."))
    rows = calls.select(key, text.alias("g"), F.aggregate("ad", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("t"))
    each = rows.groupBy(key, "g").agg(F.count(F.lit(1)).alias("k"), F.min("t").alias("t"))
    sums = each.groupBy(key).agg(
        F.sum("k").alias("groups"), F.count("g").alias("kinds"), F.max(F.when(F.col("g").isNotNull() & (F.col("k") == 1), 1).otherwise(0)).alias("single"), F.min("t").alias("least")
    )
    return sums.filter((F.col("groups") > 1) & (F.col("kinds") > 1) & (F.col("single") == 1) & (F.col("least") >= min_group_depth)).select(key)


def precision_recall(known: DataFrame, found: DataFrame) -> DataFrame:
    """known, grp, overlap, missed, wrong, recall, precision for each pair of a known list and a found group.

    ``known``: known, barcode; ``found``: grp, barcode. Repeated barcodes count as often as both sides have them.
    """
    k = known.groupBy("known", "barcode").agg(F.count(F.lit(1)).alias("a"))
    g = found.groupBy("grp", "barcode").agg(F.count(F.lit(1)).alias("b"))
    both = k.join(g, "barcode").groupBy("known", "grp").agg(F.sum(F.least("a", "b")).alias("overlap"))
    sizes_k = known.groupBy("known").agg(F.count(F.lit(1)).alias("n_known"))
    sizes_g = found.groupBy("grp").agg(F.count(F.lit(1)).alias("n_found"))
    # a table of lists by groups is the result: each list gets the few groups as one array
    every = sizes_k.withColumn("__g", F.explode(sizes_g.select(F.collect_list(F.struct("grp", "n_found"))).scalar())).select("known", "n_known", "__g.grp", "__g.n_found")
    out = every.join(both, ["known", "grp"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0).cast("bigint")))
    ratio = lambda n: F.try_divide(F.col("overlap").cast("double"), F.col(n).cast("double"))
    return out.select("known", "grp", "overlap", (F.col("n_known") - F.col("overlap")).alias("missed"), (F.col("n_found") - F.col("overlap")).alias("wrong"), ratio("n_known").alias("recall"), ratio("n_found").alias("precision"))


def move_costs(dist: DataFrame, assign: DataFrame) -> DataFrame:
    """cell, grp, remove_cost, to, add_cost: what a cell's place costs and the cheapest other group (the first, if equal).

    remove_cost is the mean distance to the other cells of its group, null for a cell alone; add_cost the
    sum over the other group by its size and the cell. Groups a cell has no distance to cost 0. With one group
    there is no other: ``to`` is null.
    """
    sizes = assign.groupBy(F.col("grp").alias("to")).agg(F.count(F.lit(1)).alias("n"))
    every = _by_group(dist, assign, assign.select("cell", "grp"), sizes)
    own = F.col("grp") == F.col("to")
    return every.groupBy("cell", "grp").agg(
        F.max(F.when(own, F.try_divide("sum", (F.col("n") - 1).cast("double")))).alias("remove_cost"),
        F.min(F.when(~own, F.struct((F.col("sum") / (F.col("n") + 1)).alias("c"), F.col("to").alias("t")))).alias("best"),
    ).select("cell", "grp", "remove_cost", F.col("best.t").alias("to"), F.col("best.c").alias("add_cost"))


def redistribute(dist: DataFrame, assign: DataFrame, trash: DataFrame) -> DataFrame:
    """cell, grp: each cell of the trash in the group with the least difference of its cost there (its distances by the size with it) and the group's distance; the first, if equal."""
    gd = group_distance(dist, assign).withColumnRenamed("d", "gd")
    sizes = assign.groupBy(F.col("grp").alias("to")).agg(F.count(F.lit(1)).alias("n")).join(gd.withColumnRenamed("grp", "to"), "to")
    rows = _by_group(dist, assign, trash.select("cell"), sizes)
    cost = F.col("sum") / (F.col("n") + 1) - F.col("gd")
    return rows.groupBy("cell").agg(F.min(F.struct(cost.alias("c"), F.col("to").alias("g"))).alias("b")).select("cell", F.col("b.g").alias("grp"))


def _by_group(dist: DataFrame, assign: DataFrame, rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """``rows`` (cell, ...) by the groups of ``sizes`` (to, ...), with sum: the cell's distances to the group, 0 without any.

    Groups are as few as the clusters asked for: they come to each row as one array, not by a join, and a
    cell's sums are one map, so all of it stays where the cell is.
    """
    sums = cell_group_distance(dist, assign).groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct("grp", "sum"))).alias("__sums"))
    every = rows.join(sums, "cell", "left").withColumn("__to", F.explode(sizes.select(F.collect_list(F.struct(*sizes.columns))).scalar()))
    return every.select(*rows.columns, "__to.*", F.coalesce(F.try_element_at("__sums", F.col("__to.to")), F.lit(0.0)).alias("sum"))
