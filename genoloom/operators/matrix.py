"""Distance matrices in long form: dist(s1, s2, d) with s1 < s2, a row for each pair that has a distance.

``cells``: the cells of the matrix, in a column ``cell``; a cell is part of it without any distance too.
Every function takes a ``Folded`` too, and gives what it would give for its pairs of cells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoloom.operators import points as P
from genoloom.operators.folded import Folded, by_class, exact_sum, unfolded, ways


def symmetric(dist: DataFrame) -> DataFrame:
    """Both directions of each pair."""
    # an array of constants: no array or struct is made for a pair
    both = unfolded(dist).select("s1", "s2", "d", F.explode(F.array(F.lit(True), F.lit(False))).alias("__as"))
    way = lambda a, b: F.when(F.col("__as"), F.col(a)).otherwise(F.col(b))
    return both.select(way("s1", "s2").alias("s1"), way("s2", "s1").alias("s2"), "d")


def _partners(dist: DataFrame | Folded) -> DataFrame:
    """cell, k: how many cells a cell has a distance to, for those with any."""
    if isinstance(dist, P.Points):
        return P.partners(dist)
    if not isinstance(dist, Folded):
        return symmetric(dist).groupBy(F.col("s1").alias("cell")).agg(F.count(F.lit(1)).alias("k"))
    each = ways(dist).groupBy(F.col("s1").alias("cls")).agg(F.sum("w").alias("k")).filter("k > 0")
    return dist.copies.join(each, "cls").select("cell", "k")


def overlap(dist: DataFrame, cells: DataFrame, cutoff: float) -> DataFrame:
    """cell, n_overlap, n_wrong: cells within the cutoff (itself and those without a distance too), and the others."""
    far = _partners(dist.filter(F.col("d") > cutoff)).withColumnRenamed("k", "n_wrong")
    n = cells.select(F.count(F.lit(1))).scalar()
    out = cells.select("cell").join(far, "cell", "left").withColumn("n_wrong", F.coalesce("n_wrong", F.lit(0).cast("bigint")))
    return out.select("cell", (n - F.col("n_wrong")).alias("n_overlap"), "n_wrong")


def wrong(dist: DataFrame, cutoff: float) -> DataFrame:
    """s1, s2: ordered pairs whose distance is over the cutoff."""
    return symmetric(dist.filter(F.col("d") > cutoff)).select("s1", "s2")


def overlaps_of(dist: DataFrame, cells: DataFrame, chosen: DataFrame, cutoff: float) -> DataFrame:
    """cell: those within the cutoff of every chosen cell."""
    far = wrong(dist, cutoff).join(chosen.select(F.col("cell").alias("s1")), "s1", "left_semi").select(F.col("s2").alias("cell"))
    return cells.select("cell").join(far, "cell", "left_anti")


def submatrix(dist: DataFrame, chosen: DataFrame) -> DataFrame:
    """The part of the chosen cells; their numbers stay, and with them their order."""
    one = chosen.select("cell").distinct()
    if isinstance(dist, Folded):
        return unfolded(Folded(dist.dist, dist.copies.join(one, "cell", "left_semi"))).select("s1", "s2", "d")
    return dist.join(one.withColumnRenamed("cell", "s1"), "s1", "left_semi").join(one.withColumnRenamed("cell", "s2"), "s2", "left_semi").select("s1", "s2", "d")


def histogram(dist: DataFrame) -> DataFrame:
    """value, count over all pairs with a distance."""
    if isinstance(dist, Folded):
        count = F.when(F.col("s1") == F.col("s2"), F.expr("n1 * (n1 - 1) div 2")).otherwise(F.col("n1") * F.col("n2"))
        return dist.dist.groupBy(F.col("d").alias("value")).agg(F.sum(count).alias("count")).filter("count > 0")
    return dist.groupBy(F.col("d").alias("value")).agg(F.count(F.lit(1)).alias("count"))


def bin_of(value: Column, size: int = 1000) -> Column:
    return F.floor(value * size + 0.5) / size


def binned(hist: DataFrame, size: int = 1000) -> DataFrame:
    return hist.groupBy(bin_of(F.col("value"), size).alias("value")).agg(F.sum("count").alias("count"))


def total_distance(hist: DataFrame) -> DataFrame:
    return hist.agg(F.sum(F.col("value") * F.col("count")).alias("total"))


def subgroup_histogram(dist: DataFrame, groups: DataFrame) -> DataFrame:
    """g1, g2, value, count for pairs of groups g1 <= g2, over ordered pairs of a cell of g1 and one of g2.

    So a pair within a group counts twice, and one between groups once.
    """
    if isinstance(dist, Folded):
        m = by_class(dist, groups)
        one, two = m.select(F.col("cls").alias("s1"), F.col("grp").alias("g1"), F.col("k").alias("k1")), m.select(F.col("cls").alias("s2"), F.col("grp").alias("g2"), F.col("k").alias("k2"))
        count = F.sum(F.col("k1") * F.when((F.col("s1") == F.col("s2")) & (F.col("g1") == F.col("g2")), F.col("k2") - 1).otherwise(F.col("k2")))
        return ways(dist).join(one, "s1").join(two, "s2").filter("g1 <= g2").groupBy("g1", "g2", F.col("d").alias("value")).agg(count.alias("count")).filter("count > 0")
    one = groups.select(F.col("cell").alias("s1"), F.col("grp").alias("g1"))
    two = groups.select(F.col("cell").alias("s2"), F.col("grp").alias("g2"))
    rows = dist.join(one, "s1").join(two, "s2").select(F.least("g1", "g2").alias("g1"), F.greatest("g1", "g2").alias("g2"), "d")
    return rows.groupBy("g1", "g2", F.col("d").alias("value")).agg(F.sum(F.when(F.col("g1") == F.col("g2"), 2).otherwise(1)).alias("count"))


def group_distance(dist: DataFrame, groups: DataFrame) -> DataFrame:
    """grp, d: the sum over ordered pairs within a group, by its number of cells; missing distances count 0."""
    if isinstance(dist, Folded):
        m = by_class(dist, groups)
        one, two = m.select(F.col("cls").alias("s1"), "grp", F.col("k").alias("k1")), m.select(F.col("cls").alias("s2"), "grp", F.col("k").alias("k2"))
        both = F.col("k1") * F.when(F.col("s1") == F.col("s2"), F.col("k2") - 1).otherwise(F.col("k2"))
        sums = ways(dist).join(one, "s1").join(two, ["s2", "grp"]).groupBy("grp").agg(exact_sum(F.col("d") * both).alias("sum"))
    else:
        one = groups.select(F.col("cell").alias("s1"), F.col("grp"))
        two = groups.select(F.col("cell").alias("s2"), F.col("grp").alias("g2"))
        sums = dist.join(one, "s1").join(two, "s2").filter("grp = g2").groupBy("grp").agg((2 * F.sum("d")).alias("sum"))
    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(sums, "grp", "left").select("grp", (F.coalesce("sum", F.lit(0.0)) / F.col("n")).alias("d"))


def cell_group_distance(dist: DataFrame, groups: DataFrame) -> DataFrame:
    """cell, grp, sum, n: for every cell and group the sum of the cell's distances to the group, and the group's size."""
    if isinstance(dist, Folded):
        m = by_class(dist, groups).select(F.col("cls").alias("s2"), "grp", "k")
        own = F.when(F.col("s1") == F.col("s2"), F.col("d"))
        each = ways(dist).join(m, "s2").groupBy(F.col("s1").alias("cls"), "grp").agg(exact_sum(F.col("d") * F.col("k")).alias("sum"), F.sum("k").alias("k"), F.max(own).alias("own"))
        # a cell is not its own partner
        rows = dist.copies.select("cell", "cls").join(each, "cls").join(groups.select("cell", F.col("grp").alias("__in")), "cell", "left")
        inside = F.coalesce(F.col("__in") == F.col("grp"), F.lit(False))
        sums = rows.filter(F.col("k") > inside.cast("int")).select("cell", "grp", F.when(inside, F.col("sum") - F.col("own")).otherwise(F.col("sum")).alias("sum"))
    else:
        members = groups.select(F.col("cell").alias("s2"), "grp")
        sums = symmetric(dist).join(members, "s2").groupBy(F.col("s1").alias("cell"), "grp").agg(F.sum("d").alias("sum"))
    return sums.join(groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "grp").select("cell", "grp", "sum", "n")


def sparse_cells(dist: DataFrame, cells: DataFrame, share: float = 0.25) -> DataFrame:
    """Cells with a distance to less than ``share`` of all cells, themselves among them."""
    n = cells.select(F.count(F.lit(1))).scalar()
    return cells.select("cell").join(_partners(dist), "cell", "left").filter(F.coalesce("k", F.lit(0)) < share * n).select("cell")


#: Bytes of vectors in a partition: a clustering passes over them many times.
VECTOR_BYTES = 32_000_000


def _dense(entries: DataFrame, every: list[int], key: str) -> DataFrame:
    """key, features: a row for each of ``every``, from its entries (i, j, v); missing ones are 0. ``every``: numbers in order, a vector's columns."""
    from pyspark.ml.functions import array_to_vector

    columns = np.array(every, np.int64)

    def row(number: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        features = np.zeros(len(columns))
        if number[0].as_py() not in known:
            return pa.table({key: pa.array([], pa.int64()), "v": pa.array([], pa.list_(pa.float64()))})
        j, v = t["j"].to_numpy(), t["v"].to_numpy()
        place = np.minimum(np.searchsorted(columns, j), len(columns) - 1)
        there = columns[place] == j
        features[place[there]] = v[there]
        return pa.table({key: pa.array([number[0].as_py()], pa.int64()), "v": pa.array([features], pa.list_(pa.float64()))})

    known = set(every)
    # every number has a row, whatever it has entries for
    own = entries.sparkSession.createDataFrame([(c, c, 0.0) for c in every], "i bigint, j bigint, v double")
    entries = entries.select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), F.col("v").cast("double").alias("v")).filter("i <> j and v is not null")
    rows = own.unionByName(entries).groupBy("i").applyInArrow(row, f"{key} bigint, v array<double>")
    return rows.repartition(max(1, 8 * len(every) ** 2 // VECTOR_BYTES)).select(key, array_to_vector("v").alias("features"))


def vectors(dist: DataFrame, cells: DataFrame) -> DataFrame:
    """cell, features: a cell's distances to all cells in order, missing ones 0."""
    every = [r[0] for r in cells.select("cell").orderBy("cell").collect()]  # a vector holds as many values
    return _dense(symmetric(dist).select(F.col("s1").alias("i"), F.col("s2").alias("j"), F.col("d").alias("v")), every, "cell").select(F.col("cell").cast(dict(cells.dtypes)["cell"]).alias("cell"), "features")


def class_vectors(dist: Folded) -> DataFrame:
    """cls, features: a class's distances to all classes in order, missing ones 0, each times the root of that class's size.

    So two classes are as far from each other as the rows of their cells over all cells. A class's cells are at distance 0.
    """
    sizes = dist.copies.groupBy("cls").agg(F.first("n").alias("n"))
    every = sorted(r[0] for r in sizes.select("cls").collect())
    scaled = ways(dist).join(sizes.select(F.col("cls").alias("s2"), F.sqrt("n").alias("root")), "s2")
    return _dense(scaled.select(F.col("s1").alias("i"), F.col("s2").alias("j"), (F.col("d") * F.col("root")).alias("v")), every, "cls")
