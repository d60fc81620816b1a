"""Clustering of cells by distance: bisecting k-means, then splitting, merging and moving until stable.

State: assign(cell, grp) and trash(cell). The loop is on the driver; every step is a DataFrame plan,
and states are cut off their lineage by reliable checkpoints.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genoloom.operators import points as P
from genoloom.operators.folded import Folded, by_class, ways
from genoloom.operators.groups import move_costs, redistribute
from genoloom.operators.matrix import class_vectors, group_distance, sparse_cells, symmetric, vectors


#: The group of a cell that has none, in memory.
TRASH = np.iinfo(np.int32).min


def checkpointed(df: DataFrame | Folded | P.Points) -> DataFrame | Folded | P.Points:
    """A reliable checkpoint, in the folder of the session where it names one. Points have no pairs to keep."""
    if isinstance(df, P.Points):
        return df
    if isinstance(df, Folded):
        return Folded(checkpointed(df.dist), checkpointed(df.copies))
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="genoloom-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def bisecting_kmeans(dist: DataFrame | Folded | P.Points, cells: DataFrame, k: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(assign, trash): k clusters of the cells' distance rows; cells with few distances are trash."""
    from pyspark.ml.clustering import BisectingKMeans

    trash = sparse_cells(dist, cells)
    if isinstance(dist, Folded):
        # copies have equal rows: a class is a point with its size as weight, and its column, which stands that often, is as much longer
        kept = dist.copies.join(trash, "cell", "left_anti")
        rows = class_vectors(dist).join(kept.groupBy("cls").agg(F.count(F.lit(1)).cast("double").alias("w")), "cls").cache()
        model = BisectingKMeans(k=k, seed=seed, weightCol="w").fit(rows)
        return kept.join(model.transform(rows).select("cls", F.col("prediction").alias("grp")), "cls").select("cell", "grp"), trash
    rows = (P.vectors(dist) if isinstance(dist, P.Points) else vectors(dist, cells)).join(trash, "cell", "left_anti").cache()
    model = BisectingKMeans(k=k, seed=seed).fit(rows)
    return model.transform(rows).select("cell", F.col("prediction").alias("grp")), trash


def one_group(cells: DataFrame, dist: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The start without k-means: every cell with enough distances in group 1."""
    trash = sparse_cells(dist, cells)
    return cells.select("cell").join(trash, "cell", "left_anti").withColumn("grp", F.lit(1)), trash


def farthest_pair(dist: DataFrame, members: DataFrame) -> DataFrame:
    """grp, s1, s2, d: in each group the pair to split by.

    Each cell names the first of its farthest partners; of the cells whose distance is the largest, the last counts.
    """
    if isinstance(dist, Folded):
        m = by_class(dist, members)
        one, two = m.select(F.col("cls").alias("s1"), "grp", F.col("hi").alias("last")), m.select(F.col("cls").alias("s2"), "grp", "k", "lo")
        rows = ways(dist).join(one, "s1").join(two, ["s2", "grp"]).filter("s1 <> s2 or k > 1")
        # of a class only the last cell can count in the end; its partner in a class is the first there
        partner = rows.groupBy("grp", F.col("last").alias("s1")).agg(F.min(F.struct((-F.col("d")).alias("m"), F.col("lo"))).alias("p")).select("grp", "s1", F.col("p.lo").alias("s2"), (-F.col("p.m")).alias("d"))
        return partner.groupBy("grp").agg(F.max(F.struct("d", "s1", "s2")).alias("p")).select("grp", "p.s1", "p.s2", "p.d")
    m = members.select("cell", "grp")
    rows = symmetric(dist).join(m.withColumnRenamed("cell", "s1"), "s1").join(m.select(F.col("cell").alias("s2"), F.col("grp").alias("g2")), "s2").filter("grp = g2")
    partner = rows.groupBy("grp", "s1").agg(F.min(F.struct((-F.col("d")).alias("m"), F.col("s2"))).alias("p")).select("grp", "s1", F.col("p.s2").alias("s2"), (-F.col("p.m")).alias("d"))
    return partner.groupBy("grp").agg(F.max(F.struct("d", "s1", "s2")).alias("p")).select("grp", "p.s1", "p.s2", "p.d")


def greedy_split(d: np.ndarray, seeds: tuple[int, int]) -> np.ndarray:
    """Side (0 or 1) of each row of a symmetric matrix (NaN: no distance).

    Strictly one after the other: the cell whose mean distances to the two sides differ most goes to the
    nearer side; the first side if equal.
    """
    n = len(d)
    side = np.full(n, -1)
    side[list(seeds)] = 0, 1
    value, have = np.nan_to_num(d), ~np.isnan(d)
    total = np.stack([value[s].copy() for s in seeds])
    size = np.ones(2)
    seen = np.stack([have[s] for s in seeds])
    while (side < 0).any():
        mean = total / size[:, None]
        gap = np.where(side < 0, np.abs(mean[0] - mean[1]), -1.0)
        at = int(gap.argmax())
        k = int(mean[1, at] < mean[0, at])
        side[at] = k
        total[k] += value[at]
        seen[k] |= have[at]
        size[k] += 1
    return side


def greedy_split_of(d: np.ndarray, members: list[np.ndarray], seeds: tuple[int, int]) -> dict[int, int]:
    """``greedy_split`` of cells in classes: side of each cell, from the classes' matrix and each class's cells in order.

    Equal cells have equal means, so a class stands for its next cell; the first cell if equal.
    """
    of = {int(c): k for k, m in enumerate(members) for c in m}
    left = [[int(c) for c in m[::-1] if c not in seeds] for m in members]
    end = np.iinfo(np.int64).max
    following = np.array([m[-1] if m else end for m in left])
    side = {seeds[0]: 0, seeds[1]: 1}
    value = np.nan_to_num(d)
    total, size = [value[of[s]].copy() for s in seeds], [1.0, 1.0]
    # a step a cell: nothing is made anew in it. Classes that are used up have a gap below all others
    spent, gap = np.where(following < end, 0.0, -np.inf), np.empty(len(d))
    mean = np.empty(len(d)), np.empty(len(d))
    for _ in range(sum(map(len, left))):
        np.divide(total[0], size[0], out=mean[0])
        np.divide(total[1], size[1], out=mean[1])
        np.subtract(mean[0], mean[1], out=gap)
        np.abs(gap, out=gap)
        gap += spent
        most = (gap == gap[gap.argmax()]).nonzero()[0]
        at = int(most[0] if len(most) == 1 else most[following[most].argmin()])
        k = int(mean[1][at] < mean[0][at])
        side[left[at].pop()] = k
        if left[at]:
            following[at] = left[at][-1]
        else:
            following[at], spent[at] = end, -np.inf
        total[k] += value[at]
        size[k] += 1
    return side


def split_group(dist: DataFrame, assign: DataFrame, group: int, new_group: int) -> tuple[DataFrame, DataFrame]:
    """(assign, cells to trash): ``group`` in two by its farthest pair, or all of it trash if it has no distance.

    The one step that is sequential by its nature: one group, as a matrix in one task.
    """
    members = assign.filter(F.col("grp") == group)
    pair = farthest_pair(dist, members).select("s1", "s2").first()
    rest = assign.filter(F.col("grp") != group)
    if pair is None:
        return rest, members.select("cell")
    own = members.select("cell")
    a, b = int(pair[0]), int(pair[1])
    kinds = dict(assign.dtypes)
    typed = lambda parts: rest.unionByName(parts.select(F.col("cell").cast(kinds["cell"]).alias("cell"), F.col("grp").cast(kinds["grp"]).alias("grp")))
    if isinstance(dist, Folded):
        mine = own.join(dist.copies, "cell", "left")
        here = mine.select(F.col("cls").alias("s1")).distinct()
        between = dist.dist.join(here, "s1", "left_semi").join(here.withColumnRenamed("s1", "s2"), "s2", "left_semi").select("s1", "s2", "d")
        # a cell of no class is one of its own, below all of them
        listed = mine.select(F.coalesce(F.col("cls"), -1 - F.col("cell")).alias("s1"), F.col("cell").alias("s2"), F.lit(None).cast("double").alias("d"), F.lit(True).alias("member"))

        def split_classes(pdf: pd.DataFrame) -> pd.DataFrame:
            lists = pdf[pdf["member"]].sort_values(["s1", "s2"])
            numbers, starts = np.unique(lists["s1"].to_numpy(), return_index=True)
            members = np.split(lists["s2"].to_numpy(), starts[1:])
            have = pdf[~pdf["member"]]
            d = np.full((len(numbers), len(numbers)), np.nan)
            i, j = np.searchsorted(numbers, have["s1"]), np.searchsorted(numbers, have["s2"])
            d[i, j] = d[j, i] = have["d"]
            side = greedy_split_of(d, members, (a, b))
            return pd.DataFrame({"cell": np.array(list(side), np.int64), "grp": np.where(np.array(list(side.values())) == 0, group, new_group).astype(np.int64)})

        rows = between.withColumn("member", F.lit(False)).unionByName(listed)
        parts = rows.groupBy(F.lit(1).alias("one")).applyInPandas(lambda pdf: split_classes(pdf), "cell bigint, grp bigint")
        return typed(parts), members.select("cell").limit(0)
    rows = dist.join(own.withColumnRenamed("cell", "s1"), "s1", "left_semi").join(own.withColumnRenamed("cell", "s2"), "s2", "left_semi").select("s1", "s2", "d")
    # cells without a distance in the group still have a row
    rows = rows.unionByName(own.select(F.col("cell").alias("s1"), F.col("cell").alias("s2"), F.lit(0.0).alias("d")))

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = np.unique(pdf[["s1", "s2"]].to_numpy())
        at = {c: i for i, c in enumerate(cells)}
        d = np.full((len(cells), len(cells)), np.nan)
        for x, y, v in pdf.itertuples(index=False):
            d[at[x], at[y]] = d[at[y], at[x]] = v
        side = greedy_split(d, (at[a], at[b]))
        return pd.DataFrame({"cell": cells.astype(np.int64), "grp": np.where(side == 0, group, new_group).astype(np.int64)})

    parts = rows.groupBy(F.lit(1).alias("one")).applyInPandas(lambda pdf: split(pdf[["s1", "s2", "d"]]), "cell bigint, grp bigint")
    return typed(parts), members.select("cell").limit(0)


def same(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


#: Most classes (or cells, where there are no classes) whose matrix one task holds.
IN_ONE_TASK = 2048


def _units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances as whole numbers: of 1e-6, and of 1e-12 for the rest."""
    high = np.floor(x * 1e6)
    return high.astype(np.int64), np.rint((x * 1e6 - high) * 1e6).astype(np.int64)


def _sums(d: np.ndarray, of: np.ndarray, group: np.ndarray, numbers: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(number of cells of each group; for each class the distances to a group's cells, in units of 1e-12 as Python's whole numbers).

    ``of``: each cell's class, -1 for none; ``group``: each cell's group. Exact, so equal sums are equal in any order.
    """
    k = np.stack([np.bincount(of[(group == g) & (of >= 0)], minlength=len(d)) for g in numbers], 1)
    high, low = _units(d)
    exact = (high @ k).astype(object) * 1_000_000 + (low @ k).astype(object)
    return np.array([(group == g).sum() for g in numbers]), exact


def recluster_matrix(d: np.ndarray, of: np.ndarray, group: np.ndarray, expected: int, max_iterations: int) -> np.ndarray:
    """``recluster`` in memory: the group of each cell in order, ``TRASH`` for none.

    ``d``: distances of the classes, NaN where there is none; a class's own is that of two of its cells.
    """
    have, value = ~np.isnan(d), np.nan_to_num(d)
    own_high, own_low = _units(np.append(np.diag(value), 0.0)[of])  # of -1: a cell of no class
    own_units = own_high.astype(object) * 1_000_000 + own_low.astype(object)

    def to_groups(group: np.ndarray, numbers: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(sizes; each cell's distances to each group, its own left out)."""
        size, units = _sums(value, of, group, numbers)
        units = np.concatenate([units, np.zeros((1, len(numbers)), object)])[of]
        for at, g in enumerate(numbers):
            units[group == g, at] -= own_units[group == g]
        return size, (units / 10**12).astype(float)

    def distances(group: np.ndarray, numbers: list[int]) -> dict[int, float]:
        if not numbers:
            return {}
        size, units = _sums(value, of, group, numbers)
        out = {}
        for at, g in enumerate(numbers):
            mine = (group == g) & (of >= 0)
            out[g] = (sum(units[of[mine], at]) - sum(own_units[mine])) / 10**12 / int(size[at])
        return out

    def split(mine: np.ndarray) -> dict[int, int] | None:
        seeds = _farthest(have, value, of, mine)
        if seeds is None:
            return None
        # cells of no class are all at distance 0, so they are one here
        kinds, starts = np.unique(of[mine], return_inverse=True)
        lists = [mine[starts == k] for k in range(len(kinds))]
        inner = np.full((len(kinds), len(kinds)), np.nan)
        real = kinds >= 0
        inner[np.ix_(real, real)] = d[np.ix_(kinds[real], kinds[real])]
        return greedy_split_of(inner, lists, seeds)

    return _loop(group, expected, max_iterations, to_groups, distances, split)


def recluster_points(of: P.Features, group: np.ndarray, expected: int, max_iterations: int, digits: int) -> np.ndarray:
    """``recluster_matrix`` without a matrix: sums of distances are products of ``of.rows``, and not rounded a pair."""

    def to_groups(group: np.ndarray, numbers: list[int]) -> tuple[np.ndarray, np.ndarray]:
        return np.array([(group == g).sum() for g in numbers]), np.round(of.sums(group, numbers), P.COMPARED)

    def distances(group: np.ndarray, numbers: list[int]) -> dict[int, float]:
        sums = of.sums(group, numbers)
        return {g: float(np.round(sums[group == g, at].sum(), P.COMPARED)) / int((group == g).sum()) for at, g in enumerate(numbers)}

    def split(mine: np.ndarray) -> dict[int, int] | None:
        seeds = of.farthest(mine, digits)
        return None if seeds is None else of.greedy_split(mine, seeds)

    return _loop(group, expected, max_iterations, to_groups, distances, split)


def _loop(group: np.ndarray, expected: int, max_iterations: int, to_groups: Callable, distances: Callable, split: Callable) -> np.ndarray:
    """The iterations of ``recluster`` over the cells in order. ``split``: the side of each of some cells, or None if they have no distance."""
    i, everyone = 1, np.arange(len(group))

    def costs(group: np.ndarray, numbers: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """remove_cost (NaN for a cell alone or in no group), add_cost, place of the cheapest other group (-1: there is none)."""
        size, sums = to_groups(group, numbers)
        inside = group[:, None] == np.array(numbers)
        add = np.where(inside, np.inf, sums / (size + 1))
        place = add.argmin(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            remove = np.where(inside & (size > 1), sums / (size - 1), 0).sum(1)
        alone = ~(inside & (size > 1)).any(1)
        return np.where(alone, np.nan, remove), add.min(1), np.where(np.isinf(add.min(1)), -1, place)

    while True:
        numbers = sorted(set(group[group != TRASH].tolist()))
        gd = distances(group, numbers)
        if (i >= max_iterations and len(gd) == expected) or i >= max_iterations + 10 or not len(group):
            return group
        if not gd:
            group = np.zeros(len(group), np.int64)
            continue
        mean = sum(gd.values()) / len(gd)
        if len(gd) > expected:
            _, add, place = costs(group, numbers)
            total = {g: math.fsum(add[group == g]) for g in numbers}
            drop = min(numbers, key=lambda g: (total[g], g))
            group = np.where(group == drop, np.array(numbers)[place], group)
        elif len(gd) < expected or any(v >= 2 * mean for v in gd.values()):
            top = max(gd.values())
            fit = [g for g in numbers if gd[g] == top and (gd[g] >= 2 * mean or len(gd) < expected)]
            chosen = fit[0] if fit else numbers[0]
            mine = everyone[group == chosen]
            group = group.copy()
            sides = split(mine)
            if sides is None:
                group[mine] = TRASH
            else:
                new = max(gd) + 1
                for c, k in sides.items():
                    group[c] = chosen if k == 0 else new
        else:
            placed, trash = group.copy(), group == TRASH
            if trash.any():
                size, sums = to_groups(group, numbers)
                cost = sums / (size + 1) - np.array([gd[g] for g in numbers])
                placed[trash] = np.array(numbers)[cost[trash].argmin(1)]
            left = sorted(set(placed.tolist()))
            remove, add, place = costs(placed, left)
            after = np.where((place >= 0) & (remove > add), TRASH, placed)
            stable = (after == group).all()
            group = after
            if stable:
                return group
        i += 1


def _farthest(have: np.ndarray, value: np.ndarray, of: np.ndarray, mine: np.ndarray) -> tuple[int, int] | None:
    """The pair of ``farthest_pair`` among some cells, in order."""
    mine = mine[of[mine] >= 0]
    if not len(mine):
        return None
    kinds, low, where = np.unique(of[mine], return_index=True, return_inverse=True)
    count, high = np.bincount(where), np.array([mine[where == k][-1] for k in range(len(kinds))])
    there = have[np.ix_(kinds, kinds)] & ~(np.eye(len(kinds), dtype=bool) & (count < 2))
    far = np.where(there, value[np.ix_(kinds, kinds)], -np.inf)
    top = far.max()
    if top == -np.inf:
        return None
    first = mine[low]
    a = max(np.flatnonzero(far.max(1) == top).tolist(), key=lambda k: high[k])
    b = int(first[far[a] == top].min())
    return int(high[a]), b


def _points_in_one_task(dist: P.Points, assign: DataFrame, trash: DataFrame, expected: int, max_iterations: int) -> tuple[DataFrame, DataFrame]:
    """``_in_one_task`` with the cells' depths in the task, and not their distances."""
    kinds, (sites, alleles, digits, p) = dict(assign.dtypes), (dist.sites, dist.alleles, dist.digits, P.power(dist.name))
    states = assign.select(F.col("cell").cast("bigint").alias("cell"), F.col("grp").cast("bigint").alias("grp")).unionByName(trash.select(F.col("cell").cast("bigint").alias("cell"), F.lit(TRASH).cast("bigint").alias("grp")))
    rows = states.join(dist.rows.select(F.col("cell").cast("bigint").alias("cell"), "s", "c"), "cell", "left")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("cell")
        of = P.Features(P.counts_of(t["s"], t["c"], sites, alleles), p)
        return pa.table({"cell": t["cell"], "grp": pa.array(recluster_points(of, t["grp"].to_numpy(), expected, max_iterations, digits), pa.int64())})

    done = checkpointed(rows.groupBy(F.lit(1).alias("one")).applyInArrow(lambda t: run(t), "cell bigint, grp bigint"))
    return _states(done, kinds)


def _states(done: DataFrame, kinds: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    cell = F.col("cell").cast(kinds["cell"]).alias("cell")
    return done.filter(F.col("grp") != TRASH).select(cell, F.col("grp").cast(kinds["grp"]).alias("grp")), done.filter(F.col("grp") == TRASH).select(cell)


def _in_one_task(dist: DataFrame | Folded, assign: DataFrame, trash: DataFrame, expected: int, max_iterations: int) -> tuple[DataFrame, DataFrame]:
    """``recluster`` with the matrix of all classes in one task, as ``split_group`` has that of a group."""
    kinds = dict(assign.dtypes)
    states = assign.select(F.col("cell").cast("bigint").alias("cell"), F.col("grp").cast("bigint").alias("grp")).unionByName(trash.select(F.col("cell").cast("bigint").alias("cell"), F.lit(TRASH).cast("bigint").alias("grp")))
    if isinstance(dist, Folded):
        states = states.join(dist.copies.select(F.col("cell").cast("bigint").alias("cell"), F.col("cls").cast("bigint").alias("cls")), "cell", "left")
        between = dist.dist
    else:
        states, between = states.withColumn("cls", F.col("cell")), dist
    pairs = between.select(F.col("s1").cast("bigint").alias("a"), F.col("s2").cast("bigint").alias("b"), "d", F.lit(False).alias("state"))
    listed = states.select(F.col("cell").alias("a"), F.coalesce("cls", F.lit(-1)).alias("b"), F.col("grp").cast("double").alias("d"), F.lit(True).alias("state"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mine, have = pdf[pdf["state"]].sort_values("a"), pdf[~pdf["state"]]
        cells, cls = mine["a"].to_numpy(), mine["b"].to_numpy()
        numbers = np.unique(cls[cls >= 0])
        d = np.full((len(numbers), len(numbers)), np.nan)
        have = have[have["a"].isin(numbers) & have["b"].isin(numbers)]
        i, j = np.searchsorted(numbers, have["a"]), np.searchsorted(numbers, have["b"])
        d[i, j] = d[j, i] = have["d"]
        of = np.where(cls >= 0, np.searchsorted(numbers, cls), -1)
        return pd.DataFrame({"cell": cells, "grp": recluster_matrix(d, of, mine["d"].to_numpy().astype(np.int64), expected, max_iterations)})

    done = checkpointed(pairs.unionByName(listed).groupBy(F.lit(1).alias("one")).applyInPandas(lambda pdf: run(pdf), "cell bigint, grp bigint"))
    return _states(done, kinds)


def recluster(dist: DataFrame | Folded | P.Points, assign: DataFrame, trash: DataFrame, expected: int, max_iterations: int = 20, snapshot: Callable[[int, DataFrame, DataFrame], None] | None = None) -> tuple[DataFrame, DataFrame]:
    """(assign, trash) after splitting, merging and moving, until nothing changes or the iterations are over.

    ``snapshot`` gets each iteration's number and state. Iterations beyond the last go on until the number of
    groups is the expected one, ten more at most. Up to ``IN_ONE_TASK`` classes, without snapshots, all iterations are one task;
    points are in one task whatever their number, and take no snapshots.
    """
    if isinstance(dist, P.Points):
        if snapshot:
            raise ValueError("Points give no snapshots")
        return _points_in_one_task(dist, assign, trash, expected, max_iterations)
    points = dist.copies.select("cls").distinct() if isinstance(dist, Folded) else assign.select("cell").unionByName(trash.select("cell"))
    if snapshot is None and points.count() <= IN_ONE_TASK:
        return _in_one_task(dist, assign, trash, expected, max_iterations)
    assign, trash, i = checkpointed(assign), checkpointed(trash), 1
    while True:
        gd = {r[0]: r[1] for r in group_distance(dist, assign).collect()}  # a row a group
        if snapshot:
            snapshot(i - 1, assign, trash)
        if (i >= max_iterations and len(gd) == expected) or i >= max_iterations + 10:
            return assign, trash
        if not gd and trash.isEmpty():
            return assign, trash
        if not gd:
            assign, trash = checkpointed(trash.select("cell", F.lit(0).alias("grp"))), trash.limit(0)
            continue
        mean = sum(gd.values()) / len(gd)
        if len(gd) > expected:
            costs = move_costs(dist, assign)
            drop = costs.groupBy("grp").agg(F.sum("add_cost").alias("c")).orderBy("c", "grp").first()[0]
            moved = costs.select("cell", F.when(F.col("grp") == drop, F.col("to")).otherwise(F.col("grp")).alias("grp"))
            assign = checkpointed(moved)
        elif len(gd) < expected or any(v >= 2 * mean for v in gd.values()):
            top = max(gd.values())
            fit = [g for g in sorted(gd) if gd[g] == top and (gd[g] >= 2 * mean or len(gd) < expected)]
            group = fit[0] if fit else min(gd)
            parts, gone = split_group(dist, assign, group, max(gd) + 1)
            assign, trash = checkpointed(parts), checkpointed(trash.select("cell").unionByName(gone))
        else:
            placed = checkpointed(assign.unionByName(redistribute(dist, assign, trash)) if not trash.isEmpty() else assign)
            leave = move_costs(dist, placed).filter(F.coalesce(F.col("remove_cost") > F.col("add_cost"), F.lit(False))).select("cell")
            new_trash = checkpointed(leave)
            new_assign = checkpointed(placed.join(new_trash, "cell", "left_anti").select("cell", "grp"))
            stable = same(new_assign, assign) and same(new_trash, trash.select("cell"))
            assign, trash = new_assign, new_trash
            if stable:
                return assign, trash
        i += 1


def numbered(cells: DataFrame, by: str) -> DataFrame:
    """cell, by: a number for each distinct value, in order. The values are a dimension (barcodes), not the data."""
    return cells.select(by).distinct().select((F.row_number().over(Window.orderBy(by)) - 1).alias("cell"), by)
