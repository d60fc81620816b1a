"""Distances of all pairs of cells: a theta self-join by site, dealt out in tiles of cells.

Cells are cut into blocks by their number, and every pair of blocks is a tile. Both sides of the join
go to their tiles by one exchange (a cell's row is copied once a block), and a tile holds all sites of
its pairs, so the sum over sites needs no exchange of pairs. A site with very many cells is spread
over all tiles.

Rounded distances (``folded``) take the same tiles, a row for each block and site, to numpy: a site's
distances of all pairs of a tile are a matrix there, and no row is made of a pair and site.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoloom.functions.distance import Method, method, midpoint_distance, total
from genoloom.operators import points as P
from genoloom.operators.cluster import checkpointed
from genoloom.operators.folded import Folded
from genoloom.operators.variants import allele_arrays, depth

#: Lets a join and an aggregate use an exchange by some of their keys.
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"
#: Most cells of a block, and about most rows (cell and site) of one, where distances are made by matrices.
BLOCK_CELLS, BLOCK_ROWS = 2048, 500_000
#: Fewer cells than these are not cut into blocks for the sake of more tasks: a task of Python costs more than their pairs.
LEAST_CELLS = 256
#: Pairs of a tile that are worked on together.
SLAB = 1 << 16


def covered_arrays(obs: DataFrame, min_coverage: int = 5, key: str = "site") -> DataFrame:
    """Allele arrays of the cells with a depth over ``min_coverage`` (strictly) at a site."""
    return allele_arrays(obs, key).filter(F.aggregate("ad", F.lit(0).cast("bigint"), lambda a, x: a + x) > min_coverage)


def _counted_arrays(obs: DataFrame, min_coverage: int, key: str, alleles: int, cell: str = "cell") -> DataFrame:
    """``covered_arrays`` with the depths of the first ``alleles`` alleles, in one pass over ``obs``: no site is asked for its last allele."""
    counts = [F.sum(F.when(F.col("allele") == k, depth()).otherwise(0)) for k in range(alleles)]
    # what adds to no depth goes before it is joined and counted
    rows = (obs.filter(depth() > 0) if min_coverage >= 0 else obs).groupBy(key, cell).agg(F.array(*counts).alias("ad"), F.sum(depth()).alias("__t"))
    return rows.filter(F.col("__t") > min_coverage).select(key, cell, "ad")


def cell_pairs(arrays: DataFrame, key: str = "site", blocks: int | None = None, cells: int | None = None, same: bool = False) -> DataFrame:
    """tile, key, s1, s2 and what both rows carry (ad1, ad2, or any columns but key and cell, with a 1 or 2 behind) for all pairs s1 < s2 of cells that share a site.

    ``cells``: how many there are, numbered from 0; found by a pass over ``arrays`` if not given.
    ``blocks``: by default as many as give four tiles for each shuffle partition; a row is copied once a block at most.
    ``same``: a cell with itself too.
    """
    spark = arrays.sparkSession
    spark.conf.set(CO_PARTITION, "false")  # read when the plan is made; without it Spark would deal out all pairs once more
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = blocks or math.ceil(math.sqrt(8 * n))
    number = F.lit(cells) if cells else arrays.select(F.max("cell") + 1).scalar()
    block = F.floor(F.col("cell").cast("bigint") * blocks / number).cast("int")
    tile = lambda a, b: F.col(a) * blocks + F.col(b)
    carried = [c for c in arrays.columns if c not in (key, "cell")]
    side = lambda k: [F.col(c).alias(f"{c}{k}") for c in carried]
    left = arrays.select(key, F.col("cell").alias("s1"), *side(1), block.alias("__a"), F.explode(F.sequence(block, F.lit(blocks - 1))).alias("__b"))
    right = arrays.select(key, F.col("cell").alias("s2"), *side(2), F.explode(F.sequence(F.lit(0), block)).alias("__a"), block.alias("__b"))
    left = left.withColumn("tile", tile("__a", "__b")).drop("__a", "__b").repartition(n, "tile")
    right = right.withColumn("tile", tile("__a", "__b")).drop("__a", "__b").repartition(n, "tile")
    return left.hint("shuffle_hash").join(right, ["tile", key]).filter("s1 <= s2" if same else "s1 < s2")


def distances(obs: DataFrame, methods: list[str] | str = "pow4", min_coverage: int = 5, key: str = "site", alleles: int | None = None, blocks: int | None = None, cells: int | None = None) -> DataFrame:
    """s1, s2, positions (shared sites), and a column of distances for each method, all in one pass over the pairs."""
    return _of_arrays(covered_arrays(obs, min_coverage, key), sorted({methods} if isinstance(methods, str) else set(methods)), key, alleles, blocks, cells)


def _of_arrays(arrays: DataFrame, names: list[str], key: str, alleles: int | None, blocks: int | None, cells: int | None, fold: bool = False) -> DataFrame:
    """``fold``: cells are classes with a size n, paired with themselves too; ``<method>_r``, if not symmetric, is the distance with the second class first."""
    chosen, size = [method(n) for n in names], ["n"] * fold
    if alleles is None:
        pairs = cell_pairs(arrays, key, blocks, cells, fold)
        one, two = F.col("ad1"), F.col("ad2")
        sums = [F.sum(m(one, two)).alias(m.name) for m in chosen] + [F.sum(m(two, one)).alias(f"{m.name}_r") for m in chosen if fold and not m.symmetric]
    else:
        # plain columns, made once a row: a pair only does arithmetic on them. The arrays of a site are of one length.
        columns = {f"m{i}{c}_": x for i, m in enumerate(chosen) for c, x in m.kept(F.col("ad"), alleles).items()}
        pairs = cell_pairs(arrays.select(key, "cell", *size, *(x.alias(c) for c, x in columns.items())), key, blocks, cells, fold)
        at = lambda i, k: lambda c: F.col(f"m{i}{c}_{k}")
        sums = [F.sum(m.of_kept(at(i, 1), at(i, 2), alleles)).alias(m.name) for i, m in enumerate(chosen)]
        sums += [F.sum(m.of_kept(at(i, 2), at(i, 1), alleles)).alias(f"{m.name}_r") for i, m in enumerate(chosen) if fold and not m.symmetric]
    return pairs.groupBy("tile", "s1", "s2", *(f"{c}{k}" for c in size for k in "12")).agg(F.count(F.lit(1)).alias("positions"), *sums).drop("tile")


def _tile(dense: Callable[[np.ndarray, np.ndarray], np.ndarray], back: bool, alleles: int, digits: int, fold: bool, kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The pairs of a tile, from rows of (side, key, r: its cells at that site with their counts). ``back``: also with the second cell first."""
    scale = 10.0**digits
    rounded = lambda x: np.floor(x * scale + 0.5) / scale  # noqa: E731  no distance is negative

    def side(t: pa.Table, which: int) -> tuple[np.ndarray, np.ndarray | None, dict[object, tuple[np.ndarray, np.ndarray]]]:
        """(cells in order, their n, site -> (places of its cells, counts))."""
        sites, every, sizes = {}, [], []
        for k in np.flatnonzero(t["side"].to_numpy() == which).tolist():
            rows = t["r"][k].values
            cell = rows.field("cell").to_numpy()
            order = np.argsort(cell)
            every.append(cell[order])
            if fold:
                sizes.append(rows.field("n").to_numpy()[order])
            sites[t["key"][k].as_py()] = every[-1], np.stack([rows.field(f"a{i}").to_numpy()[order] for i in range(alleles)], 1)
        if not every:
            return np.array([], np.int64), None, {}
        cells, first = np.unique(np.concatenate(every), return_index=True)
        return cells, np.concatenate(sizes)[first] if fold else None, {s: (np.searchsorted(cells, c), a) for s, (c, a) in sites.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        (c1, n1, one), (c2, n2, two) = side(t, 0), side(t, 1)
        shared, step = sorted(one.keys() & two.keys()), max(1, SLAB // max(1, len(c2)))
        for at in range(0, len(c1) if len(c2) else 0, step):
            own = c1[at : at + step]
            sums, positions = [np.zeros((len(own), len(c2))) for _ in range(1 + back)], np.zeros((len(own), len(c2)), np.int64)
            for s in shared:
                (p1, a1), (p2, a2) = one[s], two[s]
                lo, hi = np.searchsorted(p1, [at, at + len(own)])
                if lo == hi:
                    continue
                where = slice(None) if hi - lo == len(own) and len(p2) == len(c2) else np.ix_(p1[lo:hi] - at, p2)
                positions[where] += 1
                for total_, d in zip(sums, (lambda: dense(a1[lo:hi], a2), lambda: dense(a2, a1[lo:hi]).T), strict=False):
                    total_[where] += d()
            kept = (positions > 0) & (own[:, None] <= c2 if fold else own[:, None] < c2)
            i, j = np.nonzero(kept)
            columns = {"s1": pa.array(own[i], kind), "s2": pa.array(c2[j], kind)}
            if fold:
                columns |= {"n1": pa.array(n1[at + i], pa.int64()), "n2": pa.array(n2[j], pa.int64())}
            columns["positions"] = pa.array(positions[kept], pa.int64())
            yield pa.RecordBatch.from_pydict(columns | {c: pa.array(rounded(x[kept])) for c, x in zip(("d", "d_r"), sums, strict=False)})

    return run


def _by_matrices(arrays: DataFrame, m: Method, key: str, alleles: int, digits: int, number: int, rows: int, fold: bool, blocks: int | None = None) -> DataFrame:
    """s1, s2, positions, d and, of classes, n1, n2 and d_r, as ``_of_arrays`` gives them, rounded. ``number``: of cells, numbered from 0; ``rows``: of ``arrays``."""
    n = int(arrays.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = blocks or max(min(math.ceil(math.sqrt(8 * n)), math.ceil(number / LEAST_CELLS)), math.ceil(number / BLOCK_CELLS), math.ceil(rows / BLOCK_ROWS), 1)
    block = F.floor(F.col("cell").cast("bigint") * blocks / number).cast("int")
    counts = [F.coalesce(F.try_element_at("ad", F.lit(k + 1)), F.lit(0)).cast("double").alias(f"a{k}") for k in range(alleles)]
    sized = [F.col("n").cast("bigint").alias("n")] * fold
    each = arrays.groupBy(block.alias("b"), F.col(key).alias("key")).agg(F.collect_list(F.struct("cell", *sized, *counts)).alias("r"))
    of = lambda side, low, high, tile: F.transform(F.sequence(low, high), lambda x: F.struct(tile(x).alias("tile"), F.lit(side).alias("side")))
    tiles = F.concat(of(0, F.col("b"), F.lit(blocks - 1), lambda x: F.col("b") * blocks + x), of(1, F.lit(0), F.col("b"), lambda x: x * blocks + F.col("b")))
    dealt = each.select("key", "r", F.explode(tiles).alias("t")).select("t.tile", "t.side", "key", "r").repartition(n, "tile")
    kind = dict(arrays.dtypes)["cell"]
    back = fold and not m.symmetric
    run = _tile(m.dense, back, alleles, digits, fold, pa.int32() if kind == "int" else pa.int64())
    run.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    schema = f"s1 {kind}, s2 {kind}, " + "n1 bigint, n2 bigint, " * fold + "positions bigint, d double" + ", d_r double" * back
    return dealt.groupBy("tile").applyInArrow(run, schema)


def _profiles(arrays: DataFrame, key: str, names: DataFrame | None) -> DataFrame:
    """cell, sites (key and ad, in order), mark (equal for equal sites): a row a cell. ``names``: see ``folded``."""
    by = "cell" if names is None else next(c for c in names.columns if c != "cell")
    rows = arrays.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(key, "ad"))).alias("sites"))
    rows = rows if names is None else rows.join(names, by)
    return checkpointed(rows.select("cell", "sites", F.sha2(F.col("sites").cast("string").cast("binary"), 256).alias("mark")))


def classes(profiles: DataFrame) -> DataFrame:
    """cell, cls, n, first, k: cells with equal profiles are a class, numbered from 0 by its first cell, with its size; k: the sites of a cell."""
    each = profiles.groupBy("mark").agg(F.count(F.lit(1)).alias("n"), F.min("cell").alias("first"))
    # a row a class, no more than the cells: a dimension, as in ``numbered``
    each = each.withColumn("cls", F.row_number().over(Window.orderBy("first")) - 1)
    return checkpointed(profiles.select("cell", "mark", F.size("sites").alias("k")).join(each, "mark").select("cell", "cls", "n", "first", "k"))


def _folded_arrays(obs: DataFrame, min_coverage: int, key: str, alleles: int | None, names: DataFrame | None, points: Callable[[DataFrame, int, int], P.Points | None] | None = None) -> tuple[DataFrame, DataFrame | None, int, int] | P.Points:
    """The points that ``points`` makes of (profiles, cells, classes), or (arrays of cells or of classes with their size n, copies or None, an upper end of their numbers, rows): classes where they are half as many as the cells, or fewer."""
    by = "cell" if names is None else next(c for c in names.columns if c != "cell")
    profiles = _profiles(covered_arrays(obs, min_coverage, key) if alleles is None else _counted_arrays(obs, min_coverage, key, alleles, by), key, names)
    copies = classes(profiles)
    once = F.when(F.col("cell") == F.col("first"), F.col("k"))
    cells, kinds, top, rows, rows_once = copies.agg(F.count(F.lit(1)), F.max("cls") + 1, F.max("cell"), F.sum("k"), F.sum(once)).first()
    if points and (made := points(profiles, cells, kinds or 0)):
        return made
    one = F.explode("sites").alias("s")
    if 2 * (kinds or 0) > cells:
        return profiles.select("cell", one).select(f"s.{key}", "cell", "s.ad"), None, top + 1, rows
    first = copies.filter("cell = first").select("cell", "cls", "n")
    arrays = profiles.join(first, "cell").select(F.col("cls").alias("cell"), "n", one).select(f"s.{key}", "cell", "n", "s.ad")
    return arrays, copies.select("cell", "cls", "n"), kinds or 0, rows_once or 0


def folded(obs: DataFrame, name: str = "pow4", min_coverage: int = 5, key: str = "site", alleles: int | None = None, digits: int | None = None, blocks: int | None = None, names: DataFrame | None = None, points: int | None = None) -> Folded | DataFrame | P.Points:
    """The distances d of a method, rounded to ``digits``, and positions: of classes of equal cells where that saves work, else of cells.

    ``names``: cell and what ``obs`` has in its place; cells get their numbers once their depths are counted. With ``alleles``,
    ``obs`` may hold rows that are not piled up yet. ``points``: with more classes than these, the cells' points in place of distances, where they can be.
    """
    if names is not None and alleles is None:
        raise ValueError("names need the number of alleles")
    m, make = method(name), None
    if points is not None and P.power(name) and alleles is not None and digits is not None and min_coverage >= 0:
        make = lambda profiles, cells, kinds: P.of_profiles(profiles, key, name, alleles, digits, cells) if kinds > points else None
    made = _folded_arrays(obs, min_coverage, key, alleles, names, make)
    if isinstance(made, P.Points):
        return made
    arrays, copies, number, rows = made
    if digits is not None and alleles is not None and min_coverage >= 0 and dict(arrays.dtypes)["cell"] in ("int", "bigint"):
        dist = _by_matrices(arrays, m, key, alleles, digits, max(1, number), rows, copies is not None, blocks)
        return dist if copies is None else Folded(dist, copies)
    value = lambda c: F.col(f"`{c}`") if digits is None else F.round(f"`{c}`", digits)
    if copies is None:
        return _of_arrays(arrays, [name], key, alleles, blocks, None).select("s1", "s2", "positions", value(name).alias("d"))
    dist = _of_arrays(arrays, [name], key, alleles, blocks, number, True)
    back = [] if m.symmetric else [value(f"{name}_r").alias("d_r")]
    return Folded(dist.select("s1", "s2", "n1", "n2", "positions", value(name).alias("d"), *back), copies)


def scatter(obs: DataFrame, min_coverage: int = 5, key: str = "site") -> DataFrame:
    """s1, s2, key, allele, f1, f2, distance: the fractions of each shared allele."""
    pairs = cell_pairs(covered_arrays(obs, min_coverage, key), key)
    rows = pairs.select("s1", "s2", key, total(F.col("ad1")).alias("t1"), total(F.col("ad2")).alias("t2"), F.posexplode(F.arrays_zip("ad1", "ad2")).alias("allele", "x"))
    f1, f2 = F.try_divide(F.col("x.ad1").cast("double"), F.col("t1")), F.try_divide(F.col("x.ad2").cast("double"), F.col("t2"))
    return rows.select("s1", "s2", key, "allele", f1.alias("f1"), f2.alias("f2"), midpoint_distance(f1, f2).alias("distance"))


def normalised(dist: DataFrame, counts: DataFrame | None = None, value: Column | None = None) -> DataFrame:
    """s1, s2, d: distances a shared position. Pairs without a count are dropped. Without ``counts`` the rows have their own positions."""
    value = F.col("d") if value is None else value
    rows = dist.filter("positions is not null") if counts is None else dist.join(counts.select("s1", "s2", "positions"), ["s1", "s2"])
    return rows.select("s1", "s2", F.try_divide(value, F.col("positions").cast("double")).alias("d"))
