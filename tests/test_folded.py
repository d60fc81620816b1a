"""Copies of cells: every query over distances against its SQL, on tables where each cell stands four times."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pytest

from genoloom.operators import cluster, folded, matrix, pairs
from genoloom.operators.reads import single
from genoloom.plans import adapter as A
from genoloom.plans import queries as Q
from genoloom.plans import round_trips  # noqa: F401  adds queries
from test_queries import DIR, plain

COPIES = 4
NAMES = [
    "dist_histogram_binned",
    "pair_distance_chi2",
    "dist_overlap",
    "cell_group_distance",
    "redistribute_trash",
    "split_seed_pair",
    "sparse_cells",
    "dist_wrong",
    "io_histogram",
    "dist_histogram",
    "pair_distance_depthpow2",
    "pair_distance_chi2pow",
    "pair_positions",
    "io_matrix",
    "io_matrix_by_counts",
    "dist_normalised", "dist_submatrix", "group_distance", "move_costs", "pair_distance_pow4", "pair_scatter", "subgroup_histogram",
]


@pytest.fixture(scope="module")
def copied(tmp_path_factory):
    """The smallest tables with each supplier's lines four times, by shifted keys. The shift keeps a supplier's group."""
    if not os.path.isdir(DIR):
        pytest.skip("no tables here")
    path, con = str(tmp_path_factory.mktemp("copied")), duckdb.connect()
    for t in ("region", "nation", "supplier", "part"):
        con.execute(f"copy (select * from '{DIR}/{t}.parquet') to '{path}/{t}.parquet'")
    con.execute(f"copy (select * replace (l_suppkey + i * 12 as l_suppkey, l_orderkey + i * 1000000 as l_orderkey) from '{DIR}/lineitem.parquet', (select unnest(range({COPIES})) i)) to '{path}/lineitem.parquet'")
    for t in ("region", "nation", "supplier", "part", "lineitem"):
        con.execute(f"create view {t} as select * from '{path}/{t}.parquet'")
    return path, con


def test_copies_are_one_class(spark, copied):
    """Work is done once a pair of classes: as many rows as classes give, not as cells give."""
    dist = Q._dist(spark, copied[0])
    cells = A.cells(spark, copied[0]).count()
    kinds = dist.copies.select("cls").distinct().count()
    assert isinstance(dist, folded.Folded) and kinds * COPIES == cells
    assert dist.dist.count() <= kinds * (kinds + 1) // 2


#: Queries that ask for the cells more than once.
SHARED = ["recluster", "redistribute_trash", "split_seed_pair", "sparse_cells", "dist_overlap", "cell_group_distance"]


@pytest.mark.parametrize("name", SHARED)
def test_cells_are_found_once(spark, copied, name):
    """What is left to run when the query is given back reads no line items for the cells once more."""
    assert not [f for f in Q.QUERIES[name](spark, copied[0]).inputFiles() if "lineitem" in f]


def test_reads_without_depth_are_not_joined(spark, copied):
    """duplicates add to no depth, so they go before the join of sites."""
    rows = pairs._counted_arrays(single(A.placed(spark, copied[0]), "l_suppkey"), 5, "site", A.ALLELES, "l_suppkey")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert any("Filter" in line and "l_linenumber" in line for line in plan[plan.index("Join") :].splitlines())


@pytest.mark.parametrize("name", NAMES)
def test_query_over_copies(spark, copied, name):
    path, con = copied
    got, want = Q.QUERIES[name](spark, path), con.execute(Q.ORACLES[name]).df()
    assert plain(got.toPandas()[list(want.columns)]) == plain(want)


def test_large_classes_unfold_in_parts(spark, monkeypatch):
    monkeypatch.setattr(folded, "PART", 2)
    obs = spark.createDataFrame([(1, c, a, 10 * (a == c % 2), 0, 0, 0) for c in range(10) for a in range(2)], "site int, cell int, allele int, f_umi bigint, r_umi bigint, f_reads bigint, r_reads bigint")
    dist = pairs.folded(obs, alleles=2)
    got = sorted(tuple(r) for r in folded.unfolded(dist).select("s1", "s2", "positions", "d").collect())
    assert got == sorted(tuple(r) for r in pairs.distances(obs, alleles=2).select("s1", "s2", "positions", "pow4").collect()) and len(got) == 45


def _many(spark):
    """Three donors of three profiles each, every profile three cells, and one cell that shares no site."""
    rng = np.random.default_rng(5)
    profiles = [[int(x) for x in rng.integers(6, 30, 2) + np.eye(3, 2, -(i // 3))[0].astype(int) * 60] + [60 * (i // 3 == k) + int(rng.integers(0, 6)) for k in range(3)] for i in range(9)]
    data = [(1, c, a, n, 0, n, 0) for c in range(27) for a, n in enumerate(profiles[c % 9])] + [(2, 27, 0, 9, 0, 9, 0)]
    return spark.createDataFrame(data, "site int, cell int, allele int, f_umi bigint, r_umi bigint, f_reads bigint, r_reads bigint"), spark.createDataFrame([(i,) for i in range(28)], "cell int")


def test_recluster_of_copies(spark):
    """The loop over classes gives what the loop over cells gives, from one group and from k-means."""
    obs, cells = _many(spark)
    fold = cluster.checkpointed(pairs.folded(obs, digits=6))
    flat = cluster.checkpointed(folded.unfolded(fold))
    assert isinstance(fold, folded.Folded) and sorted(r[0] for r in matrix.sparse_cells(fold, cells).collect()) == [27]
    for start in (cluster.one_group, lambda c, d: cluster.bisecting_kmeans(d, c, 3)):
        ends = []
        for dist in (fold, flat):
            assign, trash = start(cells, dist)
            begun = {r[0]: r[1] for r in assign.select("cell", "grp").collect()}
            end, rest = cluster.recluster(dist, assign, trash, 3)
            parts = lambda x: sorted(sorted(c for c in x if x[c] == g) for g in set(x.values()))
            ends.append((parts(begun), parts({r[0]: r[1] for r in end.select("cell", "grp").collect()}), sorted(r[0] for r in rest.collect())))
        assert ends[0] == ends[1]


def test_greedy_split_of_classes_is_that_of_cells():
    rng = np.random.default_rng(3)
    for _ in range(30):
        k, n = 5, 17
        cls = np.concatenate([np.arange(k), rng.integers(0, k, n - k)])
        d = np.triu(rng.integers(0, 4, (k, k)).astype(float), 1)
        d += d.T
        seeds = tuple(int(x) for x in rng.choice(n, 2, replace=False))
        side = cluster.greedy_split_of(d, [np.flatnonzero(cls == c) for c in range(k)], seeds)
        assert [side[i] for i in range(n)] == cluster.greedy_split(d[np.ix_(cls, cls)], seeds).tolist()


def test_class_vectors_are_as_far_apart_as_rows_of_cells(spark):
    obs, cells = _many(spark)
    fold = cluster.checkpointed(pairs.folded(obs, digits=6))
    rows = {r["cell"]: r["features"].toArray() for r in matrix.vectors(folded.unfolded(fold), cells).collect()}
    one = {r["cls"]: r["features"].toArray() for r in matrix.class_vectors(fold).collect()}
    cls = {r["cell"]: r["cls"] for r in fold.copies.collect()}
    assert len(rows) == 28 and all(len(v) == 28 for v in rows.values()) and len(cls) == 28
    assert all(np.isclose(((rows[a] - rows[b]) ** 2).sum(), ((one[cls[a]] - one[cls[b]]) ** 2).sum()) for a in cls for b in cls)
