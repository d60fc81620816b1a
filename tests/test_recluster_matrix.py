"""The re-clustering loop in one task."""

from __future__ import annotations

import numpy as np

from genoloom.operators import cluster


def test_classes_end_as_their_cells_do():
    rng = np.random.default_rng(7)
    moved = 0
    for _ in range(40):
        k, n = 7, 24
        place = rng.integers(0, 40, k) / 10
        d = np.round(np.abs(place[:, None] - place), 6)
        d[rng.random((k, k)) < 0.05] = np.nan
        d = np.triu(d, 1) + np.triu(d, 1).T
        of = np.concatenate([np.arange(k), rng.integers(-1, k, n - k)])
        cells = np.where((of[:, None] >= 0) & (of >= 0), d[np.ix_(of, of)], np.nan)
        np.fill_diagonal(cells, np.nan)
        start = np.where(rng.random(n) < 0.2, cluster.TRASH, rng.integers(1, 5, n))
        ends = [cluster.recluster_matrix(m, o, start, 3, 6) for m, o in ((d, of), (cells, np.arange(n)))]
        assert ends[0].tolist() == ends[1].tolist()
        moved += ends[0].tolist() != start.tolist()
    assert moved > 20


def test_iterations_are_one_task(spark, monkeypatch):
    """Few classes: no plan is made for an iteration. The end is that of the loop of plans."""
    place = [0, 1, 2, 20, 21, 23, 60, 61, 64]
    dist = cluster.checkpointed(spark.createDataFrame([(a, b, abs(place[a] - place[b]) / 10) for a in range(9) for b in range(a + 1, 9)], "s1 int, s2 int, d double"))
    assign, trash = spark.createDataFrame([(c, 1) for c in range(8)], "cell int, grp int"), spark.createDataFrame([(8,)], "cell int")
    read = lambda x: (sorted(tuple(r) for r in x[0].select("cell", "grp").collect()), sorted(r[0] for r in x[1].collect()))
    monkeypatch.setattr(cluster, "IN_ONE_TASK", 0)
    want = read(cluster.recluster(dist, assign, trash, 3, 4))
    monkeypatch.undo()

    def no(*_):
        raise AssertionError("a plan of an iteration")

    monkeypatch.setattr(cluster, "group_distance", no)
    assert read(cluster.recluster(dist, assign, trash, 3, 4)) == want


def test_split_of_classes_with_ties():
    """the split by classes, which makes nothing anew in a step, is the one by cells, ties and used-up classes too."""
    rng = np.random.default_rng(5)
    for _ in range(20):
        sizes = rng.integers(1, 4, 6)
        d = rng.integers(0, 3, (6, 6)).astype(float)
        d = d + d.T
        of = rng.permutation(np.repeat(np.arange(6), sizes))
        members = [np.flatnonzero(of == k) for k in range(6)]
        seeds = int(members[0][-1]), int(members[1][0])
        want = cluster.greedy_split(d[np.ix_(of, of)], seeds)
        got = cluster.greedy_split_of(d, members, seeds)
        assert [got[c] for c in range(len(of))] == want.tolist()
