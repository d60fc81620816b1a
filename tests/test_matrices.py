"""Distances by matrices of a tile, against the sums over rows of a pair and site."""

from __future__ import annotations

import numpy as np
import pytest

from genoloom.operators import folded, pairs, reads

METHODS = ["pow4", "pow3", "depthpow2", "chi2", "chi2pow2-0.5"]


@pytest.fixture(scope="module")
def obs(spark):
    """30 cells that all differ, each with its own sites of 5, some of them too shallow; every second cell once more if ``copied``."""
    rng = np.random.default_rng(11)
    counts = rng.integers(0, 14, (30, 5, 3)) * (rng.random((30, 5, 1)) < 0.7)

    def made(copied: bool):
        cells = [*range(30), *(list(range(30)) * 2 if copied else [])]
        data = [(s, c, a, int(n), 0, int(n), 0) for c, like in enumerate(cells) for s in range(5) for a, n in enumerate(counts[like, s])]
        return spark.createDataFrame(data, "site int, cell int, allele int, f_umi bigint, r_umi bigint, f_reads bigint, r_reads bigint")

    return made


@pytest.mark.parametrize("copied", [False, True])
@pytest.mark.parametrize("blocks", [None, 4])
@pytest.mark.parametrize("name", METHODS)
def test_matrices_give_the_sums_over_rows(obs, name, blocks, copied):
    rows = obs(copied)
    dist = pairs.folded(rows, name, alleles=3, digits=6, blocks=blocks)
    assert isinstance(dist, folded.Folded) == copied
    got = {(r[0], r[1]): (r[2], r[3]) for r in folded.unfolded(dist).select("s1", "s2", "positions", "d").collect()}
    want = {(r[0], r[1]): (r[2], r[3]) for r in pairs.distances(rows, name, alleles=3).select("s1", "s2", "positions", f"`{name}`").collect()}
    assert got.keys() == want.keys() and all(got[p][0] == want[p][0] and abs(got[p][1] - want[p][1]) <= 6e-7 for p in want)


def test_no_row_is_made_of_a_pair_and_site(obs):
    plan = pairs.folded(obs(False), alleles=3, digits=6)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Join" not in plan


def test_reads_are_counted_without_a_pileup(spark):
    """Single reads by a cell's name give what their pileup by the cell's number gives, and are exchanged once."""
    rng = np.random.default_rng(2)
    names = spark.createDataFrame([(c, 100 - 7 * c) for c in range(9)], "cell int, who int")
    rows = [(s, 100 - 7 * c, int(a), bool(f), bool(d)) for c in range(8) for s in range(3) for a, f, d in zip(rng.integers(0, 3, 20), rng.random(20) < 0.5, rng.random(20) < 0.2, strict=True)]
    lines = spark.createDataFrame([*rows, (1, 999, 0, True, False)], "site int, who int, allele int, forward boolean, dup boolean")
    one = pairs.folded(reads.single(lines, "who"), alleles=3, digits=6, names=names)
    two = pairs.folded(reads.pileup(lines.join(names, "who")), alleles=3, digits=6)
    got, want = (sorted(tuple(r) for r in x.select("s1", "s2", "positions", "d").collect()) for x in (one, two))
    assert got == want and len(got) == 28


def test_both_directions_make_no_struct_of_a_pair(spark):
    from genoloom.operators import matrix

    dist = spark.range(3).selectExpr("int(id) s1", "int(id + 1) s2", "id / 2 d")
    both = matrix.symmetric(dist)
    assert sorted(map(tuple, both.collect())) == [(0, 1, 0.0), (1, 0, 0.0), (1, 2, 0.5), (2, 1, 0.5), (2, 3, 1.0), (3, 2, 1.0)]
    assert "struct" not in both._jdf.queryExecution().optimizedPlan().toString()
