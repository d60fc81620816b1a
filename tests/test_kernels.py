from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from genoloom.functions import distance, genotype
from genoloom.operators import reads as R


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def ints(*x):
    return F.array(*(F.lit(v).cast("bigint") for v in x))


HALF = math.sqrt(2) / 2


@pytest.mark.parametrize("alleles", [None, 2])
@pytest.mark.parametrize(
    ("name", "a", "b", "expected"),
    [
        ("pow1", (1, 1), (1, 1), 0.0),
        ("pow1", (0, 1), (1, 1), HALF),
        ("pow2", (0, 1), (1, 0), HALF**2 * 2),
        ("pow4", (10, 0), (0, 10), 0.5000000000000001),
        ("depthpow1", (0, 1), (1, 1), math.sqrt(2) / 4),
        ("depthpow2", (0, 1), (1, 0), HALF**2),
        ("chi2", (1, 1), (1, 1), 0.0),
        ("chi2pow2-2", (1, 1), (1, 1), 0.0),
    ],
)
def test_distances(spark, name, a, b, expected, alleles):
    got = value(spark, distance.method(name)(ints(*a), ints(*b), alleles))
    assert got == pytest.approx(expected, abs=1e-15)


def test_pow4_to_the_last_bit(spark):
    assert value(spark, distance.method("pow4")(ints(10, 0), ints(0, 10))) == 0.5000000000000001


def test_chi2_skips_alleles_of_neither(spark):
    assert not math.isnan(value(spark, distance.method("chi2")(ints(2, 0, 0), ints(0, 2, 0))))
    # alleles of one cell count with the first cell's total: E = 2 * (2 / 6), 2 * (4 / 6)
    assert value(spark, distance.method("chi2")(ints(2, 0), ints(0, 4))) == pytest.approx((4 / 3) ** 2 / (2 / 3) + (2 / 3) ** 2 / (2 / 3) + (4 / 3) ** 2 / (4 / 3) + (8 / 3) ** 2 / (4 / 3))


def test_unknown_method():
    with pytest.raises(ValueError, match="Method 'x' does not exist"):
        distance.method("x")


def test_different_alleles_fail(spark):
    with pytest.raises(Exception, match="differ in number"):
        value(spark, distance.method("pow2")(ints(1), ints(1, 2)))


@pytest.mark.parametrize(("ploidy", "n", "f", "expected"), [(2, 0, 0.0, 1.0), (2, 1, 0.5, 1.0), (2, 1, 0.0, 0.0), (2, 2, 0.75, 0.75), (3, 1, 1 / 3, 1.0), (4, 2, 0.5, 1.0), (2, 0, 1.0, 0.0)])
def test_copy_probability(spark, ploidy, n, f, expected):
    assert value(spark, genotype.copy_probability(F.lit(f), n, ploidy)) == pytest.approx(expected)


@pytest.mark.parametrize(
    ("ad", "ploidy", "expected"),
    [((10, 0), 2, [0, 0]), ((10, 10), 2, [0, 1]), ((0, 10), 2, [1, 1]), ((0, 0), 2, [None, None]), ((10, 10, 10), 3, [0, 1, 2]), ((20, 10), 3, [0, 0, 1]), ((10, 0, 10), 2, [0, 2]), ((10, 30), 4, [0, 1, 1, 1])],
)
def test_genotypes(spark, ad, ploidy, expected):
    a = ints(*ad)
    assert value(spark, genotype.genotype(a, genotype.likelihoods(a, ploidy), ploidy)) == expected


def test_phred(spark):
    assert value(spark, genotype.phred(F.lit(0.0))) == 2147483647
    assert value(spark, genotype.phred(F.lit(1.0))) == 0
    assert value(spark, genotype.phred(F.lit(None).cast("double"))) == 0
    assert value(spark, genotype.phred(F.lit(0.5))) == 6


def test_binomial(spark):
    assert value(spark, genotype.binomial_survival(F.lit(1), F.lit(3), 0.005)) == pytest.approx(7.474999666401416e-5, rel=1e-9)
    assert value(spark, genotype.binomial_survival(F.lit(1), F.lit(1), 0.005)) == 1.0
    deep = value(spark, genotype.binomial_survival(F.lit(1500), F.lit(5000), 0.3))
    q = 0.30000001192092896
    exact = sum(math.exp(math.lgamma(5001) - math.lgamma(i + 1) - math.lgamma(5001 - i) + i * math.log(q) + (5000 - i) * math.log(1 - q)) for i in range(1501, 5001))
    assert deep == pytest.approx(exact, rel=1e-6)


def bases(spark, start, seq, cigar):
    rows = spark.createDataFrame([("r", start, seq, "I" * len(seq), cigar)], "name string, pos int, seq string, qual string, cigar string")
    return sorted(tuple(r) for r in R.cigar_bases(rows, []).select("position", "allele", "del_bases").collect())


def test_cigar(spark):
    got = bases(spark, 1, "AATTCCGGAA", "3M1D3M1I3M")
    assert got[2] == (3, "T", 1) and got[3] == (4, "", 0) and got[6] == (7, "CG", 0) and got[-1] == (10, "A", 0)
    assert bases(spark, 1, "AC", "2H2M2H") == [(1, "A", 0), (2, "C", 0)]
    assert bases(spark, 1, "TAC", "1S2M") == [(1, "A", 0), (2, "C", 0)]
    assert bases(spark, 1, "AC", "1M3N1M") == [(1, "A", 0), (5, "C", 0)]


@pytest.mark.parametrize(("cigar", "error"), [("3M", "length"), ("1I1M", "insertion"), ("1D2M", "deletion")])
def test_cigar_errors(spark, cigar, error):
    with pytest.raises(Exception, match=R.CIGAR_ERRORS[error]):
        bases(spark, 1, "AC", cigar)


def test_mean_quality(spark):
    assert value(spark, R.mean_quality(F.lit("*+"))) == 42
    assert value(spark, R.mean_quality(F.lit(""))) is None
