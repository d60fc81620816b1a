"""Genotypes from allele depths, and the binomial test of a depth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phred value of probability zero.
NO_CHANCE = 2147483647


def copy_probability(fraction: Column, copies: Column | int, ploidy: int = 2) -> Column:
    """1 - (fraction * ploidy - copies)^2; 0 where that leaves [0, 1]."""
    copies = copies if isinstance(copies, Column) else F.lit(copies)
    off = fraction * ploidy - copies
    p = 1 - off * off
    return F.when((p >= 0) & (p <= 1), p).otherwise(F.when(p.isNull(), p).otherwise(0.0))


def phred(p: Column) -> Column:
    """-10 ln p as a whole number, cut towards zero; null (no depth) gives 0."""
    return F.when(p.isNull(), F.lit(0)).when(p <= 0, F.lit(NO_CHANCE)).otherwise((F.ln(p) * -10).cast("int"))


def likelihoods(ad: Column, ploidy: int = 2) -> Column:
    """array<array<int>>: for each allele the phred values of 0 .. ploidy copies."""
    n = F.aggregate(ad, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.transform(ad, lambda x: F.array(*(phred(copy_probability(F.try_divide(x.cast("double"), n.cast("double")), k, ploidy)) for k in range(ploidy + 1))))


def genotype(ad: Column, pl: Column, ploidy: int = 2, min_depth: int = 1) -> Column:
    """array<int> of ``ploidy`` alleles in order, null (first) where none was left to call.

    Greedy: of the unused alleles with depth, the least phred value over 1 .. left copies wins, then
    the first allele, then the fewest copies.
    """
    state = F.struct(F.array().cast("array<int>").alias("gt"), F.array().cast("array<int>").alias("used"))

    def step(s: Column, _: Column) -> Column:
        left = F.lit(ploidy) - F.size(s["gt"])
        options = F.flatten(
            F.transform(
                F.filter(F.sequence(F.lit(0), F.size(ad) - 1), lambda i: ~F.array_contains(s["used"], i) & (F.get(ad, i) >= min_depth)),
                lambda i: F.transform(F.filter(F.sequence(F.lit(1), F.lit(ploidy)), lambda n: n <= left), lambda n: F.struct(F.get(F.get(pl, i), n).alias("pl"), i.alias("i"), n.alias("n"))),
            )
        )
        best = F.array_min(options)
        return F.when(best.isNull(), s).otherwise(F.struct(F.concat(s["gt"], F.array_repeat(best["i"], best["n"])).alias("gt"), F.concat(s["used"], F.array(best["i"])).alias("used")))

    called = F.aggregate(F.sequence(F.lit(1), F.lit(ploidy)), state, step, lambda s: s["gt"])
    return F.when(F.size(ad) > 0, F.sort_array(F.concat(called, F.array_repeat(F.lit(None).cast("int"), F.lit(ploidy) - F.size(called)))))


def binomial_survival(k: Column, n: Column, p: float) -> Column:
    """P(X > k) of Binomial(n, p); 1 where n < 2. ``p`` is rounded to 32 bits, as thresholds are single precision.

    The terms up to k go by their recurrence, in logarithms so that deep cells don't underflow.
    """
    import struct

    q = struct.unpack("f", struct.pack("f", p))[0]
    odds = F.lit(q / (1 - q))
    ln_none = F.ln(F.lit(1 - q)) * n
    cdf = F.aggregate(
        F.sequence(F.lit(0).cast("bigint"), k.cast("bigint")),
        F.struct(ln_none.cast("double").alias("ln"), F.lit(0.0).alias("sum")),
        lambda a, i: F.struct(
            (a["ln"] + F.when(i == 0, F.lit(0.0)).when(i > n, F.lit(float("-inf"))).otherwise(F.ln((n - i + 1) / i * odds))).alias("ln"),
            (a["sum"] + F.exp(a["ln"] + F.when(i == 0, F.lit(0.0)).when(i > n, F.lit(float("-inf"))).otherwise(F.ln((n - i + 1) / i * odds)))).alias("sum"),
        ),
        lambda a: a["sum"],
    )
    return F.when(n < 2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - cdf))
