"""Distances of two cells at one site, as Column builders over allele depths.

``pow<p>``, ``depthpow<p>``, ``chi2`` and ``chi2pow<a>-<b>`` are looked up by ``method``. Depths are
arrays of counts, aligned by allele. With ``alleles`` the sum over alleles is unrolled, which Spark
compiles; without it any number of alleles goes through higher-order functions.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Term = Callable[[Column, Column, Column, Column], Column]


def total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("double"), lambda a, x: a + x)


def midpoint_distance(f1: Column, f2: Column) -> Column:
    """Distance of the point (f1, f2) to the diagonal. The order of operations decides the last bit of known results."""
    side = ((f1 - f2) / 2 + f1) - f1
    return F.sqrt(2 * (side * side))


@dataclass(frozen=True)
class Method:
    name: str
    #: (count 1, total 1, count 2, total 2) of one allele -> its term of the sum
    term: Term
    #: what is applied to counts first, and to the sum
    before: Callable[[Column], Column] = lambda x: x
    after: Callable[[Column], Column] = lambda x: x
    #: the term needs fractions only: (fraction 1, fraction 2)
    of_fractions: Callable[[Column, Column], Column] | None = None
    #: (counts of cells, counts of others, each a row a cell and a column an allele) -> distances of all pairs at the site, in numpy
    dense: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None

    @property
    def symmetric(self) -> bool:
        """Whether the order of the cells makes no difference."""
        return self.of_fractions is not None

    def kept(self, ad: Column, alleles: int) -> dict[str, Column]:
        """What a row of one cell keeps for its pairs, worked out once a row: fractions, or counts and their total."""
        counts = [self.before(F.coalesce(F.try_element_at(ad, F.lit(k + 1)), F.lit(0))).cast("double") for k in range(alleles)]
        whole = sum(counts[1:], counts[0])
        if self.of_fractions:
            return {f"f{k}": F.try_divide(c, whole) for k, c in enumerate(counts)}
        return {"t": whole} | {f"c{k}": c for k, c in enumerate(counts)}

    def of_kept(self, a: Callable[[str], Column], b: Callable[[str], Column], alleles: int) -> Column:
        """The distance from what two rows have kept."""
        if self.of_fractions:
            terms = [self.of_fractions(a(f"f{k}"), b(f"f{k}")) for k in range(alleles)]
        else:
            terms = [self.term(a(f"c{k}"), a("t"), b(f"c{k}"), b("t")) for k in range(alleles)]
        return self.after(sum(terms, F.lit(0.0)))

    def __call__(self, ad1: Column, ad2: Column, alleles: int | None = None) -> Column:
        if alleles is None:
            a, b = F.transform(ad1, self.before), F.transform(ad2, self.before)
            pairs = F.zip_with(a, b, lambda x, y: self.term(x.cast("double"), total(a), y.cast("double"), total(b)))
            out = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)
        else:
            at = lambda ad, k: self.before(F.coalesce(F.try_element_at(ad, F.lit(k + 1)), F.lit(0))).cast("double")
            xs, ys = [at(ad1, k) for k in range(alleles)], [at(ad2, k) for k in range(alleles)]
            t1, t2 = sum(xs[1:], xs[0]), sum(ys[1:], ys[0])
            terms = [self.term(x, t1, y, t2) for x, y in zip(xs, ys, strict=True)]
            out = sum(terms, F.lit(0.0))
        same = F.when(F.size(ad1) == F.size(ad2), F.lit(True)).otherwise(F.raise_error(F.lit("Allele counts differ in number")).cast("boolean"))
        return F.when(same, self.after(out))


def _by_fractions(name: str, term: Callable[[Column, Column], Column], dense: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Method:
    return Method(name, lambda x, tx, y, ty: term(F.try_divide(x, tx), F.try_divide(y, ty)), of_fractions=term, dense=dense)


def _dense_pow(p: float, weighted: bool) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Powers of the midpoint distance, |f - g| / sqrt(2); ``weighted``: times the mean of both fractions."""

    def run(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros((len(a), len(b)))
        for f, g in zip((a / a.sum(1, keepdims=True)).T, (b / b.sum(1, keepdims=True)).T, strict=True):
            t = np.subtract.outer(f, g)
            t *= t
            if p == 4:
                t *= t
            elif p != 2:
                np.power(t, p / 2, out=t)
            if weighted:
                t *= np.add.outer(f, g)
            out += t
        out *= 0.5 ** (p / 2) * (0.5 if weighted else 1)
        return out

    return run


def _dense_chi2(a: float = 1.0, b: float = 1.0) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """``_chi2`` of counts to the power a; the sum over alleles to the power b."""

    def run(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        one, two = one**a, two**a
        t1 = one.sum(1)
        both = np.add.outer(t1, two.sum(1))
        out = np.zeros(both.shape)
        for x, y in zip(one.T, two.T, strict=True):
            e = np.add.outer(x, y)
            e /= both
            e *= t1[:, None]
            p, q = x[:, None] - e, y[None, :] - e
            p *= p
            q *= q
            p += q
            # an allele that neither cell has is 0 by 0
            p /= np.where(e > 0, e, 1.0)
            out += p
        return out if b == 1 else out**b

    return run


def _chi2(x: Column, tx: Column, y: Column, ty: Column) -> Column:
    """The expected count uses the first cell's total for both cells; alleles that neither cell has are skipped."""
    e = tx * ((x + y) / (tx + ty))
    part = lambda c: (c - e) * (c - e) / e
    return F.when(x + y > 0, part(x) + part(y)).otherwise(F.lit(0.0))


def method(name: str) -> Method:
    """The method of that name; ValueError for an unknown one."""
    if m := re.fullmatch(r"pow(\d+(?:\.\d+)?)", name):
        p = F.lit(float(m[1]))
        return _by_fractions(name, lambda f, g: F.pow(midpoint_distance(f, g), p), _dense_pow(float(m[1]), False))
    if m := re.fullmatch(r"depthpow(\d+(?:\.\d+)?)", name):
        p = F.lit(float(m[1]))
        return _by_fractions(name, lambda f, g: F.pow(midpoint_distance(f, g), p) * ((f + g) / 2), _dense_pow(float(m[1]), True))
    if name == "chi2":
        return Method(name, _chi2, dense=_dense_chi2())
    if m := re.fullmatch(r"chi2pow(\d+(?:\.\d+)?)-(\d+(?:\.\d+)?)", name):
        a, b = float(m[1]), float(m[2])
        return Method(name, _chi2, lambda x: F.pow(x.cast("double"), F.lit(a)), lambda x: F.pow(x, F.lit(b)), dense=_dense_chi2(a, b))
    raise ValueError(f"Method '{name}' does not exist")
