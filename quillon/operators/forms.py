"""Forms: pivots of leading blocks, moments over the simplex and exact Rayleigh ratios."""

from __future__ import annotations

from fractions import Fraction
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prefix_pivots(matrices: DataFrame, by: str = "matrix_id", margin: float = 1e-12) -> DataFrame:
    """(matrix, dimension, pivot, trace1) of unpivoted LDL of each leading block; stops where a pivot is not positive, and keeps the rows before.

    trace1 is the sum of inverse pivots so far. A matrix is one group.
    """

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["i"].max()) + 1
        a = np.zeros((n, n))
        a[pdf["i"], pdf["j"]] = pdf["v"]
        rows, total = [], 0.0
        for k in range(n):
            p = a[k, k]
            if p <= margin * max(1.0, np.abs(a[k]).max()):
                break
            total += 1 / p
            rows.append((key[0], k + 1, p, total))
            a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :]) / p
        return pd.DataFrame(rows, columns=[by, "dimension", "pivot", "trace1"])

    return matrices.groupBy(by).applyInPandas(run, f"{by} {matrices.schema[by].dataType.simpleString()}, dimension long, pivot double, trace1 double")


def simplex_moments(indices: DataFrame, index: str = "index") -> DataFrame:
    """Integral of the monomial over the unit simplex: product of factorials over (k + degree)!."""
    fact = lambda c: F.factorial(c.cast("int")).cast("double")
    top = F.aggregate(F.transform(index, fact), F.lit(1.0), lambda a, v: a * v)
    degree = F.aggregate(index, F.lit(0), lambda a, v: a + v)
    return indices.withColumn("moment", top / fact(F.size(index) + degree))


def exact_moment(index: list[int]) -> Fraction:
    """The same as a fraction."""
    top = 1
    for n in index:
        top *= factorial(n)
    return Fraction(top, factorial(len(index) + sum(index)))


def rayleigh_ratio(form: list[list], gram: list[list], x: list) -> Fraction:
    """x^T A x / x^T B x exactly."""
    value = lambda m: sum(Fraction(a) * m[i][j] * Fraction(b) for i, a in enumerate(x) for j, b in enumerate(x))
    return Fraction(value(form)) / Fraction(value(gram))


def symmetric_forms(k: int, degree: int) -> tuple[list[tuple[int, ...]], list[list[Fraction]], list[list[Fraction]]]:
    """(partitions, I, J) over the simplex for orbit sums of monomials in k variables up to a degree: exact Gram form I and the form J of one-variable integrals.

    J sums, over the variables, the square of the integral over that variable alone.
    """
    from itertools import permutations

    def parts(n: int, most: int, room: int) -> list[tuple[int, ...]]:
        if n == 0:
            return [()]
        return [(p, *rest) for p in range(min(n, most), 0, -1) if room for rest in parts(n - p, p, room - 1)]

    basis = [p for n in range(degree + 1) for p in parts(n, n, k)]
    orbits = [sorted(set(permutations((*p, *[0] * (k - len(p)))))) for p in basis]

    def moment(a: tuple[int, ...], b: tuple[int, ...]) -> Fraction:
        return exact_moment([x + y for x, y in zip(a, b, strict=True)])

    def reduced(a: tuple[int, ...], b: tuple[int, ...], i: int) -> Fraction:
        """Integral over the others of the product of both monomials' integrals over x_i, from 0 to 1 less the others."""
        rest = [x + y for j, (x, y) in enumerate(zip(a, b, strict=True)) if j != i]
        extra = a[i] + b[i] + 2
        top = factorial(extra)
        for n in rest:
            top *= factorial(n)
        return Fraction(top, factorial(len(rest) + sum(rest) + extra) * (a[i] + 1) * (b[i] + 1))

    gram = [[sum((moment(a, b) for a in p for b in q), Fraction(0)) for q in orbits] for p in orbits]
    form = [[sum((reduced(a, b, i) for a in p for b in q for i in range(k)), Fraction(0)) for q in orbits] for p in orbits]
    return basis, gram, form


def monomial_forms(k: int, degree: int) -> tuple[list[tuple[int, ...]], list[list[Fraction]], list[list[Fraction]]]:
    """The same on single monomials."""
    from itertools import product

    basis = sorted((a for a in product(range(degree + 1), repeat=k) if sum(a) <= degree), key=lambda a: (sum(a), a))
    gram = [[exact_moment([x + y for x, y in zip(a, b, strict=True)]) for b in basis] for a in basis]
    form = []
    for a in basis:
        row = []
        for b in basis:
            total = Fraction(0)
            for i in range(k):
                rest = [x + y for j, (x, y) in enumerate(zip(a, b, strict=True)) if j != i]
                top = factorial(a[i] + b[i] + 2)
                for n in rest:
                    top *= factorial(n)
                total += Fraction(top, factorial(len(rest) + sum(rest) + a[i] + b[i] + 2) * (a[i] + 1) * (b[i] + 1))
            row.append(total)
        form.append(row)
    return basis, gram, form


def largest_ratio(form: list[list[Fraction]], gram: list[list[Fraction]]) -> tuple[float, list[Fraction]]:
    """(greatest x^T J x / x^T I x in doubles, its vector as fractions): a lower bound that rayleigh_ratio proves."""
    a, b = (np.array([[float(v) for v in row] for row in m]) for m in (form, gram))
    low = np.linalg.cholesky(b)
    c = np.linalg.solve(low, np.linalg.solve(low, a).T)
    w, v = np.linalg.eigh((c + c.T) / 2)
    x = np.linalg.solve(low.T, v[:, -1])
    return float(w[-1]), [Fraction(float(t)).limit_denominator(10**9) for t in x / np.abs(x).max()]


def orthonormal(gram: list[list[Fraction]]) -> list[tuple[list[Fraction], Fraction]]:
    """(vector, square of its length) of an orthogonal basis by exact elimination; the lengths stay squared, so nothing is rounded."""
    out: list[tuple[list[Fraction], Fraction]] = []
    dot = lambda x, y: sum((p * gram[i][j] * q for i, p in enumerate(x) if p for j, q in enumerate(y) if q), Fraction(0))
    for k in range(len(gram)):
        x = [Fraction(int(i == k)) for i in range(len(gram))]
        for y, size in out:
            f = dot(x, y) / size
            x = [a - f * b for a, b in zip(x, y, strict=True)]
        out.append((x, dot(x, x)))
    return out


def band_action(basis: list[tuple[int, ...]], form: list[list[Fraction]], half_width: int) -> tuple[list[list[Fraction]], Fraction]:
    """(the form between monomials whose degrees differ by at most so much, a bound on what is left out: its greatest row sum)."""
    near = [[v if abs(sum(a) - sum(b)) <= half_width else Fraction(0) for b, v in zip(basis, row, strict=True)] for a, row in zip(basis, form, strict=True)]
    tail = max(sum(abs(v - w) for v, w in zip(row, own, strict=True)) for row, own in zip(form, near, strict=True))
    return near, tail


def sectors(basis: list[tuple[int, ...]], form: list[list[Fraction]]) -> tuple[int, int, bool]:
    """(dimension of the symmetric sector, of the rest, whether the form keeps them apart) under permutations of the variables."""
    place = {a: i for i, a in enumerate(basis)}
    groups: dict[tuple[int, ...], list[int]] = {}
    for a, i in place.items():
        groups.setdefault(tuple(sorted(a, reverse=True)), []).append(i)
    apart = all(
        len({sum(form[i][j] for j in other) for i in own}) == 1 for own in groups.values() for other in groups.values()
    )  # a symmetric vector goes to a symmetric one
    return len(groups), len(basis) - len(groups), apart
