"""Column expressions of analysis and number theory; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def omega(t: Column) -> Column:
    """|t| e^-|t| / (1 + e^-|t|)^2 with the sign of t: never overflows."""
    a = F.abs(t)
    e = F.exp(-a)
    return F.signum(t) * a * e / F.pow(1 + e, 2)


def lorentzian(sigma: Column, tau: Column, sigma2: Column, tau2: Column, eps: Column) -> tuple[Column, Column]:
    """Real and imaginary part of eps^2 / (eps^2 - (conj(s) + s' - 1)^2)."""
    a, b = sigma + sigma2 - 1, tau2 - tau
    re, im = eps * eps - (a * a - b * b), -2 * a * b
    size = re * re + im * im
    return F.try_divide(eps * eps * re, size), F.try_divide(-(eps * eps) * im, size)


#: Real primitive characters by conductor, from residue 0 on.
CHARACTERS = {1: [1], 3: [0, 1, -1], 4: [0, 1, 0, -1], 5: [0, 1, -1, -1, 1], 7: [0, 1, 1, -1, 1, -1, -1]}


def character(q: int, n: Column) -> Column:
    """A real Dirichlet character by its table."""
    return F.element_at(F.array(*map(F.lit, CHARACTERS[q])), F.pmod(n, F.lit(q)).cast("int") + 1)


def character_at_power(q: int, p: Column, j: Column) -> Column:
    """chi(p)^j; the empty power is 1."""
    c = character(q, p)
    return F.when(j == 0, 1).when(j % 2 == 0, c * c).otherwise(c)


def zero_height(n: Column, steps: int = 30) -> Column:
    """Newton's method on t/(2 pi) (ln(t/(2 pi)) - 1) = n - 7/8 from a fixed start; null for n under 1."""
    two_pi = 2 * F.pi()
    start = two_pi * F.exp(F.lit(1.0)) + two_pi * n
    step = lambda t, _: t - ((t / two_pi) * (F.log(t / two_pi) - 1) - (n - 0.875)) / (F.log(t / two_pi) / two_pi)
    return F.when(n >= 1, F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step))


def horner(coefficients: Column, x: Column) -> Column:
    """Value of a polynomial with an array of ascending coefficients."""
    return F.aggregate(F.reverse(coefficients), F.lit(0.0), lambda a, c: a * x + c)


def rounded(x: Column, places: int) -> Column:
    """``x`` to so many places, with its own sign where that is 0: -0.0 for what is under 0, as C's rounding has it. Spark's round makes it 0.0."""
    r = F.round(x, places)
    return F.when(r == 0, x * 0.0).otherwise(r)


def relative_difference(a: Column, b: Column) -> Column:
    """|a - b| over the larger size; equal numbers differ by 0."""
    return F.when(a == b, 0.0).otherwise(F.abs(a - b) / F.greatest(F.abs(a), F.abs(b)))


def sturm_count(diagonal: Column, off: Column, x: Column) -> Column:
    """Eigenvalues of a symmetric tridiagonal matrix under x: negative terms of the Sturm recurrence."""
    first = diagonal[0] - x
    start = F.struct(first.alias("q"), (first < 0).cast("int").alias("n"))

    def step(a, k):
        q = diagonal[k] - x - off[k - 1] * off[k - 1] / F.when(a["q"] == 0, F.lit(1e-300)).otherwise(a["q"])
        return F.struct(q.alias("q"), (a["n"] + (q < 0).cast("int")).alias("n"))

    return F.aggregate(F.sequence(F.lit(1), F.size(diagonal) - 1), start, step, lambda a: a["n"])


def bisect(f, lo: Column, hi: Column, steps: int = 60) -> Column:
    """A root of f in a bracket by so many halvings; f maps a column to a column."""
    start = F.struct(lo.cast("double").alias("a"), hi.cast("double").alias("b"))

    def step(s, _):
        m = (s["a"] + s["b"]) / 2
        left = F.signum(f(s["a"])) * F.signum(f(m)) <= 0
        return F.struct(F.when(left, s["a"]).otherwise(m).alias("a"), F.when(left, m).otherwise(s["b"]).alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: (s["a"] + s["b"]) / 2)


def energy_distance(rayleigh: Column, ground: Column, floor: Column) -> Column:
    """Bound on the distance of a unit vector to the ground state from its energy; null if the premises fail."""
    t = F.least((rayleigh - ground) / (floor - ground), F.lit(1.0))
    return F.when((floor > ground) & (rayleigh >= ground), F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.sqrt(1 - t))))


def prolate_log_deficiency(mode: Column, c: Column) -> Column:
    """Leading logarithm of 1 - |chi_n| for an even mode n (to 20) and c = lambda^2: log(2 sqrt(pi) 8^n (2 pi)^(n + 1/2) / n!) + (n + 1/2) log c - 4 pi c; null elsewhere."""
    n = mode.cast("double")
    size = F.log(2 * F.sqrt(F.pi())) + n * F.log(F.lit(8.0)) + (n + 0.5) * F.log(2 * F.pi()) - F.log(F.factorial(mode.cast("int")).cast("double"))
    return F.when((mode % 2 == 0) & mode.between(0, 20) & (c >= 1), size + (n + 0.5) * F.log(c) - 4 * F.pi() * c)
