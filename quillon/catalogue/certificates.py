"""Queries of exact and enclosed arithmetic, counts of zeros, certified roots, precise functions and numbers as text."""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import functions as F

from ..functions import analytic, certified, shown
from ..functions.certified import Complex, Interval, rowwise
from ..operators import exact_sums, forms, transforms
from ..registry import query
from ..sources.tables import table
from .spectra import by_matrix

SIZES = "(SELECT n_nationkey AS matrix_id, 5 + n_nationkey % 8 AS n FROM nation)"


def as_double(c):
    """A fraction's text as a double."""
    return F.try_divide(F.split(c, "/")[0].cast("double"), F.coalesce(F.get(F.split(c, "/"), F.lit(1)), F.lit("1")).cast("double"))


def pieces(spark, d):
    """Parts with whole numbers s from 1 and k from -3 to 3."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("s"), (F.col("p_partkey") % 7 - 3).alias("k"))


PIECES = "(SELECT p_partkey AS id, p_size AS s, p_partkey % 7 - 3 AS k FROM part)"


@query("interval_algebra", f"""SELECT id, op, round(lo, 9) AS lo, round(hi, 9) AS hi FROM (
 SELECT id, 'add' AS op, s + k::DOUBLE AS lo, s + 1 + k + 1::DOUBLE AS hi FROM {PIECES} UNION ALL SELECT id, 'sub', s - k - 1, s + 1 - k FROM {PIECES}
 UNION ALL SELECT id, 'mul', least(s * k, (s + 1) * k), greatest(s * (k + 1), (s + 1) * (k + 1)) FROM {PIECES}
 UNION ALL SELECT id, 'div', CASE WHEN k > 0 THEN s / (k + 1.0::DOUBLE) WHEN k < -1 THEN (s + 1) / (k + 1.0::DOUBLE) END, CASE WHEN k > 0 THEN (s + 1) / k::DOUBLE WHEN k < -1 THEN s / k::DOUBLE END FROM {PIECES}
 UNION ALL SELECT id, 'square', s * s, (s + 1) * (s + 1) FROM {PIECES} UNION ALL SELECT id, 'hull', least(s, k), greatest(s + 1, k + 1) FROM {PIECES})""")
def interval_algebra(spark, d):
    """[s, s + 1] and [k, k + 1]; a divisor that holds zero gives nothing."""
    text = lambda c: c.cast("string")
    p = pieces(spark, d).withColumn("op", F.explode(F.array(*map(F.lit, ["add", "sub", "mul", "div", "square", "hull"]))))
    out = p.withColumn("r", certified.interval_operation("op", text(F.col("s")), text(F.col("s") + 1), text(F.col("k")), text(F.col("k") + 1)))
    return out.select("id", "op", F.round(as_double(F.col("r.lo")), 9).alias("lo"), F.round(as_double(F.col("r.hi")), 9).alias("hi"))


@query("directed_intervals", f"SELECT id, round(s / 7.0::DOUBLE, 9) AS lo, round((s + 1) / 3.0::DOUBLE, 9) AS hi, true AS outward FROM {PIECES}")
def directed_intervals(spark, d):
    """[s, s + 1] / [3, 7] at 20 digits: the ends lie outside of the exact ones."""
    n = lambda c: F.lit(c) if isinstance(c, str) else c.cast("string")
    p = pieces(spark, d).withColumn("r", certified.directed_operation(F.lit("div"), n(F.col("s")), n(F.col("s") + 1), n("3"), n("7"), F.lit(20)))
    outside = rowwise(lambda lo, hi, s: Fraction(lo) <= Fraction(int(s), 7) and Fraction(hi) >= Fraction(int(s) + 1, 3) and Fraction(hi) - Fraction(int(s) + 1, 3) < Fraction(1, 10**15), "boolean")
    return p.select("id", F.round(F.col("r.lo").cast("double"), 9).alias("lo"), F.round(F.col("r.hi").cast("double"), 9).alias("hi"), outside("r.lo", "r.hi", "s").alias("outward"))


@query("interval_dot", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: least(x::DOUBLE, 2 * x::DOUBLE))), 6) AS lo, round(list_sum(list_transform(embedding, lambda x: greatest(x::DOUBLE + 1, 2 * (x::DOUBLE + 1)))), 6) AS hi FROM embeddings")
def interval_dot(spark, d):
    """Of [x, x + 1] with [1, 2], entry by entry, exactly."""

    def ends(x):
        v = certified.dot([Interval(Fraction(float(c)), Fraction(float(c)) + 1) for c in x], [Interval(1, 2)] * len(x))
        return float(v.lo), float(v.hi)

    out = table(spark, d, "embeddings").select("vec_id", rowwise(ends, "struct<lo:double,hi:double>")("embedding").alias("r"))
    return out.select("vec_id", F.round("r.lo", 6).alias("lo"), F.round("r.hi", 6).alias("hi"))


ROWS = f"(SELECT matrix_id, n, i, 2 - m * 1.125::DOUBLE AS lo, 2.25 - m::DOUBLE AS hi FROM (SELECT *, CAST(i > 0 AS INT) + CAST(i < n - 1 AS INT) AS m FROM {SIZES}, (SELECT unnest(range(0, 12)) AS i) WHERE i < n))"


def enclosed(a):
    return [[Interval(int(v)) for v in row] for row in a]


@query("interval_matvec", f"SELECT matrix_id, CAST(i AS BIGINT) AS i, lo, hi FROM {ROWS}")
def interval_matvec(spark, d):
    def solve(a):
        return [(i, float(v.lo), float(v.hi)) for i, v in enumerate(certified.matvec(enclosed(a), [Interval(1, Fraction(9, 8))] * len(a)))]

    return by_matrix(spark, d, solve, "i long, lo double, hi double")


@query("interval_quadratic_form", f"SELECT matrix_id, round(sum(least(lo, lo * 1.125)), 9) AS lo, round(sum(greatest(hi, hi * 1.125)), 9) AS hi FROM {ROWS} GROUP BY 1")
def interval_quadratic_form(spark, d):
    def solve(a):
        v = certified.quadratic_form(enclosed(a), [Interval(1, Fraction(9, 8))] * len(a))
        return [(round(float(v.lo), 9), round(float(v.hi), 9))]

    return by_matrix(spark, d, solve, "lo double, hi double")


@query("interval_rayleigh", f"SELECT matrix_id, round(2 / n::DOUBLE, 10) AS lo, round(2 / n::DOUBLE, 10) AS hi FROM {SIZES}")
def interval_rayleigh(spark, d):
    """Of the vector of ones: a point."""

    def solve(a):
        v = certified.rayleigh(enclosed(a), [Interval(1)] * len(a))
        return [(round(float(v.lo), 10), round(float(v.hi), 10))]

    return by_matrix(spark, d, solve, "lo double, hi double")


@query("rational_contraction", "SELECT user_id, round(sum(least(value, 2 * value)), 4) AS lo, round(sum(greatest(value + 1, 2 * (value + 1))), 4) AS hi FROM events GROUP BY user_id")
def rational_contraction(spark, d):
    """Exact sums of products of intervals, each end rounded once."""
    e = table(spark, d, "events").select("user_id", F.col("value").alias("lo"), (F.col("value") + 1).alias("hi"))
    whole = exact_sums.interval_contraction(e, ["user_id"], "lo", "hi", F.lit(1.0), F.lit(2.0))
    return whole.select("user_id", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))


@query("complex_rationals", f"SELECT id, round((s * k + 2.0::DOUBLE) / (k * k + 4), 10) AS re, round((k - 2.0 * s::DOUBLE) / (k * k + 4), 10) AS im, s * s + 1 AS norm FROM {PIECES}")
def complex_rationals(spark, d):
    """(s + i) / (k + 2 i), exactly."""

    def divide(s, k):
        z = Complex(Fraction(int(s)), Fraction(1)) / Complex(Fraction(int(k)), Fraction(2))
        return float(z.re), float(z.im), int(Complex(int(s), 1).norm())

    out = pieces(spark, d).select("id", rowwise(divide, "struct<re:double,im:double,norm:int>")("s", "k").alias("z"))
    return out.select("id", F.round("z.re", 10).alias("re"), F.round("z.im", 10).alias("im"), F.col("z.norm").alias("norm"))


@query("exact_polynomials", f"SELECT id, round(1 - 2 * x + 3 * x * x, 9) AS value, round(1 - 2 * x + 3 * (x * x - 0.25), 9) AS re, round(-1 + 3 * x, 9) AS im, round(6 * x - 2, 9) AS slope, round(least(1 - 2 * (x + 1) + 3 * x * x, 1 - 2 * x + 3 * x * x), 9) >= round(1 + x * (3 * x - 2) - 2, 9) AS enclosed FROM (SELECT id, s / 7.0::DOUBLE AS x FROM {PIECES})")
def exact_polynomials(spark, d):
    """1 - 2 x + 3 x^2 at s/7, at s/7 + i/2, its slope, and whether its enclosure over [x, x + 1] holds its value."""
    p = [1, -2, 3]

    def value(s):
        x = Fraction(int(s), 7)
        z = certified.complex_polynomial(p, Complex(x, Fraction(1, 2)))
        box = certified.complex_polynomial(p, Complex(Interval(x, x + 1), Interval(0)))
        own = certified.polynomial([Fraction(c) for c in p], x)
        return float(own), float(z.re), float(z.im), float(certified.polynomial([Fraction(c) for c in certified.derivative(p)], x)), box.re.contains(own)

    out = pieces(spark, d).select("id", rowwise(value, "struct<value:double,re:double,im:double,slope:double,enclosed:boolean>")("s").alias("r"))
    return out.select("id", *[F.round(f"r.{c}", 9).alias(c) for c in ("value", "re", "im", "slope")], F.col("r.enclosed").alias("enclosed"))


def by_nation(spark, d, f, kind: str):
    """Columns of ``f`` (a function of the nation's number) for each nation."""
    out = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), rowwise(f, kind)("n_nationkey").alias("r"))
    return out.select("id", "r.*")


@query("contour_counts", "SELECT n_nationkey AS id, n_nationkey % 4 + 3 AS whole, CAST((SELECT count(*) FROM (SELECT unnest(range(0, 6)) AS k) WHERE k < n_nationkey % 4 + 3 AND cos(2 * pi() * k / (n_nationkey % 4 + 3)) > 0.1) AS INT) AS half, 'counted' AS status, 'inconclusive' AS through FROM nation")
def contour_counts(spark, d):
    """Zeros of z^n - 1 in a square, in a part of it, and along an edge through one of them."""

    def count(k):
        p = [-1] + [0] * (int(k) % 4 + 2) + [1]
        whole, status = certified.contour_count(p, -2, 2, -2, 2)
        half, _ = certified.contour_count(p, Fraction(1, 10), 2, -2, 2)
        return whole, half, status, certified.contour_count(p, -2, 1, -2, 2)[1]

    return by_nation(spark, d, count, "struct<whole:int,half:int,status:string,through:string>")


@query("rational_contours", "SELECT n_nationkey AS id, n_nationkey % 4 + 1 AS net, 'counted' AS status FROM nation")
def rational_contours(spark, d):
    """(z^n - 1) / (z^2 + 4): zeros less poles."""
    return by_nation(spark, d, lambda k: certified.rational_contour([-1] + [0] * (int(k) % 4 + 2) + [1], [4, 0, 1], -3, 3, -3, 3), "struct<net:int,status:string>")


@query("circle_counts", "SELECT n_nationkey AS id, n_nationkey % 4 + 3 AS outer_count, 0 AS inner_count, 'inconclusive' AS through FROM nation")
def circle_counts(spark, d):
    def count(k):
        p = [-1] + [0] * (int(k) % 4 + 2) + [1]
        return certified.circle_count(p, 0, 2)[0], certified.circle_count(p, 0, Fraction(1, 2))[0], certified.circle_count(p, 0, 1)[1]

    return by_nation(spark, d, count, "struct<outer_count:int,inner_count:int,through:string>")


@query("sturm_outcomes", """SELECT n_nationkey AS id, CASE WHEN n_nationkey % 5 = 4 THEN NULL WHEN n_nationkey % 4 = 0 AND n_nationkey BETWEEN 4 AND 20 THEN NULL ELSE CAST((SELECT count(*) FROM (SELECT unnest(range(1, 6)) AS r) WHERE r < n_nationkey / 4.0) AS INT) END AS roots,
 CASE WHEN n_nationkey % 4 = 0 AND n_nationkey BETWEEN 4 AND 20 THEN 'endpoint_root' WHEN n_nationkey % 5 = 4 THEN 'multiple_root' ELSE 'counted' END AS status FROM nation""")
def sturm_outcomes(spark, d):
    """(x-1)...(x-5) over (0, n/4), squared for some: roots at an end and repeated roots are refused."""

    def count(k):
        p = [Fraction(1)]
        for r in [1, 2, 3, 4, 5] * (2 if k % 5 == 4 else 1):
            p = [(p[j - 1] if j else 0) - (r * p[j] if j < len(p) else 0) for j in range(len(p) + 1)]
        return certified.sturm_outcome(p, 0, Fraction(int(k), 4))

    return by_nation(spark, d, count, "struct<roots:int,status:string>")


@query("interval_newton", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 > 0 THEN round(sqrt(p_size + 0.5::DOUBLE), 8) END AS root, CASE WHEN p_partkey % 3 > 0 THEN 'unique' ELSE 'none' END AS status, p_partkey % 3 > 0 AS verified FROM part")
def interval_newton(spark, d):
    """x^2 = s + 1/2 in a box of width one that holds the root, or two to the right of it; parts with one equation and box share its answer."""

    def find(s, near):
        p, lo = [-Fraction(int(s)) - Fraction(1, 2), Fraction(0), Fraction(1)], int((int(s) + 0.5) ** 0.5) + (0 if near else 2)
        lo = max(lo, Fraction(1, 4))
        a, b, status = certified.interval_newton(p, lo, int(lo) + 1)
        return float((a + b) / 2) if status == "unique" else None, status, status == "unique" and certified.verified_root(p, a, b)

    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("s"), (F.col("p_partkey") % 3 != 0).alias("near"))
    asked = part.select("s", "near").distinct()
    out = part.join(asked.select("s", "near", rowwise(find, "struct<root:double,status:string,verified:boolean>")("s", "near").alias("r")), ["s", "near"])
    return out.select("id", F.round("r.root", 8).alias("root"), F.col("r.status").alias("status"), F.col("r.verified").alias("verified"))


@query("partial_certification", "SELECT n_nationkey AS id, k AS ordinal, CASE WHEN k = 1 THEN 'ValueError' WHEN k = 3 THEN 'none' ELSE 'certified' END AS status, CASE WHEN k NOT IN (1, 3) THEN round(sqrt(k + 2.0::DOUBLE) + n_nationkey, 7) END AS root FROM nation, (SELECT unnest(range(0, 5)) AS k)")
def partial_certification(spark, d):
    """Boxes of ((x - n)^2 - 2)...: one is upside down and one is empty; the others are certified nevertheless."""

    def certify(k):
        n, out = int(k), []
        for j in range(5):
            p = [Fraction(n * n - j - 2), Fraction(-2 * n), Fraction(1)]
            lo, hi = n + Fraction(int(((j + 2) ** 0.5 - 0.2) * 16), 16), n + Fraction(int(((j + 2) ** 0.5 + 0.2) * 16), 16)
            box = (hi, lo) if j == 1 else (lo + 3, hi + 3) if j == 3 else (lo, hi)
            _, a, b, status = certified.certified(p, [box])[0]
            out.append((j, status, float((a + b) / 2) if status == "certified" else None))
        return out

    out = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.explode(rowwise(certify, "array<struct<ordinal:bigint,status:string,root:double>>")("n_nationkey")).alias("r"))
    return out.select("id", "r.ordinal", "r.status", F.round("r.root", 7).alias("root"))


@query("rayleigh_certificate", f"SELECT matrix_id, CAST(n * n + n AS BIGINT) AS top, CAST(n * (n + 1) * (2 * n + 1) // 6 AS BIGINT) AS bottom FROM {SIZES}")
def rayleigh_certificate(spark, d):
    """x^T A x / x^T x of x = 1..n as a fraction, its terms times a common factor taken out."""

    def solve(a):
        n = len(a)
        r = forms.rayleigh_ratio(a.astype(int).tolist(), [[int(i == j) for j in range(n)] for i in range(n)], list(range(1, n + 1)))
        scale = (n * n + n) // r.numerator
        return [(r.numerator * scale, r.denominator * scale)]

    return by_matrix(spark, d, solve, "top long, bottom long")


# --- Precise and complex functions


@query("omega_precise", "SELECT p_partkey AS id, round((p_size / 8.0::DOUBLE) * exp(-p_size / 8.0::DOUBLE) / power(1 + exp(-p_size / 8.0::DOUBLE), 2), 12) AS omega FROM part")
def omega_precise(spark, d):
    t = (F.col("p_size") / F.lit(8)).cast("decimal(12,4)").cast("string")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(analytic.omega_at(t, F.lit(30)).cast("double"), 12).alias("omega"))


def simpson(factor: str) -> str:
    """The transform by Simpson's rule in ln u over [1/3, 3], for SQL."""
    step = "(2 * ln(3.0::DOUBLE) / 2000)"
    f = f"w * u * exp((sigma - 1) * ln(u)) * (u * exp(-u) / power(1 + exp(-u), 2)) * ({factor})"
    return f"""WITH u AS (SELECT exp(-ln(3.0::DOUBLE) + k * {step}) AS u, CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * {step} / 3 AS w FROM (SELECT unnest(range(0, 2001)) AS k)),
 s AS (SELECT DISTINCT p_size, p_size / 50.0::DOUBLE AS sigma, p_size / 10.0::DOUBLE AS tau FROM part),
 v AS (SELECT p_size, sum({f} * cos(tau * ln(u))) AS re, sum({f} * sin(tau * ln(u))) AS im FROM s, u GROUP BY 1)"""


SERIES = "1 + 2 * 0.5 * cos(pi() * ln(u) / ln(3.0::DOUBLE)) + 2 * 0.25 * cos(2 * pi() * ln(u) / ln(3.0::DOUBLE))"


def points(spark, d):
    return table(spark, d, "part").select("p_size").distinct().select(F.col("p_size").alias("size"), (F.col("p_size") / 50.0).alias("sigma"), (F.col("p_size") / 10.0).alias("tau"))


@query("transform_precise", simpson("1") + " SELECT p_size AS size, round(re, 8) AS re, round(im, 8) AS im FROM v")
def transform_precise(spark, d):
    """48 nodes at 20 digits, for each size once."""
    p = points(spark, d)
    text = lambda c: F.col(c).cast("decimal(12,4)").cast("string")
    out = p.select("size", analytic.transform_at(text("sigma"), text("tau"), F.lit("3"), F.lit(48), F.lit(20)).alias("v"))
    return out.select("size", F.round(F.col("v.re").cast("double"), 8).alias("re"), F.round(F.col("v.im").cast("double"), 8).alias("im"))


@query("weighted_transform", simpson(SERIES) + " SELECT p_size AS size, round(re, 8) AS re, round(im, 8) AS im FROM v")
def weighted_transform(spark, d):
    return transforms.weighted(points(spark, d), "size", "sigma", "tau", 3.0, [1.0, 0.5, 0.25], 64).select("size", F.round("re", 8).alias("re"), F.round("im", 8).alias("im"))


@query("weighted_transform_precise", simpson(SERIES) + " SELECT p_size AS size, round(re, 8) AS re, round(im, 8) AS im FROM v")
def weighted_transform_precise(spark, d):
    text = lambda c: F.col(c).cast("decimal(12,4)").cast("string")
    xi = F.array(F.lit("1"), F.lit("0.5"), F.lit("0.25"))
    out = points(spark, d).select("size", analytic.weighted_at(text("sigma"), text("tau"), F.lit("3"), F.lit(48), F.lit(20), xi).alias("v"))
    return out.select("size", F.round(F.col("v.re").cast("double"), 8).alias("re"), F.round(F.col("v.im").cast("double"), 8).alias("im"))


@query("lorentzian_precise", "SELECT s_suppkey AS id, round(re / (re * re + im * im), 10) AS re, round(-im / (re * re + im * im), 10) AS im FROM (SELECT s_suppkey, 1 - (0.2::DOUBLE * 0.2 - power(s_nationkey / 4.0::DOUBLE, 2)) AS re, -2 * 0.2 * (s_nationkey / 4.0::DOUBLE) AS im FROM supplier)")
def lorentzian_precise(spark, d):
    """At s = 0.6 and s' = 0.6 + i n/4 with width one."""
    n = (F.col("s_nationkey") / F.lit(4)).cast("decimal(12,4)").cast("string")
    v = analytic.lorentzian_at(F.lit("0.6"), F.lit("0"), F.lit("0.6"), n, F.lit("1"), F.lit(30))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), v.alias("v")).select("id", F.round(F.col("v.re").cast("double"), 10).alias("re"), F.round(F.col("v.im").cast("double"), 10).alias("im"))


@query("lorentzian_limit", "SELECT a.n_nationkey AS i, b.n_nationkey AS j, round(1e-4 / (1e-4 + power(b.n_nationkey - a.n_nationkey, 2)), 10) AS re, round(abs(1e-4 / (1e-4 + power(b.n_nationkey - a.n_nationkey, 2)) - CAST(a.n_nationkey = b.n_nationkey AS INT)), 10) AS deviation FROM nation a, nation b")
def lorentzian_limit(spark, d):
    """How far a narrow kernel on the critical line is from the exact delta of its ordinates."""
    from ..functions import numbers

    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("i"))
    both = n.crossJoin(n.select(F.col("i").alias("j")))  # of the 25 nations, the matrix that is asked for
    re, im = numbers.lorentzian(F.lit(0.5), F.col("i").cast("double"), F.lit(0.5), F.col("j").cast("double"), F.lit(0.01))
    gap = F.hypot(re - (F.col("i") == F.col("j")).cast("double"), im)
    return both.select("i", "j", F.round(re, 10).alias("re"), F.round(gap, 10).alias("deviation"))


@query("polygamma", """SELECT n_nationkey AS id, round((SELECT coalesce(sum(1 / k::DOUBLE), 0) FROM (SELECT unnest(range(1, 26)) AS k) WHERE k <= n_nationkey) - 0.5772156649015329, 9) AS digamma,
 round(pi() * pi() / 6 - (SELECT coalesce(sum(1 / power(k, 2)), 0) FROM (SELECT unnest(range(1, 26)) AS k) WHERE k <= n_nationkey), 9) AS trigamma, round(pi() / 2 * (exp(2 * pi() * n_nationkey / 10) - 1) / (exp(2 * pi() * n_nationkey / 10) + 1), 9) AS on_line, true AS pole FROM nation""")
def polygamma(spark, d):
    """At n + 1 (harmonic numbers), at 1/2 + i n/10 (imaginary part: pi/2 tanh), and at a pole."""
    n = F.col("n_nationkey")
    at = lambda order, re, im: analytic.polygamma_at(F.lit(order), re.cast("double"), im.cast("double"))
    out = table(spark, d, "nation").select(n.alias("id"), at(0, n + 1, F.lit(0)).alias("d"), at(1, n + 1, F.lit(0)).alias("t"), at(0, F.lit(0.5), n / 10).alias("l"), at(0, -n, F.lit(0)).alias("p"))
    return out.select("id", F.round("d.re", 9).alias("digamma"), F.round("t.re", 9).alias("trigamma"), F.round("l.im", 9).alias("on_line"), F.col("p.re").isNull().alias("pole"))


@query("screw_function", """WITH n AS (SELECT unnest(range(2, 151)) AS n), c AS (SELECT DISTINCT a.n * b.n AS n FROM n a JOIN n b ON a.n <= 12 AND b.n >= a.n AND a.n * b.n <= 150), p AS (SELECT n AS p FROM n ANTI JOIN c USING (n)),
 pp AS (SELECT round(power(p, j)) AS n, p FROM p, (SELECT unnest(range(1, 8)) AS j) WHERE round(power(p, j)) <= 150), t AS (SELECT DISTINCT abs(c_custkey % 161 - 80) / 16.0::DOUBLE AS t FROM customer),
 v AS (SELECT t, -4 * (exp(t / 2) + exp(-t / 2) - 2) + t / 2 * (pi() / 2 + 0.5772156649015329 + 3 * ln(2) + ln(pi())) + ((SELECT sum(exp(-t / 2 - 2 * k * t) / power(k + 0.25, 2)) FROM (SELECT unnest(range(0, 500)) AS k)) - power(pi(), 2) - 8 * 0.915965594177219) / 4
 + coalesce((SELECT sum(ln(p) / sqrt(n) * (t - ln(n))) FROM pp WHERE ln(n) <= t), 0) AS g FROM t WHERE t > 0)
 SELECT c_custkey AS id, CASE WHEN c_custkey % 161 = 80 THEN 0 ELSE round(g, 8) END AS g FROM customer LEFT JOIN v ON t = abs(c_custkey % 161 - 80) / 16.0""")
def screw_function(spark, d):
    """At 161 points of [-5, 5]; the SQL sums the slow series at all of them."""
    points = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), ((F.col("c_custkey") % 161 - 80) / 16.0).alias("t"))
    return transforms.screw(points, "id", "t", 5.0).select("id", F.round("g", 8).alias("g"))


@query("window_census", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 7 < 6 THEN CAST(n_nationkey % 5 + 1 AS INT) END AS roots, CAST(n_nationkey % 5 + 2 + (n_nationkey % 7) // 6 AS INT) AS degree, CAST(n_nationkey % 3 AS INT) AS at_lower, CAST(n_nationkey % 2 AS INT) AS at_upper, CASE WHEN n_nationkey % 4 > 0 THEN '2:' || n_nationkey % 4 ELSE '' END AS at_poles, CASE WHEN n_nationkey % 7 = 6 THEN 'multiple_root' ELSE 'counted' END AS status FROM nation")
def window_census(spark, d):
    """Roots at 1/2, 3/2, ... in (0, 5), besides some at its ends, at the pole 2 and outside; 1/2 is a repeated one for some."""

    def count(k):
        roots = [Fraction(2 * j + 1, 2) for j in range(k % 5 + 1)] + [0] * (k % 3) + [5] * (k % 2) + [2] * (k % 4) + [-k - 1] + [Fraction(1, 2)] * (k % 7 // 6)
        p = [Fraction(1)]
        for r in roots:
            p = [(p[j - 1] if j else 0) - (r * p[j] if j < len(p) else 0) for j in range(len(p) + 1)]
        return certified.census(p, 0, 5, [1, 2, 3, 4, 7])

    return by_nation(spark, d, lambda k: count(int(k)), "struct<roots:int,degree:int,at_lower:int,at_upper:int,at_poles:string,status:string>")


@query("sector_gap", """WITH v AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 2 THEN 8 ELSE 1 END AS m, n_nationkey % 5 - 2 AS c FROM nation), e AS (SELECT *, least(m, 5 + c) AS a, least(greatest(m, 5 + c), 9.5) AS b, 5 - c AS o FROM v)
 SELECT id, CASE WHEN id % 11 = 10 THEN 'not_symmetric' WHEN id % 7 = 6 THEN 'even_ground' WHEN a = o THEN 'unordered' ELSE 'replayed' END AS status, CASE WHEN id % 11 < 10 AND id % 7 < 6 AND a <> o THEN CASE WHEN a < o THEN 'even' ELSE 'odd' END END AS parity,
 CASE WHEN id % 11 < 10 AND id % 7 < 6 AND a < o THEN CAST(least(b, o) - a - 0.5 AS DOUBLE) END AS gap FROM e""")
def sector_gap(spark, d):
    """Order five: even values m, 5 + c and 19/2, odd ones 5 - c and 17/2, in boxes of width 1/2; some claims are wrong, some matrices not symmetric."""

    def replay(k):
        m, c = (8 if k % 3 == 2 else 1), k % 5 - 2
        a = [[Fraction(0)] * 5 for _ in range(5)]
        for i, v in enumerate((9, 5, m, 5, 9)):
            a[i][i] = Fraction(v)
        a[0][4] = a[4][0] = Fraction(1, 2)
        a[1][3] = a[3][1] = Fraction(c)
        a[0][1] += k % 11 == 10
        first, second = sorted((m, 5 + c))
        box = lambda x: (Fraction(4 * x - 1, 4), Fraction(4 * x + 1, 4))
        return certified.sector_gap(a, box(first + (k % 7 == 6)), box(second), box(5 - c))

    out = by_nation(spark, d, lambda k: replay(int(k)), "struct<status:string,parity:string,gap:string>")
    return out.withColumn("gap", as_double(F.col("gap")))


# --- Numbers as text


@query("round_decimal", "SELECT o_orderkey AS id, floor(o_totalprice) AS down, ceil(o_totalprice) AS up, trunc(o_totalprice) AS zero FROM orders")
def round_decimal(spark, d):
    """To the whole part's digits, as decimal text, in three directions."""
    text = F.format_string("%.2f", "o_totalprice")
    digits = F.length(F.split(text, r"\.")[0])
    out = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), *[shown.round_to(text, digits, F.lit(m)).alias(n) for m, n in (("down", "down"), ("up", "up"), ("toward_zero", "zero"))])
    return out.select("id", *[F.col(n).cast("double").alias(n) for n in ("down", "up", "zero")])


@query("format_style", "SELECT o_orderkey AS id, printf('%.1f', ceil(round(o_totalprice * 100) / 10) / 10) AS fixed, floor(round(o_totalprice * 100) / 100 / power(10, length(CAST(floor(o_totalprice) AS BIGINT)::VARCHAR) - 3)) * power(10, length(CAST(floor(o_totalprice) AS BIGINT)::VARCHAR) - 3) AS scientific FROM orders")
def format_style(spark, d):
    text = F.format_string("%.2f", "o_totalprice")
    scientific = shown.style_to(text, F.lit("scientific"), F.lit(2), F.lit("down")).cast("double")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), shown.style_to(text, F.lit("fixed"), F.lit(1), F.lit("up")).alias("fixed"), scientific.alias("scientific"))


@query("display_short", "SELECT o_orderkey AS id, round_even(round(o_totalprice * 100) / 100, 0) AS shown FROM orders WHERE o_totalprice >= 100000")
def display_short(spark, d):
    """Six digits of numbers from 100,000 on are their whole part, rounded."""
    o = table(spark, d, "orders").filter("o_totalprice >= 100000")
    return o.select(F.col("o_orderkey").alias("id"), shown.short(F.format_string("%.2f", "o_totalprice")).cast("double").alias("shown"))


@query("decimal_sign", "SELECT CAST(sign(c_acctbal) AS INT) AS sign, count(*) AS n FROM customer GROUP BY 1")
def decimal_sign(spark, d):
    return table(spark, d, "customer").groupBy(shown.sign(F.format_string("%.2f", "c_acctbal")).alias("sign")).agg(F.count("*").alias("n"))


@query("lossless_decimal", "SELECT event_id AS id, value / 3 AS back FROM events")
def lossless_decimal(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), shown.lossless(F.col("value") / 3).cast("double").alias("back"))


@query("portable_float", "SELECT event_id AS id, value / 3 AS back, 53 AS bits FROM events")
def portable_float(spark, d):
    out = table(spark, d, "events").select(F.col("event_id").alias("id"), shown.portable(F.col("value") / 3).alias("p"))
    return out.select("id", shown.from_portable("p.significand", "p.exponent").alias("back"), F.col("p.bits").alias("bits"))


@query("log_units", "SELECT c_custkey AS id, CASE WHEN c_acctbal > 0 THEN round(CASE WHEN c_nationkey % 2 = 0 THEN c_acctbal / 1000 ELSE c_acctbal / 1000 * ln(10) END, 9) END AS ln FROM customer")
def log_units(spark, d):
    unit = F.when(F.col("c_nationkey") % 2 == 0, "ln").otherwise("log10")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.round(shown.log_units(F.col("c_acctbal") / 1000, unit, F.signum("c_acctbal")), 9).alias("ln"))


@query("scaled_correction", "SELECT c_custkey AS id, CASE WHEN abs(c_nationkey - 5) > 1 THEN round(least((c_acctbal - 1) / (c_nationkey - 6), (c_acctbal - 1) / (c_nationkey - 4), (c_acctbal + 1) / (c_nationkey - 6), (c_acctbal + 1) / (c_nationkey - 4)), 6) END AS lo, CASE WHEN abs(c_nationkey - 5) > 1 THEN round(greatest((c_acctbal - 1) / (c_nationkey - 6), (c_acctbal - 1) / (c_nationkey - 4), (c_acctbal + 1) / (c_nationkey - 6), (c_acctbal + 1) / (c_nationkey - 4)), 6) END AS hi FROM customer")
def scaled_correction(spark, d):
    """[x, x + 2] less 1, over a scale of width two: nothing where the scale may be zero."""
    x, n = F.col("c_acctbal"), F.col("c_nationkey").cast("double")
    r = shown.scaled_correction(x, x + 2, F.lit(1.0), n - 6, n - 4)
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), r.alias("r")).select("id", F.round("r.lo", 6).alias("lo"), F.round("r.hi", 6).alias("hi"))


@query("canonical_json_digest", """SELECT p_partkey AS id, sha256('{"brand":"' || p_brand || '","key":' || p_partkey || ',"size":' || p_size || '}') AS digest FROM part""")
def canonical_json_digest(spark, d):
    p = {"size": F.col("p_size"), "key": F.col("p_partkey"), "brand": F.col("p_brand")}
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), shown.canonical_digest(p).alias("digest"))


@query("finite_json", """SELECT c_custkey AS id, CASE WHEN c_nationkey % 5 > 0 THEN '{"key":' || c_custkey || ',"n":' || c_nationkey || '}' END AS json FROM customer""")
def finite_json(spark, d):
    """A row with a number that is none has no JSON."""
    n = F.col("c_nationkey")
    value = F.when(n % 5 > 0, F.col("c_acctbal")).otherwise(F.lit(float("nan")))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), shown.finite_json(F.struct(F.col("c_custkey").alias("key"), n.alias("n")), value).alias("json"))


@query("release_order", "SELECT p_partkey AS id, row_number() OVER (ORDER BY p_size % 3, p_size % 5, p_size % 2, p_partkey % 4 = 0, CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 11 END, p_partkey) AS place, p_partkey % 9 = 0 AS refused FROM part")
def release_order(spark, d):
    """Releases as text, parsed and ordered; 1.2.3-rc.4 comes before 1.2.3, and rc.10 after rc.9."""
    from ..operators.ranks import dense_position

    p = table(spark, d, "part")
    core = F.concat_ws(".", *[(F.col("p_size") % m).cast("string") for m in (3, 5, 2)])
    pre = F.when(F.col("p_partkey") % 4 > 0, F.concat(F.lit("-rc."), (F.col("p_partkey") % 11).cast("string"))).otherwise("")
    v = shown.release(F.concat(core, pre))
    rows = p.select(F.col("p_partkey").alias("id"), v.alias("v")).select("id", "v.major", "v.minor", "v.patch", "v.final", "v.pre")
    bad = shown.release(F.concat(core, F.when(F.col("id") % 9 == 0, F.lit("-")).otherwise(F.lit(""))))
    placed = dense_position(rows, "major", "minor", "patch", "final", "pre", "id").select("id", (F.col("position") + 1).alias("place"))
    return placed.join(p.select(F.col("p_partkey").alias("id"), "p_size").select("id", bad.isNull().alias("refused")), "id")


@query("repository_digest", "SELECT s_suppkey AS id, sha256('https://host/' || lower(replace(s_name, '#', '-'))) AS digest FROM supplier")
def repository_digest(spark, d):
    """Names that differ in case, blanks or a final .git are one repository."""
    own = F.concat(F.lit(" HTTPS://host/"), F.replace(F.col("s_name"), F.lit("#"), F.lit("-")), F.when(F.col("s_suppkey") % 2 == 0, ".git").otherwise("/"))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), shown.repository_digest(own).alias("digest"))


@query("filename_decode", "SELECT DISTINCT l_discount AS value, l_discount AS back FROM lineitem")
def filename_decode(spark, d):
    from ..functions.text import filename_number

    return table(spark, d, "lineitem").select(F.col("l_discount").alias("value"), shown.filename_value(filename_number(F.col("l_discount"))).alias("back")).distinct()


@query("seed_authorization", "SELECT CASE WHEN p_size % 2 = 0 THEN p_partkey % 3 > 0 AND p_partkey % 5 > 0 ELSE p_partkey % 3 = 0 END AS allowed, count(*) AS n FROM part GROUP BY 1")
def seed_authorization(spark, d):
    k = F.col("p_partkey")
    ok = shown.seed_allowed(F.when(F.col("p_size") % 2 == 0, "random").otherwise("fixed"), F.when(k % 3 > 0, k), k % 5 > 0)
    return table(spark, d, "part").groupBy(ok.alias("allowed")).agg(F.count("*").alias("n"))
