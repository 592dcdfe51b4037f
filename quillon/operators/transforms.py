"""Integral transforms by quadrature: a fixed rule of nodes meets any number of points, whose sums are aggregated."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.analytic import screw_smooth_at
from ..functions.numbers import omega
from .generators import gauss_legendre, prime_powers


def truncated(points: DataFrame, key: str, sigma: str, tau: str, limit: float, nodes: int = 64) -> DataFrame:
    """(key, re, im) of the integral of u^(s-1) omega(u) over [1/limit, limit] for s = sigma + i tau."""
    rule = gauss_legendre(points.sparkSession, nodes, 1 / limit, limit)
    return _summed(points, key, sigma, tau, rule.withColumn("f", F.col("weight") * omega(F.col("x"))))


def weighted(points: DataFrame, key: str, sigma: str, tau: str, limit: float, series: list[float], nodes: int = 64) -> DataFrame:
    """The same with the factor xi_0 + 2 sum of xi_j cos(pi j ln u / ln limit) under the integral; an even series from j = 0 on."""
    rule = gauss_legendre(points.sparkSession, nodes, 1 / limit, limit)
    at = F.pi() * F.log("x") / F.log(F.lit(limit))
    factor = sum((2.0 * c * F.cos(F.lit(float(j)) * at) for j, c in enumerate(series) if j), F.lit(float(series[0])))
    return _summed(points, key, sigma, tau, rule.withColumn("f", F.col("weight") * omega(F.col("x")) * factor))


def _summed(points: DataFrame, key: str, sigma: str, tau: str, rule: DataFrame) -> DataFrame:
    """Each point's sums stay in its row: the rule is one small array."""
    rows = rule.agg(F.array_sort(F.collect_list(F.struct("x", "f"))).alias("rule"))
    both = points.select(key, F.col(sigma).alias("s"), F.col(tau).alias("t")).crossJoin(F.broadcast(rows))  # one row of as many nodes as the rule has
    size = lambda x: x["f"] * F.exp((F.col("s") - 1) * F.log(x["x"]))
    total = lambda part: F.aggregate("rule", F.lit(0.0), lambda a, x: a + size(x) * part(F.col("t") * F.log(x["x"])))
    return both.select(key, total(F.cos).alias("re"), total(F.sin).alias("im"))


def screw(points: DataFrame, key: str, t: str, support: float, digits: int = 20) -> DataFrame:
    """(key, g) of the screw function, even in t: its smooth part and the sum of ln p / sqrt n (|t| - ln n) over prime powers n = p^j <= e^|t|.

    Prime powers are dealt out by the whole part of ln n. A point takes the sums of the bins before its own, a row for each
    unit of the support, and meets only the powers of its own bin. Points that are null, not finite or beyond the support give null.
    """
    spark = points.sparkSession
    size = F.abs(F.col(t).cast("double"))
    log = F.log(F.col("n").cast("double"))
    powers = prime_powers(spark, math.ceil(math.exp(support))).select(log.alias("ln"), (F.log(F.col("p").cast("double")) / F.sqrt(F.col("n").cast("double"))).alias("w"))
    powers = powers.withColumn("bin", F.floor("ln"))
    bins = spark.range(math.floor(support) + 1).withColumnRenamed("id", "bin").join(powers.groupBy("bin").agg(F.sum("w").alias("s"), F.sum(F.col("w") * F.col("ln")).alias("m")), "bin", "left")
    before = W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)  # over units of the support
    bins = bins.select("bin", F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias("s"), F.coalesce(F.sum("m").over(before), F.lit(0.0)).alias("m"))
    asked = points.select(size.alias("a")).filter(F.col("a") <= support).distinct().withColumn("bin", F.floor("a"))
    own = asked.join(powers, "bin").filter("ln <= a").groupBy("a").agg(F.sum(F.col("w") * (F.col("a") - F.col("ln"))).alias("own"))
    smooth = screw_smooth_at(F.col("a"), F.lit(digits)).cast("double")
    value = smooth + F.col("a") * F.col("s") - F.col("m") + F.coalesce("own", F.lit(0.0))
    found = asked.join(bins, "bin").join(own, "a", "left").select(F.col("a").alias("__a"), value.alias("g"))
    return points.select(key, size.alias("__a")).join(found, "__a", "left").select(key, "g")


def crossings(df: DataFrame, by: list[str], f, lo: float, hi: float, steps: int, halvings: int = 50) -> DataFrame:
    """(by, root) of sign changes of f on a uniform scan of [lo, hi], refined by halving; f maps a column to a column over df's own.

    Every row scans by itself, with zeros of f on the grid taken as they are.
    """
    from ..functions.numbers import bisect

    grid = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda k: F.lit(lo) + k * ((hi - lo) / steps))
    cells = df.withColumn("__x", F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda k: F.struct(F.element_at(grid, k + 1).alias("a"), F.element_at(grid, k + 2).alias("b")))))
    a, b = F.col("__x.a"), F.col("__x.b")
    hit = cells.withColumns({"__fa": F.signum(f(a)), "__fb": F.signum(f(b))}).filter("__fa = 0 OR __fa * __fb < 0")
    return hit.select(*by, F.when(F.col("__fa") == 0, a).otherwise(bisect(f, a, b, halvings)).alias("root"))
