"""Generators: primes, prime powers, grids, quadrature, partitions, multi-indices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def primes(spark: SparkSession, bound: int) -> DataFrame:
    """Primes up to the bound by a segmented sieve: each task sieves its own segments with the small primes."""

    def small(n: int) -> np.ndarray:
        flags = np.ones(n + 1, bool)
        flags[:2] = False
        for p in range(2, int(n**0.5) + 1):
            if flags[p]:
                flags[p * p :: p] = False
        return np.flatnonzero(flags)

    def run(batches):
        import pyarrow as pa

        base = small(int(bound**0.5) + 1)
        for b in batches:
            for k in b.column(0).to_pylist():
                lo, hi = k * SEGMENT, min(bound + 1, (k + 1) * SEGMENT)
                flags = np.ones(max(0, hi - lo), bool)
                for p in base.tolist():
                    flags[max(p * p, -(-lo // p) * p) - lo :: p] = False
                if lo == 0:
                    flags[:2] = False
                yield pa.RecordBatch.from_arrays([pa.array(lo + np.flatnonzero(flags), pa.int64())], names=["p"])

    return spark.range(bound // SEGMENT + 1).mapInArrow(run, "p long")


#: Numbers in a segment of the sieve.
SEGMENT = 1 << 20


def prime_powers(spark: SparkSession, bound: int) -> DataFrame:
    """(n, p, j) with n = p^j up to the bound."""
    powers = F.transform(F.sequence(F.lit(1), F.lit(max(1, bound.bit_length()))), lambda j: F.struct(F.round(F.pow(F.col("p").cast("double"), j)).alias("n"), j.alias("j")))
    return (
        primes(spark, bound).select("p", F.explode(F.filter(powers, lambda x: x["n"] <= bound)).alias("x"))
        .select(F.col("x.n").cast("long").alias("n"), "p", F.col("x.j").alias("j"))
    )


def grid(spark: SparkSession, a: float, b: float, steps: int, scheme: str = "trapezoid") -> DataFrame:
    """(x, weight) of a uniform rule; the end points are exact."""
    h = (b - a) / steps
    at = {"left": 0.0, "right": 1.0, "midpoint": 0.5}.get(scheme)
    if at is not None:
        x = F.col("id") + at
        n = steps
        w = F.lit(h)
    else:
        x, n = F.col("id").cast("double"), steps + 1
        w = F.when(F.col("id").isin(0, steps), h / 2).otherwise(h)
    place = F.when(x == steps, F.lit(b)).otherwise(a + x * h)
    return spark.range(n).select(place.alias("x"), w.cast("double").alias("weight"))


def gauss_legendre(spark: SparkSession, n: int, a: float, b: float) -> DataFrame:
    """(x, weight) of the n-point rule on [a, b]; n rows, made on the driver."""
    x, w = np.polynomial.legendre.leggauss(n)
    rows = F.array(*[F.struct(F.lit(float((b - a) / 2 * u + (a + b) / 2)).alias("x"), F.lit(float((b - a) / 2 * v)).alias("weight")) for u, v in zip(x, w, strict=True)])
    return spark.range(1).select(F.inline(rows))


def partitions(spark: SparkSession, parts: int, degree: int) -> DataFrame:
    """Descending arrays of at most ``parts`` positive numbers with a sum of at most ``degree``, by recursion."""
    return spark.sql(f"""
        WITH RECURSIVE p(parts, total) AS (
          SELECT CAST(array() AS ARRAY<INT>), 0
          UNION ALL
          SELECT array_append(parts, k), total + k FROM (SELECT parts, total, explode(sequence(1, {degree})) AS k FROM p WHERE size(parts) < {parts})
          WHERE total + k <= {degree} AND (size(parts) = 0 OR k <= element_at(parts, -1)))
        SELECT parts, total AS degree FROM p""")


def multi_indices(spark: SparkSession, k: int, degree: int) -> DataFrame:
    """All vectors of k numbers from 0 with a sum of at most ``degree``."""
    out = spark.range(1).select(F.array().cast("array<int>").alias("index"), F.lit(0).alias("degree"))
    for _ in range(k):
        out = out.select("index", "degree", F.explode(F.sequence(F.lit(0), F.lit(degree))).alias("n")).filter(F.col("degree") + F.col("n") <= degree)
        out = out.select(F.array_append("index", F.col("n")).alias("index"), (F.col("degree") + F.col("n")).alias("degree"))
    return out


def log_grid(spark: SparkSession, a: float, b: float, steps: int, scheme: str = "trapezoid") -> DataFrame:
    """(x, weight) of a rule that is uniform in ln x; weights hold dx = x d ln x, and the end points are exact."""
    out = grid(spark, float(np.log(a)), float(np.log(b)), steps, scheme)
    place = F.when(F.col("x") == float(np.log(a)), F.lit(a)).when(F.col("x") == float(np.log(b)), F.lit(b)).otherwise(F.exp("x"))
    return out.select(place.alias("p"), "weight").select(F.col("p").alias("x"), (F.col("weight") * F.col("p")).alias("weight"))


def character_powers(spark: SparkSession, bound: int, q: int) -> DataFrame:
    """(n, p, j, chi) of prime powers with a real character's value."""
    from ..functions.numbers import character_at_power

    return prime_powers(spark, bound).withColumn("chi", character_at_power(q, F.col("p"), F.col("j")))


def orbit(partitions_: DataFrame, parts: str, k: int) -> DataFrame:
    """``partitions_`` with each distinct arrangement (column arrangement) of the parts and zeros in k places.

    Places are filled one at a time, each rest once, so no arrangement is made twice.
    """
    rest = F.concat(F.col(parts), F.array_repeat(F.lit(0), F.lit(k) - F.size(parts)))
    out = partitions_.filter(F.size(parts) <= k).withColumns({"__rest": F.array_sort(rest), "arrangement": F.array().cast("array<int>")})
    for _ in range(k):
        out = out.withColumn("__next", F.explode(F.array_distinct("__rest")))
        at = F.array_position("__rest", F.col("__next")).cast("int")
        out = out.withColumns({
            "arrangement": F.array_append("arrangement", F.col("__next")),
            "__rest": F.concat(F.slice("__rest", 1, at - 1), F.slice("__rest", at + 1, F.size("__rest"))),
        }).drop("__next")
    return out.drop("__rest")


def quadrature_orders(df: DataFrame, modes: str, base: int, bits: str, bucket: int) -> DataFrame:
    """A row for each mode 0..modes with its order: three a mode and half the bits, at least the base, rounded up to a bucket."""
    out = df.withColumn("mode", F.explode(F.sequence(F.lit(0).cast("long"), F.col(modes).cast("long"))))
    order = F.greatest(F.lit(base), 3 * F.col("mode") + F.floor(F.col(bits) / 2))
    return out.withColumn("order", (F.ceil(order / bucket) * bucket).cast("long"))


def basis_profile(points: DataFrame, u: str, coefficients: list[float], period: float = 1.0) -> DataFrame:
    """``points`` with f(u) = sum of c_j cos(2 pi j u / period), scaled so that f(1) = 1; null where that sum vanishes."""
    at = lambda x: sum((c * F.cos(2 * F.pi() * j * x / period) for j, c in enumerate(coefficients)), F.lit(0.0))
    one = at(F.lit(1.0))
    return points.withColumn("profile", F.when(F.abs(one) > 1e-300, at(F.col(u)) / one))


def dirichlet_plan(df: DataFrame, half_width: str, points: str, least: int = 3) -> DataFrame:
    """``df`` with the plan of a uniform grid that vanishes at both ends: step, scale of the second difference, and why it is refused."""
    bad = F.array_compact(F.array(F.when(~(F.col(half_width) > 0), F.lit("width")), F.when(F.col(points) < least, F.lit("points"))))
    step = 2 * F.col(half_width) / (F.col(points) + 1)
    ok = F.size("problems") == 0
    return df.withColumn("problems", bad).withColumns({"step": F.when(ok, step), "scale": F.when(ok, 1 / (step * step))})
