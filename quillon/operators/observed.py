"""Ordered observations: deltas, schedules, complete windows, prime floors, inverse moments, nested prefixes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .generators import prime_powers


def deltas(df: DataFrame, by: list[str], order: str, value: str, good: Column) -> DataFrame:
    """Signed change to the row before and its share of that row's size, where both are good; no share of zero."""
    w = W.partitionBy(*by).orderBy(order)
    own = df.withColumn("__v", F.when(good, F.col(value)))
    before = F.lag("__v").over(w)
    return own.withColumns({"signed": F.col("__v") - before, "relative": F.when(before != 0, (F.col("__v") - before) / F.abs(before))}).drop("__v")


def scheduled(df: DataFrame, schedule: DataFrame, by: list[str], step: str, quadrature: str, value: str) -> DataFrame:
    """Changes along a ladder whose quadrature must be the one its schedule (step, wanted) names; a series with any other is refused whole."""
    both = df.join(schedule.select(step, F.col("wanted").alias("__wanted")), step, "left")
    fits = F.bool_and(F.col(quadrature).eqNullSafe(F.col("__wanted"))).over(W.partitionBy(*by))
    change = F.col(value) - F.lag(value).over(W.partitionBy(*by).orderBy(step))
    return both.withColumn("fits", fits).withColumn("change", F.when(F.col("fits"), change)).drop("__wanted")


def window_status(certificates: DataFrame, by: str, ordinal: str, lo: str, hi: str, verified: str, expected: DataFrame) -> DataFrame:
    """(by, status) of windows: complete, or the first of count, ordinals, order, overlap and verification that fails."""
    w = W.partitionBy(by).orderBy(ordinal)
    rows = certificates.withColumns({"__gap": F.col(ordinal) != F.row_number().over(w), "__order": F.lag(lo).over(w) >= F.col(lo), "__over": F.lag(hi).over(w) >= F.col(lo)})
    has = lambda c: F.bool_or(F.coalesce(F.col(c), F.lit(False)))
    per = rows.groupBy(by).agg(F.count("*").alias("n"), has("__gap").alias("gap"), has("__order").alias("bad"), has("__over").alias("over"), F.bool_and(F.coalesce(F.col(verified), F.lit(False))).alias("ok"))
    both = expected.select(by, F.col("count").alias("__want")).join(per, by, "left")
    status = (
        F.when(F.coalesce("n", F.lit(0)) != F.col("__want"), "count").when(F.col("gap"), "ordinals").when(F.col("bad"), "order").when(F.col("over"), "overlap")
        .when(~F.coalesce("ok", F.lit(True)), "unverified").otherwise("complete")
    )
    return both.select(by, status.alias("status"))


#: Numbers that share a cell of the counts of prime powers.
CELL = 1_000


def prime_floor(points: DataFrame, cutoff: str, most: int) -> DataFrame:
    """``points`` with whether the whole part of the cutoff is prime, how many prime powers it reaches and the largest of them.

    Counts before a cell are one row a cell; within it, its few powers are looked at: no point meets more than CELL of them.
    """
    pp = prime_powers(points.sparkSession, most).select("n", (F.col("j") == 1).alias("prime"))
    cells = pp.groupBy(F.floor(F.col("n") / CELL).alias("__cell")).agg(F.array_sort(F.collect_list(F.struct("n", "prime"))).alias("__own"), F.count("*").alias("__m"), F.max("n").alias("__top"))
    before = W.orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)  # over cells
    cells = cells.withColumns({"__base": F.coalesce(F.sum("__m").over(before), F.lit(0)), "__below": F.max("__top").over(before)}).drop("__m", "__top")
    floor = F.floor(F.col(cutoff)).cast("long")
    both = points.withColumn("__cell", F.floor(floor / CELL)).join(cells, "__cell", "left")
    reached = F.filter(F.coalesce("__own", F.array().cast("array<struct<n:bigint,prime:boolean>>")), lambda x: x["n"] <= floor)
    return both.withColumns({
        "cutoff_is_prime": (F.col(cutoff) == floor) & F.exists(reached, lambda x: (x["n"] == floor) & x["prime"]),
        "prime_powers": F.coalesce("__base", F.lit(0)) + F.size(reached), "largest": F.coalesce(F.array_max(F.transform(reached, lambda x: x["n"])), F.col("__below")),
    }).drop("__cell", "__own", "__base", "__below")


def floor_report(points: DataFrame, measured: str, smooth: str) -> DataFrame:
    """One row: the largest modulation of measured against smooth digits, and whether a cutoff that is no prime is among them."""
    return points.agg(F.max(F.abs(F.col(measured) - F.col(smooth))).alias("modulation"), F.bool_or(~F.col("cutoff_is_prime")).alias("has_nonprime"), F.count("*").alias("points"))


def inverse_moments(matrices: DataFrame, by: str = "matrix_id") -> DataFrame:
    """(matrix, dimension, t1, t2, t3) of traces of powers of each leading block's inverse; a block that is not positive definite ends its matrix."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        from .linalg import _dense

        a, rows = _dense(pdf), []
        for k in range(1, len(a) + 1):
            w = np.linalg.eigvalsh(a[:k, :k])
            if w[0] <= 0:
                break
            rows.append((key[0], k, (1 / w).sum(), (1 / w**2).sum(), (1 / w**3).sum()))
        return pd.DataFrame(rows, columns=[by, "dimension", "t1", "t2", "t3"])

    return matrices.groupBy(by).applyInPandas(run, f"{by} {matrices.schema[by].dataType.simpleString()}, dimension long, t1 double, t2 double, t3 double")


def two_modes(df: DataFrame) -> DataFrame:
    """``df`` (dimension, t1, t2, t3) with the two-mode fit: the pair m1 >= m2 of m1^2 + m2^2 = t2 and m1^3 + m2^3 = t3, as a status and 1/m1, 1/m2.

    With s = (m1 + m2) / sqrt(t2), s^3 - 3 s + 2 t3 / t2^1.5 = 0, whose root between 1 and sqrt 2 is a cosine. Nothing is clipped.
    """
    m = F.col("t3") / F.pow("t2", F.lit(1.5))
    s = 2 * F.cos(F.acos(-m) / 3)
    gap = 2 - s * s  # (m1 - m2)^2 / t2
    status = (
        F.when(F.col("dimension") == 1, "single_dimension").when(m.isNull() | F.isnan(m), "unresolved_arithmetic")
        .when((m > 1) | (m < 2**-0.5 - 1e-12), "outside_two_mode_range").when(gap <= 1e-12, "unresolved_separation").otherwise("resolved")
    )
    out = df.withColumn("status", status)
    ok = F.col("status") == "resolved"
    half, diff = F.sqrt("t2") * s / 2, F.sqrt(F.col("t2") * F.greatest(gap, F.lit(0.0))) / 2
    return out.withColumns({"lowest": F.when(ok, 1 / (half + diff)), "second": F.when(ok, F.try_divide(F.lit(1.0), half - diff)), "closure": F.when(ok, (F.col("t1") - 2 * half) / F.col("t1"))})


def nested(report: DataFrame, prior: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """(key, equal) of the dimensions that two reports share: all values the same, nulls included."""
    both = report.join(prior.select(*key, *[F.col(v).alias(f"__{v}") for v in values]), key)
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col(f"__{v}"))
    return both.select(*key, same.alias("equal"))


def ground_index(below_lo: Column, below_hi: Column) -> Column:
    """Whether a state is the lowest of its sector, from how many eigenvalues lie under either end of its enclosure: established, refuted or inconclusive."""
    return F.when(below_lo.isNull() | below_hi.isNull(), "inconclusive").when(below_lo > 0, "refuted").when(below_hi == 1, "established").otherwise("inconclusive")


def strip_bound(panels: DataFrame, by: str, left: str, right: str, error: str, height: float, tail: float) -> DataFrame:
    """(by, bound, problem): tail plus sum of error x width x exp(height x extent) over panels that must be a contiguous partition."""
    w = W.partitionBy(by).orderBy(left)
    bad = (F.col(left) >= F.col(right)) | (F.col(error) < 0) | F.coalesce(F.lag(right).over(w) != F.col(left), F.lit(False))
    term = F.when(F.col(error) == 0, 0.0).otherwise(F.col(error) * (F.col(right) - F.col(left)) * F.exp(height * F.greatest(F.abs(left), F.abs(right))))
    per = panels.withColumn("__bad", bad).groupBy(by).agg(F.bool_or("__bad").alias("bad"), F.sum(term).alias("total"))
    return per.select(by, F.when(~F.col("bad"), F.col("total") + tail).alias("bound"), F.when(F.col("bad"), "not_contiguous").alias("problem"))


def gap_bound(residual: Column, gap: Column) -> tuple[Column, Column]:
    """(bound on the sine of the angle, status) from a residual and a certified distance to the unwanted spectrum."""
    status = F.when((residual < 0) | (gap <= 0), "invalid").when(residual >= gap, "inconclusive").otherwise("reliable")
    return F.when((residual >= 0) & (gap > 0) & (residual < gap), residual / gap), status


def reduction_agreement(left: DataFrame, right: DataFrame, key: str, value: str, digest: str, tolerance: float) -> DataFrame:
    """(key, difference, agrees): by identity of bytes where both sides ran alike (column ``alike``), else by the tolerance."""
    both = left.join(right.select(key, F.col(value).alias("__v"), F.col(digest).alias("__d")), key)
    gap = F.abs(F.col(value) - F.col("__v"))
    return both.select(key, gap.alias("difference"), F.when(F.col("alike"), F.col(digest) == F.col("__d")).otherwise(gap <= tolerance).alias("agrees"))
