"""Ordered analytics: ladders, reconciliation, crossings, runs, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .budget import batches


def stabilization(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Changes between neighbours and ratios of changes; no ratio to a change of zero."""
    w = W.partitionBy(*by).orderBy(order)
    out = df.withColumn("change", F.col(value) - F.lag(value).over(w))
    before = F.lag("change").over(w)
    return out.withColumn("ratio", F.when(before != 0, F.col("change") / before))


def interval_stabilization(df: DataFrame, by: list[str], order: str, lo: str, hi: str) -> DataFrame:
    """Enclosures of changes, and of their ratios unless the denominator contains zero."""
    w = W.partitionBy(*by).orderBy(order)
    out = df.withColumns({"change_lo": F.col(lo) - F.lag(hi).over(w), "change_hi": F.col(hi) - F.lag(lo).over(w)})
    a, b = F.lag("change_lo").over(w), F.lag("change_hi").over(w)
    out = out.withColumns({"before_lo": a, "before_hi": b})
    ends = [F.col(x) / F.col(y) for x in ("change_lo", "change_hi") for y in ("before_lo", "before_hi")]
    clear = (F.col("before_lo") > 0) | (F.col("before_hi") < 0)
    return out.withColumns({"ratio_lo": F.when(clear, F.least(*ends)), "ratio_hi": F.when(clear, F.greatest(*ends))}).drop("before_lo", "before_hi")


def reconcile(df: DataFrame, by: list[str], value: str, index: str, tolerance: float, radius: str | None = None) -> DataFrame:
    """Rows in order of value with flags: duplicate (within the tolerance of, or overlapping, the row before), and,
    among the others, crossover (index does not grow) and skipped (indices left out before this one).
    """
    w = W.partitionBy(*by).orderBy(value, index)
    near = F.col(value) - F.lag(value).over(w) <= tolerance
    if radius:
        near = near | (F.lag(F.col(value) + F.col(radius)).over(w) >= F.col(value) - F.col(radius))
    out = df.withColumn("duplicate", F.coalesce(near, F.lit(False)))
    before = F.last(F.when(~F.col("duplicate"), F.col(index)), True).over(w.rowsBetween(W.unboundedPreceding, -1))
    out = out.withColumn("__before", before)
    lives = ~F.col("duplicate")
    return out.withColumns({
        "crossover": F.coalesce(lives & (F.col(index) <= F.col("__before")), F.lit(False)),
        "skipped": F.coalesce(F.when(lives, F.greatest(F.col(index) - F.col("__before") - 1, F.lit(0))), F.lit(0)).cast("long"),
    }).drop("__before")


def first_starved(df: DataFrame, by: list[str], order: str, a: str, b: str, ceiling: float) -> DataFrame:
    """First place in each ladder where the lesser of two measures falls under the ceiling; whether the order is strict."""
    w = W.partitionBy(*by).orderBy(order)
    flagged = df.withColumns({"__tied": F.coalesce(F.col(order) <= F.lag(order).over(w), F.lit(False))})
    low = F.least(a, b) < ceiling
    return flagged.groupBy(*by).agg(F.min(F.when(low, F.col(order))).alias("first_starved"), (~F.bool_or("__tied")).alias("strict"))


def sweep(df: DataFrame, by: list[str], bits: str, digits: str, wanted: float) -> DataFrame:
    """Per series: least and greatest gain in digits a bit, and whether the last value has the wanted digits."""
    w = W.partitionBy(*by).orderBy(bits)
    slope = F.try_divide(F.col(digits) - F.lag(digits).over(w), F.col(bits) - F.lag(bits).over(w))
    return df.withColumn("slope", slope).groupBy(*by).agg(
        F.min("slope").alias("least_slope"), F.max("slope").alias("most_slope"), (F.max_by(digits, bits) >= wanted).alias("confirmed")
    )


def refinement(df: DataFrame, by: list[str], order: str, value: str, tolerance: float, run: int = 2) -> DataFrame:
    """Relative changes along an axis and the length of the run of changes within the tolerance; a larger change resets it."""
    w = W.partitionBy(*by).orderBy(order)
    now, before = F.col(value), F.lag(value).over(w)
    out = df.withColumn("relative", F.when(now != 0, F.abs(now - before) / F.abs(now)))
    out = out.withColumn("__pass", F.coalesce(F.col("relative") <= tolerance, F.lit(False)).cast("int"))
    out = out.withColumn("__island", F.sum(1 - F.col("__pass")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = W.partitionBy(*by, "__island").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    out = out.withColumn("run", F.sum("__pass").over(runs).cast("long"))
    return out.withColumn("stabilized", F.col("run") >= run).drop("__pass", "__island")


def sign_crossings(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Brackets between a row and the last row of the other sign; zeros are passed over."""
    w = W.partitionBy(*by).orderBy(order)
    sign = F.signum(F.col(value))
    signed = df.withColumn("__s", F.when(sign != 0, sign))
    until = w.rowsBetween(W.unboundedPreceding, -1)
    signed = signed.withColumns({"__last": F.last("__s", True).over(until), "lower": F.last(F.when(F.col("__s").isNotNull(), F.col(order)), True).over(until)})
    return signed.filter("__s <> __last").withColumnRenamed(order, "upper").drop("__s", "__last")


def node_count(df: DataFrame, by: list[str], order: str, value: str, floor: float = 1e-6) -> DataFrame:
    """Sign changes of each series, without samples below the floor's share of its largest."""
    top = df.withColumn("__top", F.max(F.abs(value)).over(W.partitionBy(*by)))
    kept = top.filter((F.abs(value) >= floor * F.col("__top")) & (F.col(value) != 0))
    w = W.partitionBy(*by).orderBy(order)
    turned = F.coalesce(F.signum(F.col(value)) != F.lag(F.signum(F.col(value))).over(w), F.lit(False))
    return kept.withColumn("__t", turned.cast("long")).groupBy(*by).agg(F.sum("__t").alias("nodes"))


def parity(df: DataFrame, by: list[str], index: str, value: str, tolerance: float) -> DataFrame:
    """even, odd or none: each series against its mirror image; indices run from 0."""
    sized = df.withColumn("__n", F.count("*").over(W.partitionBy(*by)))
    mirror = sized.select(*by, (F.col("__n") - 1 - F.col(index)).alias(index), F.col(value).alias("__m"))
    both = df.join(mirror, [*by, index])
    even, odd = F.max(F.abs(F.col(value) - F.col("__m"))), F.max(F.abs(F.col(value) + F.col("__m")))
    return both.groupBy(*by).agg(F.when(even <= tolerance, "even").when(odd <= tolerance, "odd").otherwise("none").alias("parity"))


def interpolate(grid: DataFrame, points: DataFrame, by: list[str], x: str, y: str, step: float) -> DataFrame:
    """Linear interpolation on a uniform grid that starts at 0: an equi-join on the cell, no range join."""
    w = W.partitionBy(*by).orderBy(x)
    cells = grid.withColumns({"__y1": F.lead(y).over(w), "__cell": F.round(F.col(x) / step).cast("long")}).drop(x)
    at = points.withColumn("__cell", F.floor(F.col(x) / step).cast("long"))
    return at.join(cells, [*by, "__cell"]).withColumn("value", F.col(y) + (F.col("__y1") - F.col(y)) * (F.col(x) / step - F.col("__cell"))).drop("__cell", "__y1", y)


def greedy_batches(df: DataFrame, by: str | list[str], order: str, size: str, cap: int) -> DataFrame:
    """Rows of a series in order with the batch they fall in, from 0; a batch ends where the next row would take it over the cap."""
    return batches(df, [by] if isinstance(by, str) else by, [order], size, cap)


def monotone(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Per series: whether the value grows strictly, and the first place where it does not."""
    w = W.partitionBy(*by).orderBy(order)
    fails = df.withColumn("__bad", F.col(value) <= F.lag(value).over(w))
    return fails.groupBy(*by).agg((~F.bool_or(F.coalesce("__bad", F.lit(False)))).alias("strictly_increasing"), F.min(F.when(F.col("__bad"), F.col(order))).alias("first_failure"))


def adjacent_overlap(df: DataFrame, by: list[str], lo: str, hi: str) -> DataFrame:
    """Intervals in order with whether each overlaps the one before it."""
    w = W.partitionBy(*by).orderBy(lo, hi)
    return df.withColumn("overlaps", F.coalesce(F.lag(hi).over(w) >= F.col(lo), F.lit(False)))


def contiguous(df: DataFrame, by: list[str], start: str, end: str) -> Column:
    """Whether a partition follows the one before it without gap or overlap."""
    return F.coalesce(F.lag(end).over(W.partitionBy(*by).orderBy(start)) == F.col(start), F.lit(True))


def exact_crossings(df: DataFrame, by: list[str], order: str, text: str) -> DataFrame:
    """sign_crossings of decimal text of any length: signs are read from the text, never from a double."""
    from ..functions.shown import sign

    return sign_crossings(df.withColumn("__sign", sign(text).cast("double")), by, order, "__sign")
