"""Sums of doubles that are exact and rounded once, whatever the order or partitioning: a superaccumulator as native aggregates.

A double is a whole multiple of 2**-1074, so its bits are up to three digits of ``WIDTH`` bits in base 2**WIDTH, each split off
by exact column arithmetic (divide by a power of two, cut, subtract). Digits of one place are added as whole numbers, map
side first, in any order; only then are a group's places, at most 82, carried over and rounded to the nearest double, ties to even. A product
is split into its rounded value and its error, which are both doubles, so sums of products are exact too.

Defined cases: nulls are left out; a group of nulls alone, or none, is null; a group with a NaN, or with infinities of both signs, is NaN, with one
infinity that infinity; a sum beyond the doubles is an infinity; a zero sum is +0. Products are exact while both factors lie under 2**996 and their
error over 2**-1074. More than 2**37 rows a group raise an overflow instead of a wrong sum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH, LOWEST, PLACES = 26, -1074, 80


#: What a digit of each place stands for.
_UNITS = [math.ldexp(1.0, k * WIDTH + LOWEST) if k * WIDTH + LOWEST < 1024 else math.inf for k in range(PLACES + 3)]
#: Places of what is no finite number but counts: NaN, the infinities, null.
NAN, PLUS, UNDER, NOTHING = -1, -2, -3, -4


def _unit(place: Column) -> Column:
    return F.get(F.array(*map(F.lit, _UNITS)), place)


def placed_digits(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """(by, place, digit) of the sums of a group's digits; a null, a NaN or an infinity marks its group at a place of its own.

    Values are added up by the place of their first digit, in three columns, map side first; only what comes out of that is spread over the places.
    """
    v = F.col(x)
    mark = F.when(v.isNull(), NOTHING).when(F.isnan(v), NAN).when(v == float("inf"), PLUS).when(v == float("-inf"), UNDER)
    guess = F.greatest(F.lit(0), F.least(F.lit(PLACES), F.floor((F.log2(F.abs(v)) - LOWEST) / WIDTH))).cast("int")
    rows = df.select(*by, v.alias("__v"), F.when(v == 0, 0).when(mark.isNull(), guess).alias("__top"), mark.alias("__mark"))
    size, top = F.abs("__v"), F.col("__top")
    moved = F.when(size < _unit(top), -1).when(size >= _unit(top + 1), 1).otherwise(0)
    # A zero stays at place 0 with digits 0.
    rows = rows.withColumn("__top", F.coalesce("__mark", F.greatest(F.lit(0), top + moved))).withColumn("__rest", F.when(F.col("__mark").isNull(), F.col("__v")))
    for k in range(3):
        at = F.greatest(top - k, F.lit(0))
        digit = F.when(F.col("__mark").isNull() & (top >= k), (F.col("__rest") / _unit(at)).cast("long")).otherwise(F.lit(0).cast("long"))
        rows = rows.withColumn(f"__d{k}", digit).withColumn("__rest", F.col("__rest") - F.col(f"__d{k}").cast("double") * _unit(at))
    sums = rows.groupBy(*by, "__top").agg(*[F.sum(f"__d{k}").alias(f"__d{k}") for k in range(3)])
    spread = F.explode(F.array(*[F.struct((top - k).alias("place"), F.col(f"__d{k}").alias("digit"), F.lit(k).alias("k")) for k in range(3)])).alias("__d")
    spread = sums.select(*by, top.alias("__top"), spread).filter("__d.k = 0 OR (__d.digit <> 0 AND __top >= __d.k)")
    return spread.groupBy(*by, F.col("__d.place").alias("place")).agg(F.sum("__d.digit").alias("digit"))


#: Rounds ``sums``, a map from place to whole number, to the nearest double.
_CARRIED = f"""aggregate(sequence(least, most + 2), named_struct('carry', 0L, 'digits', cast(array() AS array<bigint>)),
 (a, k) -> named_struct('carry', shiftright(a.carry + coalesce(try_element_at(sums, k), 0L) * sign, {WIDTH}),
  'digits', array_append(a.digits, (a.carry + coalesce(try_element_at(sums, k), 0L) * sign) & {(1 << WIDTH) - 1}L)))"""


def rounded(df: DataFrame, out: str) -> DataFrame:
    """``df`` with its column sums (a map of places, or null) as one double ``out``."""
    df = df.withColumns({"least": F.array_min(F.map_keys("sums")), "most": F.array_max(F.map_keys("sums")), "sign": F.lit(1).cast("long")})
    df = df.withColumn("minus", F.expr(f"({_CARRIED}).carry < 0")).withColumn("sign", F.expr("CASE WHEN minus THEN -1L ELSE 1L END"))
    df = df.withColumn("digits", F.reverse(F.expr(f"({_CARRIED}).digits")))
    # Leading zeros go; four digits hold all bits of the result and of its half, the others only say if there is more.
    df = df.withColumn("skip", F.expr("aggregate(digits, named_struct('n', 0, 'on', true), (a, x) -> named_struct('n', a.n + int(a.on AND x = 0), 'on', a.on AND x = 0), a -> a.n)"))
    digit = lambda k: F.coalesce(F.get("digits", F.col("skip") + k), F.lit(0).cast("long"))
    df = df.withColumns({"hi": digit(0) * (1 << WIDTH) + digit(1), "lo": digit(2) * (1 << WIDTH) + digit(3)})
    df = df.withColumn("more", F.expr("exists(slice(digits, skip + 5, size(digits)), x -> x <> 0)"))
    df = df.withColumn("bits", F.length(F.bin("hi")))
    df = df.withColumns({
        "whole": F.expr("shiftleft(hi, 53 - bits) | shiftright(lo, bits - 1)"), "rest": F.expr("lo & (shiftleft(1L, bits - 1) - 1)"), "half": F.expr("shiftleft(1L, bits - 2)"),
    })
    up = F.expr("rest > half OR (rest = half AND (more OR whole % 2 = 1))")
    exponent = (F.col("most") + 2 - F.col("skip") - 3) * WIDTH + LOWEST + F.col("bits") - 1
    whole = (F.col("whole") + F.when(up, 1).otherwise(0)).cast("double") * F.col("sign")
    # Far down, by way of a power that is still there: what is that small is a whole multiple of the least double.
    value = F.when(exponent < -900, whole * F.pow(F.lit(2.0), exponent + 128) * F.pow(F.lit(2.0), F.lit(-128))).otherwise(whole * F.pow(F.lit(2.0), exponent))
    value = F.when(F.col("skip") == F.size("digits"), 0.0).otherwise(value)
    return df.withColumn(out, value).drop("sums", "least", "most", "sign", "minus", "digits", "skip", "hi", "lo", "more", "bits", "whole", "rest", "half")


def exact_sums(df: DataFrame, by: list[str], **values: list[Column] | Column) -> DataFrame:
    """(by, one double a name): for each name the sum of its column, or of all of its list of columns, over a group."""
    lists = {n: c if isinstance(c, list) else [c] for n, c in values.items()}
    flat = [(n, c.cast("double")) for n, cs in lists.items() for c in cs]
    group = F.struct(*by).alias("by") if by else F.struct(F.lit(0).alias("_")).alias("by")
    rows = df.select(group, F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c.alias("v")) for n, c in flat])).alias("d")).select("by", "d.*")
    marked = lambda place: F.bool_or(F.col("place") == place)
    sums = placed_digits(rows, ["by", "name"], "v").groupBy("by", "name").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("place") >= 0, F.struct("place", "digit")))).alias("sums"), marked(NAN).alias("nan"), marked(PLUS).alias("plus"), marked(UNDER).alias("under"),
    )
    out = rounded(sums.withColumn("sums", F.when(F.size("sums") > 0, F.col("sums"))), "value")
    special = F.when(F.col("nan") | (F.col("plus") & F.col("under")), float("nan")).when(F.col("plus"), float("inf")).when(F.col("under"), float("-inf"))
    out = out.select("by", "name", F.coalesce(special, "value").alias("value"))
    # Groups of nulls alone are there by their marks; all rows of an empty table are one group of none.
    wide = out.groupBy("by").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in lists]).select(*([F.col("by")[c].alias(c) for c in by]), *lists)
    return wide if by else df.sparkSession.range(1).select().join(wide, F.lit(True), "left")


def product(a: Column, b: Column) -> list[Column]:
    """Two doubles whose exact sum is a * b: the rounded product and its error."""

    def split(x: Column) -> tuple[Column, Column]:
        far = x * 134_217_729.0
        high = far - (far - x)
        return high, x - high

    (ah, al), (bh, bl), p = split(a), split(b), a * b
    return [p, ((ah * bh - p) + ah * bl + al * bh) + al * bl]


def exact_dots(df: DataFrame, by: list[str], **pairs: tuple[Column, Column]) -> DataFrame:
    """(by, one double a name): exact sums of products, rounded once."""
    flat = {f"{n}{k}": c.cast("double").alias(f"{n}{k}") for n, pair in pairs.items() for k, c in enumerate(pair)}
    rows = df.select(*by, *flat.values())
    return exact_sums(rows, by, **{n: product(F.col(f"{n}0"), F.col(f"{n}1")) for n in pairs})


def interval_contraction(df: DataFrame, by: list[str], lo: str, hi: str, least: Column, most: Column) -> DataFrame:
    """(by, lo, hi): exact sums of the ends of [lo, hi] times the weights [least, most], which are 0 or more."""
    low, high = F.when(F.col(lo) >= 0, least).otherwise(most), F.when(F.col(hi) >= 0, most).otherwise(least)
    return exact_dots(df, by, lo=(F.col(lo), low), hi=(F.col(hi), high))
