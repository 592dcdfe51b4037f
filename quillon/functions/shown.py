"""Numbers as text: directed rounding, styles, lossless and portable forms; exact, from decimal text or doubles."""

from __future__ import annotations

import math
from decimal import ROUND_CEILING, ROUND_DOWN, ROUND_FLOOR, ROUND_HALF_EVEN, ROUND_HALF_UP, ROUND_UP, Context, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .certified import rowwise
from .exact import canonical_text, parsed

#: Names of the roundings.
MODES = {"nearest_even": ROUND_HALF_EVEN, "nearest_away": ROUND_HALF_UP, "down": ROUND_FLOOR, "up": ROUND_CEILING, "toward_zero": ROUND_DOWN, "away_from_zero": ROUND_UP}


def rounded(text, digits, mode) -> str | None:
    """Decimal text to so many significant digits."""
    x = parsed(text)
    return None if x is None else canonical_text(str(Context(prec=int(digits), rounding=MODES[mode]).create_decimal(x)))


def styled(text, style, digits, mode) -> str | None:
    """fixed: so many digits after the point; scientific: one before it and so many after, with an exponent."""
    x = parsed(text)
    if x is None:
        return None
    if style == "fixed":
        return format(x.quantize(Decimal(1).scaleb(-int(digits)), MODES[mode], Context(prec=max(28, len(text) + int(digits)) + 20)), "f")
    y = Context(prec=int(digits) + 1, rounding=MODES[mode]).create_decimal(x)
    return format(y, f".{int(digits)}e")


round_to = rowwise(rounded, "string")
style_to = rowwise(styled, "string")
#: Six significant digits.
short = rowwise(lambda text: rounded(text, 6, "nearest_even"), "string")
#: -1, 0 or 1; null if it is no decimal.
sign = rowwise(lambda text: None if (x := parsed(text)) is None else (x > 0) - (x < 0), "int")
#: The shortest text that reads back as the same double.
lossless = rowwise(lambda v: None if v is None or not math.isfinite(v) else repr(float(v)), "string")


def _portable(v):
    if v is None or not math.isfinite(v):
        return None, None, None
    m, e = math.frexp(v)
    n = int(m * (1 << 53))
    while n and n % 2 == 0:
        n, e = n // 2, e + 1
    return 53, ("-" if n < 0 else "") + format(abs(n), "x"), (e - 53) if n else 0


#: A double as precision, hexadecimal significand and exponent of two.
portable = rowwise(_portable, "struct<bits:int,significand:string,exponent:int>")
#: And back.
from_portable = rowwise(lambda significand, exponent: None if significand is None else math.ldexp(int(significand, 16), int(exponent)), "double")


def log_units(x: Column, unit: Column, sign_: Column) -> Column:
    """A signed logarithm in natural units, from ``ln`` or ``log10``; null for other units or a sign that is not positive."""
    return F.when(sign_ > 0, F.when(unit == "ln", x).when(unit == "log10", x * math.log(10)))


def scaled_correction(lo: Column, hi: Column, leading: Column, scale_lo: Column, scale_hi: Column) -> Column:
    """Enclosure of (x - leading) / scale; null if the scale may be zero."""
    ends = [(x - leading) / s for x in (lo, hi) for s in (F.when(scale_lo != 0, scale_lo), F.when(scale_hi != 0, scale_hi))]
    return F.when((scale_lo > 0) | (scale_hi < 0), F.struct(F.least(*ends).alias("lo"), F.greatest(*ends).alias("hi")))


def finite_json(row: Column, *numbers: Column) -> Column:
    """JSON of a struct; null if one of its numbers is no finite one."""
    good = F.lit(True)
    for n in numbers:
        good = good & F.coalesce(~F.isnan(n) & (F.abs(n) < float("inf")), F.lit(True))
    return F.when(good, F.to_json(row))


def canonical_digest(fields: dict[str, Column]) -> Column:
    """SHA-256 of the JSON object of the fields, by name."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def repository_digest(name: Column) -> Column:
    """Identity of a repository by its canonical name: trimmed, lower case, without a final slash or .git."""
    return F.sha2(F.regexp_replace(F.lower(F.trim(name)), r"(\.git)?/*$", ""), 256)


def release(text: Column) -> Column:
    """A release number ``a.b.c`` or ``a.b.c-pre.n`` as a struct that orders like releases do: prereleases come first; null if it is none."""
    parts = F.regexp_extract_all(F.regexp_extract(text, r"^([0-9]+\.[0-9]+\.[0-9]+)(-|$)", 1), F.lit("([0-9]+)"))
    pre = F.regexp_extract(text, r"^[0-9]+\.[0-9]+\.[0-9]+-([0-9A-Za-z.-]+)$", 1)
    # Numbers order before words, and by size.
    fields = F.transform(F.split(pre, r"\."), lambda p: F.struct((~p.rlike("^[0-9]+$")).alias("word"), F.when(p.rlike("^[0-9]+$"), p.cast("long")).alias("number"), p.alias("text")))
    known = text.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+(-[0-9A-Za-z-]+(\.[0-9A-Za-z-]+)*)?$")
    return F.when(known, F.struct(
        parts[0].cast("long").alias("major"), parts[1].cast("long").alias("minor"), parts[2].cast("long").alias("patch"),
        (pre == "").alias("final"), F.when(pre != "", fields).alias("pre"),
    ))


def filename_value(name: Column) -> Column:
    """The number that a file name part stands for; null unless it is written as the encoder would."""
    return F.when(name.rlike("^(0|[1-9][0-9]*)(p[0-9]*[1-9])?$"), F.replace(name, F.lit("p"), F.lit(".")).cast("double"))


def seed_allowed(method: Column, seed: Column, opted_in: Column) -> Column:
    """Randomised methods need a seed and an explicit consent; others must not have one."""
    return F.when(method == "random", seed.isNotNull() & F.coalesce(opted_in, F.lit(False))).otherwise(seed.isNull())
