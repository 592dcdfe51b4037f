"""Text functions of sinks and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


_DIGITS = "[0-9]+"
#: Fixed value: decimal text is a sign or none, ASCII digits with a point after, before or among them or none, an exponent or none.
GRAMMAR = rf"[+-]?({_DIGITS}\.?|[0-9]*\.{_DIGITS})([eE][+-]?{_DIGITS})?"


def csv_cell(c: Column) -> Column:
    """Quoted if it holds a quote, comma or line break; quotes doubled."""
    return F.when(c.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def latex_cell(c: Column) -> Column:
    """Special characters escaped; the backslash first."""
    out = F.replace(c, F.lit("\\"), F.lit("\\textbackslash "))
    for ch in "&%$#_{}":
        out = F.replace(out, F.lit(ch), F.lit("\\" + ch))
    return out


def filename_number(c: Column) -> Column:
    """A decimal as a file name part: trailing zeros dropped, the point written p."""
    text = F.format_string("%.6f", c.cast("double"))
    return F.replace(F.regexp_replace(F.regexp_replace(text, "0+$", ""), "\\.$", ""), F.lit("."), F.lit("p"))
