"""Quality rules: a threshold table compiled into one projection, native expressions only.

A text's words are ``[^\\x20\\x09-\\x0D]+``. All counts cover the whole text. Windows of eight words
are compared within their own row by 64-bit hashes, so nothing is shuffled.

Defined cases: a null or empty text has no words and fails the base rules (fewer than 20 words);
ratios of nothing are 0; repeated rows and null ids each keep a row; an empty table gives an empty
result; input columns with the result's names give way, all others are kept, whatever their names: the input travels as one
struct. Texts of any length are measured whole, within their row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words_of

#: Common function words of four languages.
STOP_WORDS = [
    "the", "be", "to", "of", "and", "that", "have", "with", "in", "is", "it", "for", "on", "was", "as", "by", "at", "from",
    "der", "die", "das", "und", "ein", "eine", "von", "den", "des", "mit", "ist", "zu", "auf", "im", "nicht",
    "le", "la", "les", "de", "et", "un", "une", "du", "que", "dans", "est", "pour", "par", "sur",
    "el", "los", "las", "y", "en", "por", "con", "una", "se", "del", "lo", "su",
]

#: (rule, measure, least, most): a row fails a rule if its measure lies outside. None: no bound.
THRESHOLDS: list[tuple[str, str, float | None, float | None]] = [
    ("mean_word_length", "mean_word_length", 2.0, 15.0),
    ("symbols_per_word", "symbols_per_word", None, 0.1),
    ("duplicate_line_share", "dup_line_share", None, 0.3),
    ("repeated_word_share", "repeat_share", None, 0.3),
    ("stop_words_of_long_texts", "stop_word_shortage", None, 0.0),
]

WINDOW = 8


OWN = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules"]


def _measured(df: DataFrame, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    # A line has a word if it has any character that is no delimiter.
    lines = F.filter(F.split(t, "\n"), lambda line: line.rlike("[^ \\t-\\r]"))
    out = df.withColumns({"__words": words_of(F.col(text)), "__lines": lines})
    out = out.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_symbols": (F.size(F.split(t, "[#*$%&|<>]")) - 1).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "__n_lines": F.size("__lines"),
        "__stops": F.arrays_overlap("__words", F.array(*map(F.lit, STOP_WORDS))),
        "__h1": F.when(F.size("__words") >= WINDOW, F.transform("__words", lambda w: F.xxhash64(w))),
    }).drop("__words", "__lines")
    # Hashes of windows by doubling: of 2 words from two of 1, of 4 from two of 2, of 8 from two of 4.
    for k in (1, 2, 4):
        out = out.withColumn(f"__h{2 * k}", F.expr(
            f"slice(zip_with(__h{k}, slice(__h{k}, {k + 1}, size(__h{k})), (x, y) -> xxhash64(x, y)), 1, size(__h{k}) - {k})"
        )).drop(f"__h{k}")
    out = out.withColumnRenamed("__h8", "__windows")
    # Windows in hash order; equal neighbours are repeats. Most rows have none and skip the sort.
    out = out.withColumn(
        "__order",
        F.expr("CASE WHEN size(array_distinct(__windows)) < size(__windows) THEN array_sort(transform(__windows, (h, i) -> struct(h, i))) END"),
    ).drop("__windows")
    out = out.withColumn("__starts", F.expr(
        "array_sort(transform(filter(__order, (x, k) -> (k > 0 AND __order[greatest(k - 1, 0)].h = x.h) "
        "OR (k < size(__order) - 1 AND __order[least(k + 1, size(__order) - 1)].h = x.h)), x -> x.i))"
    )).drop("__order")
    # Each start covers eight words, or as many as there are before the next start.
    return out.withColumn("n_repeat_words", F.expr(
        f"coalesce(aggregate(__starts, struct(0L AS n, -{WINDOW}L AS last), "
        f"(a, p) -> struct(a.n + least({WINDOW}L, p - a.last) AS n, CAST(p AS BIGINT) AS last), a -> a.n), 0L)"
    )).drop("__starts")


def _share(a: str, b: str) -> Column:
    return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))


def measures() -> dict[str, Column]:
    """What the threshold table may name."""
    return {
        "mean_word_length": _share("word_chars", "n_words"),
        "symbols_per_word": _share("n_symbols", "n_words"),
        "dup_line_share": _share("n_dup_lines", "__n_lines"),
        "repeat_share": _share("n_repeat_words", "n_words"),
        # Texts of 100 words and more need one stop word; cleaner short texts may have none.
        "stop_word_shortage": F.when((F.col("n_words") >= 100) & ~F.col("__stops"), 1.0).otherwise(0.0),
    }


def quality(df: DataFrame, text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """``df`` with the counts, base_failed, failed_rules (names) and kept."""
    kept = [c for c in df.columns if c.lower() not in OWN]
    out = _judged(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__all"), F.col(f"`{text}`").alias("__text")), thresholds)
    return out.select(*[F.col("__all")[c].alias(c) for c in kept], *OWN)


def _judged(rows: DataFrame, thresholds) -> DataFrame:
    """Rows (__all, __text) with the columns OWN."""
    out = _measured(rows, "__text")
    have = measures()
    failing = []
    for name, measure, least, most in thresholds:
        outside = F.lit(False)
        if least is not None:
            outside = outside | (have[measure] < least)
        if most is not None:
            outside = outside | (have[measure] > most)
        failing.append(F.when(outside, F.lit(name)))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    failed = F.array_compact(F.array(*failing)) if failing else F.array().cast("array<string>")
    return (
        out.withColumns({"base_failed": base, "failed_rules": failed})
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
        .drop("__n_lines", "__stops")
    )


def keep_good(df: DataFrame, text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """The kept rows of ``df`` with all their columns, whatever their names; a null, empty or blank text is not kept.

    The filter also names a column that is not deterministic, so it stays above the projections: pushed below, it would
    hold their expressions many times over.
    """
    rows = df.select(F.struct("*").alias("__all"), F.col(f"`{text}`").alias("__text"))
    out = _judged(rows, thresholds).withColumn("__nth", F.monotonically_increasing_id())
    return out.filter(F.col("kept") & (F.col("__nth") >= 0)).select("__all.*")
