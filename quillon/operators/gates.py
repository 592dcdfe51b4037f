"""Gates: predicates that say every reason for a refusal, not only that there is one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Quality grades by rank; the last two are dispositions, not ranks.
RANKS = {"experimental": 0, "candidate": 1, "reviewed": 2, "certified": 3}


def reasons(*rules: tuple[str, Column]) -> Column:
    """Names of the rules whose predicate (refusal) is true, in the order given; null predicates count as refusals."""
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules]))


def gated(df: DataFrame, *rules: tuple[str, Column]) -> DataFrame:
    """``df`` with ``reasons`` and ``accepted``."""
    return df.withColumn("reasons", reasons(*rules)).withColumn("accepted", F.size("reasons") == 0)


def quality_satisfies(grade: Column, least: Column) -> Column:
    """Quarantined and deprecated satisfy nothing; published satisfies published alone; else by rank."""
    rank = lambda c: F.element_at(F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv]), c)
    return (
        F.when(grade.isin("quarantined", "deprecated") | least.isin("quarantined", "deprecated"), F.lit(False))
        .when((grade == "published") | (least == "published"), grade == least)
        .otherwise(F.coalesce(rank(grade) >= rank(least), F.lit(False)))
    )


def limit_violations(estimates: DataFrame, key: str, kinds: dict[str, float | None]) -> DataFrame:
    """(key, kind, estimate, bound) of estimates beyond their kind's limit; kinds without one pass."""
    pairs = ", ".join(f"'{k}', CAST({k} AS DOUBLE)" for k in kinds)
    bound = F.create_map(*[F.lit(x) for k, v in kinds.items() if v is not None for x in (k, float(v))])
    return (
        estimates.selectExpr(key, f"stack({len(kinds)}, {pairs}) AS (kind, estimate)")
        .withColumn("bound", F.try_element_at(bound, F.col("kind")))
        .filter(F.col("estimate") > F.col("bound"))
    )


def shard_accepts(writable: Column, visibility: Column, wanted: Column, kinds: Column, kind: Column, used: Column, size: Column, limit: Column) -> Column:
    """Whether a shard takes a write: writable, same visibility, a listed kind (no list: any), within its limit without overflow."""
    return writable & (visibility == wanted) & ((F.size(kinds) == 0) | F.array_contains(kinds, kind)) & F.coalesce(F.try_add(used, size) <= limit, F.lit(False))


def first_difference(fields: list[str], left: str = "a", right: str = "b") -> Column:
    """Name of the first field in which two structs differ, nulls being equal; null if none does."""
    return F.coalesce(*[F.when(~F.col(f"{left}.{f}").eqNullSafe(F.col(f"{right}.{f}")), F.lit(f)) for f in fields])


def cutoff_decision(lo: Column, hi: Column, bound: Column) -> Column:
    """Three-valued: satisfied if the whole enclosure is under the bound, refuted if it is over, else inconclusive."""
    return F.when(hi <= bound, "satisfied").when(lo > bound, "refuted").otherwise("inconclusive")
