"""Keyed lookups: overlays, revocations, supersession, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def overlay(candidates: DataFrame, key: list[str], order: list[Column], accepted: Column) -> tuple[DataFrame, DataFrame]:
    """(first accepted candidate of each key in the order, candidates before it that were refused)."""
    w = W.partitionBy(*key).orderBy(*order)
    ranked = candidates.withColumns({"__ok": accepted, "position": F.row_number().over(w).cast("long")})
    ranked = ranked.withColumn("__first", F.min(F.when(F.col("__ok"), F.col("position"))).over(W.partitionBy(*key)))
    chosen = ranked.filter("position = __first").drop("__ok", "__first")
    refused = ranked.filter("NOT __ok AND (__first IS NULL OR position < __first)").drop("__ok", "__first")
    return chosen, refused


def not_revoked(df: DataFrame, revocations: DataFrame, on: list[str], effective: str, at: Column) -> DataFrame:
    """Rows without a revocation in effect at the time ``at``."""
    return df.join(revocations.filter(F.col(effective) <= at), on, "left_anti")


def against_reference(df: DataFrame, references: DataFrame, on: str | list[str], value: str, reference: str) -> DataFrame:
    """``df`` with matching digits, -log10 of the difference: infinite if equal, null without a reference."""
    gap = F.abs(F.col(value) - F.col(reference))
    return df.join(references, on, "left").withColumn("digits", F.when(gap == 0, F.lit(float("inf"))).otherwise(-F.log10(gap)))


def exclusion(df: DataFrame, excluded: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that are not excluded, exclusions that name no row)."""
    return df.join(excluded, key, "left_anti"), excluded.join(df.select(*key), key, "left_anti")


def continuation(df: DataFrame, equal: Column, order: list[Column], most: int) -> DataFrame:
    """The best keys to go on from: equal parameters, ordered, the first few."""
    return df.filter(equal).orderBy(*order).limit(most)


def staged(df: DataFrame, *stages: tuple[str, Column]) -> DataFrame:
    """``df`` with the first stage it fails (null: none); later stages are not judged."""
    return df.withColumn("failed_stage", F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in stages]))


def compare_outputs(computed: DataFrame, reference: DataFrame, key: str, value: str) -> DataFrame:
    """(key, status): match, mismatch or reference_absent."""
    other = reference.select(key, F.col(value).alias("__r"), F.lit(True).alias("__there"))
    status = F.when(F.col("__there").isNull(), "reference_absent").when(F.col(value).eqNullSafe(F.col("__r")), "match").otherwise("mismatch")
    return computed.join(other, key, "left").select(key, status.alias("status"))
