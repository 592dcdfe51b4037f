"""Assessments and summaries of stored observations: acceptance with warnings, durability, capacity, verdicts, phase and performance reports.

Every function takes tables with stated columns and gives a table; a refusal always says all its reasons, or the first failing check where the order of checks
is the contract.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .gates import quality_satisfies, reasons


def accepted(
    manifests: DataFrame, schemas: list[int], reader: tuple[int, int, int], visibilities: list[str], least_quality: str,
    allow_deprecated: bool = False, allow_quarantined: bool = False,
) -> DataFrame:
    """``manifests`` with reasons, warnings and accepted.

    Columns read: schema_version, minimum_reader and maximum_reader (structs of three numbers, the latter null if open), producer and producer_floor (structs; no
    floor: null), visibility, quality. A disposition that the policy lets through leaves a warning: it gives no evidence back.
    """
    own = F.struct(*[F.lit(v).alias(f) for v, f in zip(reader, ("major", "minor", "patch"), strict=True)])
    as_version = lambda c: F.struct(*[F.col(f"{c}.{f}").alias(f) for f in ("major", "minor", "patch")])
    q = F.col("quality")
    held = lambda name: F.col(name).isNotNull()
    why = reasons(
        ("producer_precedes_floor", held("producer_floor") & (as_version("producer") < as_version("producer_floor"))),
        ("schema_version", ~F.col("schema_version").isin(schemas)), ("reader_too_old", own < as_version("minimum_reader")),
        ("reader_too_new", held("maximum_reader") & (own > as_version("maximum_reader"))), ("visibility", ~F.col("visibility").isin(visibilities)),
        ("deprecated", (q == "deprecated") & F.lit(not allow_deprecated)), ("quarantined", (q == "quarantined") & F.lit(not allow_quarantined)),
        ("quality", ~quality_satisfies(q, F.lit(least_quality))),
    )
    warned = F.array_compact(F.array(
        F.when((q == "deprecated") & F.lit(allow_deprecated), F.lit("deprecated_without_evidence")), F.when((q == "quarantined") & F.lit(allow_quarantined), F.lit("quarantined_without_evidence")),
    ))
    return manifests.withColumns({"reasons": why, "warnings": warned}).withColumn("accepted", F.size("reasons") == 0)


def durability(copies: DataFrame, checks: list[tuple[str, Column]], least_copies: int, least_domains: int, archive: bool = False) -> tuple[DataFrame, DataFrame]:
    """((object, copies, domains, archived, deficits, durable), refused copies (object, copy, reason)) of copies (object, seq, copy, locator, domain, archived).

    A copy is refused by the first check that fails, or as a repetition of a copy or locator that an earlier copy of the object has.
    """
    failed = F.coalesce(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in checks]) if checks else F.lit(None).cast("string")
    judged = copies.withColumn("reason", failed)
    good = judged.filter("reason IS NULL")
    again = lambda c: F.row_number().over(W.partitionBy("object", c).orderBy("seq")) > 1
    good = good.withColumn("reason", F.when(again("copy"), "copy_repeats").when(again("locator"), "locator_repeats"))
    kept = good.filter("reason IS NULL")
    counts = kept.groupBy("object").agg(F.count("*").alias("copies"), F.count_distinct("domain").alias("domains"), F.bool_or("archived").alias("archived"))
    out = copies.select("object").distinct().join(counts, "object", "left").fillna(0, ["copies", "domains"]).withColumn("archived", F.coalesce("archived", F.lit(False)))
    lacks = reasons(("copies", F.col("copies") < least_copies), ("domains", F.col("domains") < least_domains), ("archive", F.lit(archive) & ~F.col("archived")))
    out = out.withColumn("deficits", lacks).withColumn("durable", F.size("deficits") == 0)
    return out, judged.filter("reason IS NOT NULL").unionByName(good.filter("reason IS NOT NULL")).select("object", "copy", "reason")


def capacity(ledgers: DataFrame, addition: Column, limit: Column) -> DataFrame:
    """(shard, used, projected, accepts) of ledgers (shard, used): the sum after an addition, null if it overflows, against the cap."""
    return ledgers.withColumn("projected", F.try_add("used", addition)).withColumn("accepts", F.coalesce(F.col("projected") <= limit, F.lit(False)))


def output_totals(comparisons: DataFrame, by: list[str]) -> DataFrame:
    """(by, matched, mismatched, absent, recomputed, reused, first_mismatch) of comparisons (id, status, origin)."""
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    return comparisons.groupBy(*by).agg(
        is_("status", "match").alias("matched"), is_("status", "mismatch").alias("mismatched"), is_("status", "absent").alias("absent"),
        is_("origin", "recomputed").alias("recomputed"), is_("origin", "reused").alias("reused"), F.min(F.when(F.col("status") == "mismatch", F.col("id"))).alias("first_mismatch"),
    )


def corpus_report(shards: DataFrame, rollover: int, most: int) -> DataFrame:
    """(shard, objects, size, rolls_over, within) of objects (shard, size): whether a shard is full, and no object larger than allowed."""
    return shards.groupBy("shard").agg(
        F.count("*").alias("objects"), F.sum("size").cast("long").alias("size"), (F.sum("size") > rollover).alias("rolls_over"), (F.max("size") <= most).alias("within")
    )


def scored(cases: DataFrame, observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((family, cases, passed, verdict), exclusions (case, reason)) of a frozen specification's cases (family, case) and observations (case, seq, status).

    A case counts its first observation; further ones, and those of cases that were never frozen, are excluded with the reason. Fail goes before
    ineligible, ineligible before pass; a family with an unobserved case is unresolved unless one failed.
    """
    first = observations.withColumn("nth", F.row_number().over(W.partitionBy("case").orderBy("seq")))
    frozen = cases.select("case").distinct()
    repeated = first.filter("nth > 1").join(frozen, "case", "left_semi").select("case", F.lit("repeated").alias("reason"))
    unknown = observations.join(frozen, "case", "left_anti").select("case", F.lit("not_frozen").alias("reason"))
    rows = cases.join(first.filter("nth = 1").select("case", "status"), "case", "left")
    s = F.col("status")
    verdict = (
        F.when(F.bool_or(F.coalesce(s == "fail", F.lit(False))), "fail").when(F.bool_or(F.coalesce(s == "ineligible", F.lit(False))), "ineligible")
        .when(F.bool_and(F.coalesce(s == "pass", F.lit(False))), "pass").otherwise("unresolved")
    )
    return rows.groupBy("family").agg(F.count("*").alias("cases"), F.count_if(s == "pass").alias("passed"), verdict.alias("verdict")), repeated.unionByName(unknown)


def phase_statistics(events: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """((by, phase, calls, seconds, failures, bytes), refused (by, line, reason)) of events (by, line, phase, outcome, seconds, details).

    An event counts as a whole or not at all: its seconds must be a finite number of 0 or more and its phase known. Details whose names hold "bytes" are added up
    if they are whole numbers; flags are none.
    """
    s = F.col("seconds")
    reason = F.when(F.col("phase").isNull(), "no_phase").when(s.isNull() | F.isnan(s) | (F.abs(s) == float("inf")), "seconds_not_finite").when(s < 0, "seconds_negative")
    judged = events.withColumn("reason", reason)
    sizes = F.filter(F.map_entries(F.coalesce("details", F.create_map().cast("map<string,string>"))), lambda e: F.contains(e["key"], F.lit("bytes")) & F.regexp_like(e["value"], F.lit("^[0-9]+$")))
    total = F.aggregate(sizes, F.lit(0).cast("long"), lambda a, e: a + e["value"].cast("long"))
    good = judged.filter("reason IS NULL").withColumn("__bytes", total)
    out = good.groupBy(*by, "phase").agg(
        F.count("*").alias("calls"), F.sum("seconds").alias("seconds"), F.count_if(F.col("outcome") == "failed").alias("failures"), F.sum("__bytes").alias("bytes")
    )
    return out, judged.filter("reason IS NOT NULL").select(*by, "line", "reason")


def latest(events: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """(by, phase, outcome, seen) of the last event of each attempt; ties in order go by phase."""
    last = F.max_by(F.struct("phase", "outcome"), F.struct(*order, "phase")).alias("last")
    return events.groupBy(*by).agg(last, F.count("*").alias("seen")).select(*by, "last.phase", "last.outcome", "seen")


def performance(timings: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, total, least, most, mean) of timings (by, elapsed)."""
    e = F.col("elapsed")
    return timings.groupBy(*by).agg(F.count("*").alias("n"), F.sum(e).alias("total"), F.min(e).alias("least"), F.max(e).alias("most"), F.avg(e).alias("mean"))


def convergence(values: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, least, median, most, unresolved) of values (by, value), where null is unresolved and counts for no other column."""
    v = F.col("value")
    return values.groupBy(*by).agg(F.count(v).alias("n"), F.min(v).alias("least"), F.median(v).alias("median"), F.max(v).alias("most"), F.count_if(v.isNull()).alias("unresolved"))


def source_matches(declared: DataFrame, sources: DataFrame) -> DataFrame:
    """(manifest, declared, absent, differing, matches) of declared sources (manifest, source, digest) against sources (source, digest)."""
    both = declared.join(sources.select("source", F.col("digest").alias("held")), "source", "left")
    out = both.groupBy("manifest").agg(
        F.count("*").alias("declared"), F.count_if(F.col("held").isNull()).alias("absent"), F.count_if(F.col("held") != F.col("digest")).alias("differing")
    )
    return out.withColumn("matches", (F.col("absent") == 0) & (F.col("differing") == 0))


def superseded(keys: DataFrame, records: DataFrame, by: list[str]) -> DataFrame:
    """``keys`` with the replacement that one step of the records (by, replacement) names, null if there is none.

    Records are stored by the first two hex digits of their key's digest; the join names them too, so that only these folders are read.
    """
    prefix = F.substring(F.sha2(F.concat_ws("\n", *by), 256), 1, 2)
    held = records if "prefix" in records.columns else records.withColumn("prefix", prefix)
    return keys.withColumn("prefix", prefix).join(held.select(*by, "prefix", "replacement"), [*by, "prefix"], "left").drop("prefix")


def by_identity(wanted: DataFrame, artifacts: DataFrame, identity: list[str]) -> DataFrame:
    """(identity, artifact, found) of wanted identities; a key that several artifacts have is ambiguous and finds none."""
    held = artifacts.groupBy(*identity).agg(F.count("*").alias("__n"), F.min("artifact").alias("artifact"))
    n = F.coalesce("__n", F.lit(0))
    found = F.when(n == 0, "missing").when(n > 1, "ambiguous").otherwise("found")
    return wanted.join(held, identity, "left").select(*identity, F.when(n == 1, F.col("artifact")).alias("artifact"), found.alias("found"))


def first_of_targets(configs: DataFrame, target: str, order: list[str], k: int) -> DataFrame:
    """The first k configurations of each target in a total order, with their ordinal from 1."""
    place = F.row_number().over(W.partitionBy(target).orderBy(*order))
    return configs.withColumn("ordinal", place).filter(F.col("ordinal") <= k)
