"""Weighted tails of stored atoms: what lies within each cutoff and what remains, exact sums rounded once, in one pass for all families.

An atom falls into the bin of the first cutoff that is not below it. Its values are split into digits as in ``exact_sums``, digits are added by
bin and place, map side first, and only these few rows are summed along the cutoffs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.work import written
from .exact_sums import placed_digits, rounded
from .ranks import dense_position

#: Cutoffs at most: each atom is compared with all of them in a column.
CUTOFFS = 1_000


def default_cutoffs(atoms: DataFrame) -> list[float]:
    """Of all distinct coordinates in order the first, second, fourth, eighth and so on, and the last."""
    places = dense_position(atoms.select(F.col("coordinate").cast("double").alias("coordinate")).distinct(), "coordinate")
    last = places.agg(F.max("position")).first()[0]
    if last is None:
        return []
    k = F.col("position") + 1
    return sorted(r.coordinate for r in places.filter((k.bitwiseAND(k - 1) == 0) | (F.col("position") == last)).select("coordinate").collect())  # one a doubling


def weighted_tail(atoms: DataFrame, cutoffs: list[float] | None = None) -> DataFrame:
    """(family, partition, cutoff, included_count, included_mass, included_absolute_mass, remaining_mass, moment_1 to moment_3, status) for each cutoff of each family and partition.

    ``atoms`` has family, partition, coordinate and weight. Masses are the exact sums, moments those of weight / coordinate to the power, each rounded once from doubles; atoms at the
    origin have no moment. A weight there that is not 0 leaves the moments null: ``origin_only`` if nothing else is stored, else ``unresolved_denominator``; otherwise ``resolved``. Coordinates
    and cutoffs are finite and 0 or more, weights finite, or all is refused. Null families and partitions are groups like others; repeated atoms count each; an empty table gives an empty result.
    """
    kept = atoms.select("family", "partition", F.col("coordinate").cast("double").alias("coordinate"), F.col("weight").cast("double").alias("weight"))
    good = F.coalesce((F.col("coordinate") >= 0) & (F.col("coordinate") < float("inf")) & (F.abs("weight") < float("inf")), F.lit(False))
    if not kept.filter(~good).isEmpty():
        raise ValueError("coordinates must be finite and 0 or more, weights finite")
    at = default_cutoffs(kept) if cutoffs is None else sorted(set(map(float, cutoffs)))
    if len(at) > CUTOFFS or any(not 0 <= c < float("inf") for c in at):
        raise ValueError(f"at most {CUTOFFS} cutoffs, finite and 0 or more")
    x, w = F.col("coordinate"), F.col("weight")
    cut = F.array(*map(F.lit, at)) if at else F.array().cast("array<double>")
    kept = kept.withColumn("bin", F.size(F.filter(cut, lambda c: c < F.col("coordinate"))))
    group = F.struct("family", "partition").alias("group")
    away = F.when(x > 0, w)
    values: dict[str, Column] = {"included_mass": w, "included_absolute_mass": F.abs(w), "moment_1": away / x, "moment_2": away / x / x, "moment_3": away / x / x / x}
    counts = written(kept.groupBy(group, "bin").agg(F.count("*").alias("n"), F.bool_or((x == 0) & (w != 0)).alias("pole"), F.bool_and(x == 0).alias("origin")), "tail-counts")
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("v")) for n, v in values.items()])).alias("d")
    spread = kept.select(group, "bin", named).select("group", "bin", "d.*").filter("v <> 0")
    placed = written(placed_digits(spread, ["group", "name", "bin"], "v").filter("place >= 0"), "tail-digits")
    # Every place of a name meets every cutoff: at most 82 rows a cutoff.
    edges = kept.sparkSession.createDataFrame([*enumerate(at)], "bin int, cutoff double")
    rows = placed.select("group", "name", "place").distinct().crossJoin(F.broadcast(edges.select("bin").union(kept.sparkSession.createDataFrame([(len(at),)], "bin int"))))
    along = W.partitionBy("group", "name", "place").orderBy("bin")
    summed = rows.join(placed, ["group", "name", "place", "bin"], "left").withColumn("digit", F.coalesce("digit", F.lit(0).cast("long")))
    within = summed.withColumn("within", F.sum("digit").over(along.rowsBetween(W.unboundedPreceding, 0)))
    beyond = within.withColumn("beyond", F.sum("digit").over(along.rowsBetween(1, W.unboundedFollowing)))
    both = beyond.filter(F.col("bin") < len(at)).select("group", "bin", "place", F.explode(F.array(
        F.struct("name", F.col("within").alias("digit")), F.struct(F.lit("remaining_mass").alias("name"), F.when(F.col("name") == "included_mass", F.coalesce("beyond", F.lit(0).cast("long"))).alias("digit")),
    )).alias("d")).select("group", "bin", "place", "d.*").filter("digit IS NOT NULL")
    sums = both.groupBy("group", "bin", "name").agg(F.map_from_entries(F.collect_list(F.struct("place", "digit"))).alias("sums"))
    names = [*values, "remaining_mass"]
    wide = rounded(sums, "value").groupBy("group", "bin").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])
    whole = counts.groupBy("group").agg(F.bool_or("pole").alias("pole"), F.bool_and("origin").alias("origin"))
    every = whole.crossJoin(F.broadcast(edges)).join(counts.select("group", "bin", "n"), ["group", "bin"], "left").join(wide, ["group", "bin"], "left")
    n = F.sum(F.coalesce("n", F.lit(0).cast("long"))).over(W.partitionBy("group").orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    value = {c: F.coalesce(c, F.lit(0.0)).alias(c) for c in names}
    moments = [F.when(~F.col("pole"), F.coalesce(c, F.lit(0.0))).alias(c) for c in ("moment_1", "moment_2", "moment_3")]
    status = F.when(~F.col("pole"), "resolved").when(F.col("origin"), "origin_only").otherwise("unresolved_denominator").alias("status")
    return every.select("group.family", "group.partition", "cutoff", n.alias("included_count"), value["included_mass"], value["included_absolute_mass"], value["remaining_mass"], *moments, status)

