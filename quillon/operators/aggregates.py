"""Aggregations and reductions with a stated order, and weighted-atom kernels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.work import written

#: Chunks that are folded in one row; a power of two, so that ranges are subtrees.
SPAN = 1_024
#: Points that are broadcast at most (32 bytes each); beyond, atoms meet them in blocks of so many.
POINTS = 100_000


def pairwise(values: Column) -> Column:
    """Sum of an array by adjacent pairs: the same tree for the same array, so bits never depend on tasks. Empty: 0."""
    return F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)).cast("double"))).cast("int"))),
        F.when(F.size(values) > 0, values).otherwise(F.array(F.lit(0.0))),
        lambda acc, _: F.when(F.size(acc) > 1, _halved(acc)).otherwise(acc),
        lambda acc: acc[0],
    )


def _halved(a: Column) -> Column:
    n = F.ceil(F.size(a) / F.lit(2)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(a, 2 * i) + F.coalesce(F.get(a, 2 * i + 1), F.lit(0.0)))


def chunked_sum(df: DataFrame, by: list[str], index: str, value: str, chunk: int) -> DataFrame:
    """Two-phase sum: chunks of consecutive indices in order, then pairwise over chunks. Independent of partitioning.

    Chunks are numbered as they come and dealt out by aligned ranges of ``SPAN``, each folded to its own subtree in its row; only the tops
    are shuffled again. So no group of chunks is gathered whole, and the tree is the one of adjacent pairs.
    """
    leaves = df.withColumn("__c", F.floor(F.col(index) / chunk)).groupBy(*by, "__c").agg(F.array_sort(F.collect_list(F.struct(index, value))).alias("v"))
    leaves = leaves.withColumn("leaf", F.aggregate("v", F.lit(0.0), lambda a, x: a + x[value]))
    # Chunks without a value leave no gap in the tree: they are numbered as they come.
    place = F.row_number().over(W.partitionBy(*by).orderBy("__c")) - 1
    level = written(leaves.select(*by, place.cast("long").alias("__c"), "leaf"), "chunked-sum")
    most = int(level.agg(F.max("__c")).first()[0] or 0)
    while True:
        inside = F.transform(F.array_sort(F.collect_list(F.struct("__c", "leaf"))), lambda x: x["leaf"])  # SPAN at most
        level = level.groupBy(*by, F.floor(F.col("__c") / SPAN).alias("__c")).agg(pairwise(inside).alias("leaf"))
        if (most := most // SPAN) == 0:
            return level.select(*by, F.col("leaf").alias("total"))


def dot(x: DataFrame, y: DataFrame, index: str, a: str, b: str) -> DataFrame:
    return x.join(y, index).agg(F.sum(F.col(a) * F.col(b)).alias("dot"))


def atom_kernels(atoms: DataFrame, points: DataFrame, by: list[str], x: str, w: str, z: str, orders=(1, 2, 3)) -> DataFrame:
    """Sums of w / (x - z)^m for each point and group, with absolute sums, nearest distance and count.

    An atom that coincides with a point withholds that group's sums. Every atom meets every point, as asked: up to POINTS points are
    broadcast, more go in blocks of so many, a pass over the atoms for each.
    """
    gap = F.col(x) - F.col(z)
    meets = F.bool_or(gap == 0)
    each = []
    for m in orders:
        power = gap
        for _ in range(m - 1):
            power = power * gap
        term = F.when(gap != 0, F.col(w) / power)
        each += [F.when(~meets, F.sum(term)).alias(f"k{m}"), F.when(~meets, F.sum(F.abs(term))).alias(f"abs_k{m}")]
    each += [F.min(F.abs(gap)).alias("nearest"), F.count("*").alias("atoms")]
    blocks = -(-points.count() // POINTS)
    parts = [points] if blocks < 2 else [points.filter(F.pmod(F.xxhash64(z), F.lit(blocks)) == k) for k in range(blocks)]
    return reduce(DataFrame.unionAll, [atoms.join(F.broadcast(p), F.lit(True)).groupBy(z, *by).agg(*each) for p in parts])


def cutoff_ladder(atoms: DataFrame, cutoffs: DataFrame, family: Column, x: str, cutoff: str, *measures: Column) -> DataFrame:
    """Measures for each cutoff over atoms of the bounded family up to it and all atoms of the others."""
    return atoms.join(cutoffs, ~family | (F.col(x) <= F.col(cutoff))).groupBy(cutoff).agg(*measures)


def error_budget(df: DataFrame, by: list[str], radius: str, known: Column) -> DataFrame:
    """Sum of absolute radii unless a component is unknown, and the unknown axes."""
    return df.groupBy(*by).agg(
        F.when(F.bool_and(known), F.sum(F.abs(radius))).alias("radius"), F.count_if(~known).alias("unknown_axes")
    )


def verdict(df: DataFrame, by: list[str], status: str, expected: int) -> DataFrame:
    """Fail before ineligible before pass (all there and passed), else unresolved."""
    s = F.col(status)
    return df.groupBy(*by).agg(
        F.when(F.bool_or(s == "fail"), "fail").when(F.bool_or(s == "ineligible"), "ineligible")
        .when(F.bool_and(s == "pass") & (F.count("*") >= expected), "pass").otherwise("unresolved").alias("verdict")
    )


def presence_totals(needed: DataFrame, target: DataFrame, others: DataFrame, key: list[str], size: str) -> DataFrame:
    """(class, objects, bytes): local if the target has the object, copy if another store has, else upload."""
    here = target.select(*key).distinct().withColumn("__here", F.lit(True))
    there = others.select(*key).distinct().withColumn("__there", F.lit(True))
    kind = F.when(F.col("__here"), "local").when(F.col("__there"), "copy").otherwise("upload")
    joined = needed.join(here, key, "left").join(there, key, "left")
    return joined.groupBy(kind.alias("class")).agg(F.count("*").alias("objects"), F.sum(size).cast("long").alias("bytes"))
