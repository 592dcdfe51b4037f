"""Queries of exact sums: rounded once, the same bits for every partitioning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import exact_sums
from ..registry import query
from ..sources.tables import table

#: Prices are doubles of 900 and more, so whole multiples of 2**-43.
SCALE = 1 << 43


@query("exact_sums", f"SELECT l_orderkey AS id, CAST(sum(CAST(l_extendedprice * {SCALE} AS BIGINT)) AS DOUBLE) / {SCALE} AS total, count(*) AS n FROM lineitem GROUP BY 1")
def exact_order_sums(spark, d):
    """Sums of prices by order: the doubles nearest to the exact sums."""
    li = table(spark, d, "lineitem")
    n = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n"))
    return exact_sums.exact_sums(li.select(F.col("l_orderkey").alias("id"), "l_extendedprice"), ["id"], total=F.col("l_extendedprice")).join(n, "id")


@query("exact_sums_repartitioned", "SELECT l_suppkey AS id, round(sum(l_extendedprice), 3) AS total, CAST(1 AS BIGINT) AS answers FROM lineitem GROUP BY 1")
def exact_sums_repartitioned(spark, d):
    """The same sums over three partitionings of the rows: how many different doubles come out."""
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("id"), "l_orderkey", F.col("l_extendedprice").alias("v"))
    # Rows by millions: partitions do not grow with the table.
    n = li.count() >> 20
    runs = [li, li.repartition(n + 3, "l_orderkey"), li.repartition(n + 11).sortWithinPartitions(F.desc("v"))]
    sums = [exact_sums.exact_sums(x, ["id"], total=F.col("v")) for x in runs]
    return sums[0].unionAll(sums[1]).unionAll(sums[2]).groupBy("id").agg(F.round(F.first("total"), 3).alias("total"), F.count_distinct("total").alias("answers"))


@query("exact_norms", "SELECT label, round(sum(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings GROUP BY 1")
def exact_norms(spark, d):
    """Sums of squares of all components by label; each square is two doubles."""
    e = table(spark, d, "embeddings").select("label", F.explode("embedding").alias("x"))
    return exact_sums.exact_dots(e, ["label"], norm=(F.col("x"), F.col("x"))).select("label", F.round("norm", 6).alias("norm"))
