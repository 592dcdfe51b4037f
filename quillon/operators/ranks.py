"""Positions in a total order without a window over one partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.work import written

#: Bits of a row's place in its partition, in Spark's growing ids.
PLACE = 33


def dense_position(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``position`` from 0 in the given order (a total order).

    Rows are dealt out by range, sorted and written once with their range and place in it; the ranges' sizes are
    one row a partition, and their running sum shifts the places. Ranges are sampled, so they must not be drawn twice.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    ranged = written(ranged, "ranks").withColumn("__part", F.shiftright("__at", PLACE))
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # over partitions, not rows
    shifts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    place = F.col("__at").bitwiseAND((1 << PLACE) - 1)
    return ranged.join(F.broadcast(shifts), "__part").withColumn("position", F.col("__shift") + place).drop("__part", "__at", "__shift")
