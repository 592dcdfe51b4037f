"""Best candidates, targets and routes; ties always go by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def best(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in a total order; Spark keeps one row a group before the shuffle."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter("__rn = 1").drop("__rn")


def fullest(shards: DataFrame, key: str, used: str, add: int, limit: int) -> DataFrame:
    """The acceptable shard with the most bytes after the addition, the least id among equals."""
    after = F.try_add(F.col(used), F.lit(add))
    return shards.filter(after <= limit).agg(F.max_by(key, F.struct(after, -F.col(key))).alias(key))


def target(df: DataFrame, value: str, key: str, kind: str, k: int = 1, shift: float = 0.0, lo: float = 0.0, hi: float = 0.0) -> DataFrame:
    """smallest, largest, magnitude or closest k values, or those in an interval."""
    v = F.col(value)
    if kind == "interval":
        return df.filter(v.between(lo, hi))
    order = {"smallest": v.asc(), "largest": v.desc(), "magnitude": F.abs(v).desc(), "closest": F.abs(v - shift).asc()}[kind]
    return df.orderBy(order, key).limit(k)


def checkpoints(dim: Column) -> Column:
    """Powers of two under a dimension, then the dimension."""
    powers = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda x: x < dim)
    return F.array_append(powers, dim)


def route(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """The first rule that holds."""
    return F.coalesce(*[F.when(c, F.lit(name)) for c, name in rules], F.lit(otherwise))
