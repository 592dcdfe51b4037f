"""Connected components by joins: least label of the neighbours, then label of the label, until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component: the least id reachable) for each id on an edge; ids must be non-null and ordered.

    Each round joins edges with labels; rounds grow with the logarithm of a component's diameter.
    """
    one = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct()
    both = written(one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("label")), "labels")
    while True:
        # Shortcut first: a star needs this round alone.
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("top"))
        short = labels.join(up, "label", "left").select("id", F.col("label").alias("was"), F.least("label", F.coalesce("top", "label")).alias("label"))
        near = both.join(short.select(F.col("id").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("m"))
        step = written(
            short.join(near, short["id"] == near["u"], "left").select("id", "was", F.least("label", F.coalesce("m", "label")).alias("label")), "labels"
        )
        changed = not step.filter("was <> label").isEmpty()
        drop_table(labels)
        labels = step.drop("was")
        labels.quillon_path = step.quillon_path
        if not changed:
            drop_table(both)
            return labels.select("id", F.col("label").alias("component"))
