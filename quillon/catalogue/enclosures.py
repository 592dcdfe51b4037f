"""Queries of enclosed roots of stored secular functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import enclosed_roots
from ..registry import query
from ..sources.tables import table

ROOTS = """p AS (SELECT l_suppkey AS s, p_size::DOUBLE AS x, sum(l_quantity)::DOUBLE AS w FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
 l AS (SELECT s, list(x ORDER BY x) AS xs, list(w ORDER BY x) AS ws FROM p GROUP BY s),
 g AS (SELECT s, CAST(unnest(range(1, len(xs))) AS INT) AS gap, xs, ws FROM l),
 r AS (SELECT s, gap, xs, ws, xs[gap] AS lo, xs[gap + 1] AS hi, 0 AS n FROM g
  UNION ALL SELECT s, gap, xs, ws, CASE WHEN v > 0 THEN m ELSE lo END, CASE WHEN v > 0 THEN hi ELSE m END, n + 1
  FROM (SELECT *, (lo + hi) / 2 AS m, list_sum(list_transform(range(1, len(xs) + 1), lambda i: ws[i] / ((lo + hi) / 2 - xs[i]))) AS v FROM r WHERE n < 42)),
 e AS (SELECT s, gap, (lo + hi) / 2 AS root FROM r WHERE n = 42)"""


def size_poles(spark, d):
    """Of each supplier the sizes of what it delivers as poles, the quantities as weights."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    li = table(spark, d, "lineitem").join(p, "l_partkey")
    return li.groupBy(F.col("l_suppkey").alias("family"), F.col("p_size").cast("double").alias("pole")).agg(F.sum("l_quantity").alias("weight"))


@query("secular_root_enclosures", f"WITH RECURSIVE {ROOTS} SELECT s AS family, gap, round(root, 6) AS root, true AS narrow FROM e")
def secular_root_enclosures(spark, d):
    found = enclosed_roots.roots(size_poles(spark, d))
    return found.select("family", "gap", F.round((F.col("lo") + F.col("hi")) / 2, 6).alias("root"), (F.col("hi") - F.col("lo") < 1e-9).alias("narrow"))


@query("secular_windows", f"""WITH RECURSIVE {ROOTS}, w AS (SELECT DISTINCT s, k * 1.7 AS low, k * 1.7 + 0.6 AS high FROM p, (SELECT unnest(range(0, 32)) AS k))
 SELECT w.s AS family, round(low, 3)::DOUBLE AS low, count(root) FILTER (WHERE root BETWEEN low AND high) AS inside, CASE WHEN count(root) FILTER (WHERE root BETWEEN low AND high) > 0 THEN 'holds' ELSE 'empty' END AS proof
 FROM w LEFT JOIN e ON e.s = w.s GROUP BY 1, 2""")
def secular_windows(spark, d):
    """Windows over every supplier's axis, those between roots proved empty."""
    poles = size_poles(spark, d)
    k = F.explode(F.sequence(F.lit(0), F.lit(31))).alias("k")
    wanted = poles.select("family").distinct().select("family", k).select("family", (F.col("k") * 1.7).alias("low"), (F.col("k") * 1.7 + 0.6).alias("high"))
    out = enclosed_roots.windows(enclosed_roots.roots(poles), wanted)
    return out.select("family", F.round("low", 3).alias("low"), "inside", "proof")
