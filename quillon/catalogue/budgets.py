"""Queries of greedy budgets and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import budget, dag, ladders
from ..registry import query
from ..sources.tables import table
from .numeric import edges


@query("family_batch_packing", """WITH RECURSIVE d AS (SELECT source, lang, doc_id, n_chars, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS i FROM documents),
 f AS (SELECT source, lang, doc_id, i, n_chars AS used, 0::BIGINT AS batch FROM d WHERE i = 1 UNION ALL SELECT d.source, d.lang, d.doc_id, d.i, CASE WHEN f.used > 0 AND f.used + d.n_chars > 12000 THEN d.n_chars ELSE f.used + d.n_chars END, CASE WHEN f.used > 0 AND f.used + d.n_chars > 12000 THEN f.batch + 1 ELSE f.batch END FROM f JOIN d ON d.source = f.source AND d.lang = f.lang AND d.i = f.i + 1)
 SELECT source, lang, doc_id, batch FROM f""")
def family_batch_packing(spark, d):
    """Every family of a source has batches of its own, all families at once."""
    docs = table(spark, d, "documents").select("source", "lang", "doc_id", "n_chars")
    return ladders.greedy_batches(docs, ["source", "lang"], "doc_id", "n_chars", 12000).select("source", "lang", "doc_id", "batch")


@query("budgeted_candidates", """WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, round(o_totalprice)::BIGINT AS cost, round(greatest(c_acctbal, 0) * 100)::BIGINT AS budget,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders JOIN customer ON c_custkey = o_custkey),
 f AS (SELECT o_custkey, o_orderkey, i, cost <= budget AS taken, budget - CASE WHEN cost <= budget THEN cost ELSE 0 END AS rest FROM o WHERE i = 1
  UNION ALL SELECT o.o_custkey, o.o_orderkey, o.i, o.cost <= f.rest, f.rest - CASE WHEN o.cost <= f.rest THEN o.cost ELSE 0 END FROM f JOIN o ON o.o_custkey = f.o_custkey AND o.i = f.i + 1)
 SELECT o_custkey, o_orderkey, taken FROM f""")
def budgeted_candidates(spark, d):
    """Orders in turn, each taken if it fits what the customer's balance has left; a budget for each group."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.round(F.greatest(F.col("c_acctbal"), F.lit(0.0)) * 100).cast("long").alias("budget"))
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.round("o_totalprice").cast("long").alias("cost")).join(c, "o_custkey")
    return budget.spend(o, ["o_custkey"], ["o_orderkey"], "cost", F.col("budget")).select("o_custkey", "o_orderkey", "taken")


@query("limited_resolution", """WITH n AS (SELECT o_orderkey, o_custkey, c_nationkey, n_regionkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
 l AS (SELECT 'o' || o_orderkey AS root, 3 AS nodes, 2 AS depth, CASE WHEN c_nationkey % 5 = 0 THEN 'missing' END AS bad FROM n
  UNION ALL SELECT 'c' || c_custkey, 3, 2, CASE WHEN c_nationkey % 5 = 0 THEN 'missing' END FROM customer UNION ALL SELECT 'n' || n_nationkey, 2, 1, CASE WHEN n_nationkey % 5 = 0 THEN 'missing' END FROM nation)
 SELECT root, nodes, depth, CASE WHEN depth > 1 THEN 'too_deep' ELSE coalesce(bad, 'resolved') END AS outcome FROM l""")
def limited_resolution(spark, d):
    """Orders, customers and nations with a limit of one step: what lies deeper is told, not refused."""
    e = edges(spark, d)
    all_ = e.select("node").unionByName(e.select(F.col("dep").alias("node"))).distinct()
    known = all_.filter(~(F.startswith("node", F.lit("n")) & (F.substring("node", 2, 9).try_cast("int") % 5 == 0)))
    return dag.resolved(e.select(F.col("node").alias("root")).distinct(), e, known, 1, 100)
