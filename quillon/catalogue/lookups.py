"""Queries of keyed lookups and selections."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..operators import lookup, selection
from ..registry import query
from ..sources.tables import table


@query("overlay_lookup", """WITH r AS (SELECT o_custkey AS key, o_orderkey AS candidate, o_orderstatus <> 'F' AS ok, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS position FROM orders)
 SELECT key, candidate, position FROM r WHERE ok QUALIFY row_number() OVER (PARTITION BY key ORDER BY position) = 1""")
def overlay_lookup(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("candidate"), "o_orderpriority", "o_orderstatus")
    return lookup.overlay(o, ["key"], [F.col("o_orderpriority"), F.col("candidate")], F.col("o_orderstatus") != "F")[0].select("key", "candidate", "position")


@query("overlay_rejected", """WITH r AS (SELECT o_custkey AS key, o_orderkey AS candidate, o_orderstatus <> 'F' AS ok, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS position FROM orders),
 f AS (SELECT *, min(CASE WHEN ok THEN position END) OVER (PARTITION BY key) AS first FROM r) SELECT key, candidate, position FROM f WHERE NOT ok AND (first IS NULL OR position < first)""")
def overlay_rejected(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("candidate"), "o_orderpriority", "o_orderstatus")
    return lookup.overlay(o, ["key"], [F.col("o_orderpriority"), F.col("candidate")], F.col("o_orderstatus") != "F")[1].select("key", "candidate", "position")


@query("identity_lookup", "SELECT l.l_orderkey AS id, l.l_linenumber AS line, o.o_totalprice AS payload FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey AND CAST(l_shipdate AS DATE) >= CAST(o_orderdate AS DATE) AND l_linestatus = o_orderstatus")
def identity_lookup(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    on = (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_linestatus") == F.col("o_orderstatus")) & (F.to_date("l_shipdate") >= F.to_date("o_orderdate"))
    return li.join(o, on).select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("o_totalprice").alias("payload"))


@query("revocation_probe", "SELECT o_orderkey AS id FROM orders o WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = o.o_custkey AND e.event_type = 'error' AND e.ts <= TIMESTAMP '2024-01-15')")
def revocation_probe(spark, d):
    rev = table(spark, d, "events").filter("event_type = 'error'").select(F.col("user_id").alias("o_custkey"), "ts")
    return lookup.not_revoked(table(spark, d, "orders"), rev, ["o_custkey"], "ts", F.lit("2024-01-15").cast("timestamp")).select(F.col("o_orderkey").alias("id"))


@query("reference_comparison", """SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part, CASE WHEN l_extendedprice / l_quantity = p_retailprice THEN 'Infinity'::DOUBLE ELSE round(-log10(abs(l_extendedprice / l_quantity - p_retailprice)), 6) END AS digits
 FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 40) ON l_partkey = p_partkey""")
def reference_comparison(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"))
    ref = table(spark, d, "part").filter("p_size < 40").select(F.col("p_partkey").alias("part"), "p_retailprice")
    out = lookup.against_reference(li, ref, "part", "unit", "p_retailprice")
    return out.select("id", "line", "part", F.when(F.col("digits") == float("inf"), F.col("digits")).otherwise(rounded(F.col("digits"), 6)).alias("digits"))


@query("atom_exclusion", "SELECT l_orderkey AS ordinal, l_linenumber AS line FROM lineitem ANTI JOIN (SELECT o_orderkey AS l_orderkey FROM orders WHERE o_orderstatus = 'P') USING (l_orderkey)")
def atom_exclusion(spark, d):
    gone = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return lookup.exclusion(table(spark, d, "lineitem"), gone, ["l_orderkey"])[0].select(F.col("l_orderkey").alias("ordinal"), F.col("l_linenumber").alias("line"))


@query("exclusion_without_atom", "SELECT o_orderkey AS l_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def exclusion_without_atom(spark, d):
    gone = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return lookup.exclusion(table(spark, d, "lineitem"), gone, ["l_orderkey"])[1]


@query("cohort_pairs", """SELECT a.c_custkey AS a, b.c_custkey AS b, round(a.c_acctbal - b.c_acctbal, 4) AS delta, CAST((a.c_mktsegment <> b.c_mktsegment) AS INT) + CAST((a.c_nationkey <> b.c_nationkey) AS INT) AS changed
 FROM orders o JOIN customer a ON a.c_custkey = o.o_custkey JOIN customer b ON b.c_custkey = o.o_orderkey % 100 + 1""")
def cohort_pairs(spark, d):
    """Explicit pairs alone are compared."""
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey")
    pairs = table(spark, d, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 100 + 1).alias("b"))
    one, two = (c.select(*[F.col(x).alias(f"{p}_{x}") for x in c.columns]) for p in "ab")
    both = pairs.join(one, F.col("a") == F.col("a_c_custkey")).join(two, F.col("b") == F.col("b_c_custkey"))
    changed = (F.col("a_c_mktsegment") != F.col("b_c_mktsegment")).cast("int") + (F.col("a_c_nationkey") != F.col("b_c_nationkey")).cast("int")
    return both.select("a", "b", F.round(F.col("a_c_acctbal") - F.col("b_c_acctbal"), 4).alias("delta"), changed.alias("changed"))


@query("output_comparison", "SELECT CASE WHEN p.p_partkey IS NULL THEN 'reference_absent' WHEN s.h = p.h THEN 'match' ELSE 'mismatch' END AS status, count(*) AS n FROM (SELECT l_orderkey AS k, l_quantity AS h FROM lineitem WHERE l_linenumber = 1) s LEFT JOIN (SELECT p_partkey, p_size AS h FROM part) p ON p_partkey = k GROUP BY 1")
def output_comparison(spark, d):
    got = table(spark, d, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("h"))
    ref = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("double").alias("h"))
    return lookup.compare_outputs(got, ref, "k", "h").groupBy("status").agg(F.count("*").alias("n"))


@query("continuation_lookup", "SELECT p_partkey AS key, p_size AS n FROM part WHERE p_brand = 'Brand#11' ORDER BY p_size DESC, p_partkey LIMIT 10")
def continuation_lookup(spark, d):
    return lookup.continuation(table(spark, d, "part"), F.col("p_brand") == "Brand#11", [F.desc("p_size"), F.col("p_partkey")], 10).select(F.col("p_partkey").alias("key"), F.col("p_size").alias("n"))


@query("prefix_key_search", "SELECT DISTINCT c_name AS key FROM customer WHERE starts_with(c_name, 'Customer#00000001') ORDER BY 1 LIMIT 50")
def prefix_key_search(spark, d):
    return table(spark, d, "customer").filter(F.startswith("c_name", F.lit("Customer#00000001"))).select(F.col("c_name").alias("key")).distinct().orderBy("key").limit(50)


@query("staged_resolution", """SELECT stage, count(*) AS n FROM (SELECT CASE WHEN n_name IS NULL THEN 'topology' WHEN o_orderkey IS NULL THEN 'index' WHEN o_orderstatus = 'P' THEN 'disposition' WHEN o_totalprice < 50000 THEN 'assurance' ELSE 'resolved' END AS stage
 FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 4) ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey) GROUP BY stage""")
def staged_resolution(spark, d):
    nation = table(spark, d, "nation").filter("n_regionkey < 4")
    rows = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    out = lookup.staged(rows, ("topology", F.col("n_name").isNotNull()), ("index", F.col("o_orderkey").isNotNull()), ("disposition", F.col("o_orderstatus") != "P"), ("assurance", F.col("o_totalprice") >= 50000))
    return out.groupBy(F.coalesce("failed_stage", F.lit("resolved")).alias("stage")).agg(F.count("*").alias("n"))


@query("supersession_step", "SELECT a.doc_id AS id, b.doc_id AS replacement FROM documents a JOIN documents b ON substr(sha256(CAST(a.doc_id AS VARCHAR)), 1, 2) = substr(sha256(CAST(b.doc_id AS VARCHAR)), 1, 2) AND b.doc_id = a.doc_id + 256 * (a.doc_id % 2)  WHERE a.doc_id <> b.doc_id")
def supersession_step(spark, d):
    doc = table(spark, d, "documents").select("doc_id", F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 2).alias("prefix"))
    new = doc.select(F.col("doc_id").alias("replacement"), "prefix")
    step = doc.withColumn("replacement", F.col("doc_id") + 256 * (F.col("doc_id") % 2))
    return step.join(new, ["prefix", "replacement"]).filter("doc_id <> replacement").select(F.col("doc_id").alias("id"), "replacement")


@query("candidate_choice", "SELECT l_partkey AS node, l_orderkey AS candidate, l_linenumber AS line FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_discount DESC, l_tax, l_quantity DESC, l_extendedprice, l_orderkey, l_linenumber) = 1")
def candidate_choice(spark, d):
    order = [F.desc("l_discount"), F.col("l_tax"), F.desc("l_quantity"), F.col("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")]
    return selection.best(table(spark, d, "lineitem"), ["l_partkey"], order).select(F.col("l_partkey").alias("node"), F.col("l_orderkey").alias("candidate"), F.col("l_linenumber").alias("line"))


@query("placement_choice", "SELECT p_partkey AS placement FROM part ORDER BY p_size, p_retailprice, p_partkey LIMIT 1")
def placement_choice(spark, d):
    return table(spark, d, "part").agg(F.min_by("p_partkey", F.struct("p_size", "p_retailprice", "p_partkey")).alias("placement"))


@query("fullest_shard", "SELECT arg_max(s_suppkey, (CAST(round(s_acctbal * 100) AS BIGINT) + 50000, -s_suppkey)) AS shard FROM supplier WHERE s_acctbal > 0 AND CAST(round(s_acctbal * 100) AS BIGINT) + 50000 <= 800000")
def fullest_shard(spark, d):
    s = table(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("shard"), F.round(F.col("s_acctbal") * 100).cast("long").alias("used"))
    return selection.fullest(s, "shard", "used", 50000, 800000)


@query("fullest_shard_by_ledger", "SELECT n_regionkey AS topology, arg_max(s_suppkey, (t, -s_suppkey)) AS shard, count(*) FILTER (WHERE t IS NULL) AS without_ledger FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN (SELECT l_suppkey, CAST(sum(l_quantity) AS BIGINT) AS t FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey GROUP BY 1")
def fullest_shard_by_ledger(spark, d):
    ledger = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.sum("l_quantity").cast("long").alias("t"))
    s = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(ledger, "s_suppkey", "left")
    return s.groupBy(F.col("n_regionkey").alias("topology")).agg(F.max_by("s_suppkey", F.struct("t", -F.col("s_suppkey"))).alias("shard"), F.count_if(F.col("t").isNull()).alias("without_ledger"))


@query("eigen_target", "(SELECT 'smallest' AS target, c_custkey AS id FROM customer ORDER BY c_acctbal, c_custkey LIMIT 5) UNION ALL (SELECT 'magnitude', c_custkey FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 5) UNION ALL (SELECT 'closest', c_custkey FROM customer ORDER BY abs(c_acctbal - 1000), c_custkey LIMIT 5) UNION ALL SELECT 'interval', c_custkey FROM customer WHERE c_acctbal BETWEEN 100 AND 200")
def eigen_target(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"))
    parts = [selection.target(c, "value", "id", kind, **args).select(F.lit(kind).alias("target"), "id") for kind, args in (("smallest", {"k": 5}), ("magnitude", {"k": 5}), ("closest", {"k": 5, "shift": 1000.0}), ("interval", {"lo": 100.0, "hi": 200.0}))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("target_index_range", "SELECT ordinal, id FROM (SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS ordinal, o_orderkey AS id FROM orders) WHERE ordinal BETWEEN 11 AND 40")
def target_index_range(spark, d):
    from ..operators.ranks import dense_position

    o = dense_position(table(spark, d, "orders").select("o_totalprice", F.col("o_orderkey").alias("id")), "o_totalprice", "id")
    return o.withColumn("ordinal", F.col("position") + 1).filter("ordinal BETWEEN 11 AND 40").select("ordinal", "id")


@query("checkpoint_ladder", "SELECT p_partkey AS id, dim FROM part, (SELECT unnest([1, 2, 4, 8, 16, 32, 64]) AS dim) WHERE dim < p_size UNION SELECT p_partkey, p_size FROM part")
def checkpoint_ladder(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.explode(selection.checkpoints(F.col("p_size"))).alias("dim"))


@query("observation_plan", "SELECT p_brand AS target, arg_min(p_partkey, (p_retailprice, p_partkey)) AS config FROM part WHERE p_size >= 25 GROUP BY p_brand")
def observation_plan(spark, d):
    return table(spark, d, "part").filter("p_size >= 25").groupBy(F.col("p_brand").alias("target")).agg(F.min_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("config"))


@query("config_layers", "SELECT l_partkey AS path, arg_max(l_quantity, (l_linenumber, l_orderkey, l_quantity)) AS value, max(l_linenumber) AS source FROM lineitem GROUP BY l_partkey")
def config_layers(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("path")).agg(F.max_by("l_quantity", F.struct("l_linenumber", "l_orderkey", "l_quantity")).alias("value"), F.max("l_linenumber").alias("source"))


@query("journal_latest", "SELECT user_id AS tx, arg_max(event_type, (ts, event_id)) AS phase, count(*) AS checkpoints FROM events GROUP BY user_id")
def journal_latest(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("tx")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("phase"), F.count("*").alias("checkpoints"))


@query("solver_plan", """SELECT p_partkey AS id, CASE WHEN p_size > 40 THEN 'matrix_free_lanczos' WHEN p_type LIKE 'ECO%' AND p_size <= 10 THEN 'dense_reference' WHEN p_type LIKE 'ECO%' THEN 'tridiagonal_sturm' ELSE 'shift_invert' END AS route FROM part""")
def solver_plan(spark, d):
    rules = [(F.col("p_size") > 40, "matrix_free_lanczos"), (F.startswith("p_type", F.lit("ECO")) & (F.col("p_size") <= 10), "dense_reference"), (F.startswith("p_type", F.lit("ECO")), "tridiagonal_sturm")]
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), selection.route(rules, "shift_invert").alias("route"))
