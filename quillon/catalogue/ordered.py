"""Queries of ordered analytics and reductions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates, ladders
from ..registry import query
from ..sources.tables import table


def by_user(spark, d):
    return table(spark, d, "events").select("user_id", "event_id", "value")


@query("root_reconciliation", """WITH o AS (SELECT *, coalesce(value - lag(value) OVER w <= 0.05, false) AS duplicate FROM (SELECT user_id, event_id, value FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY value, event_id)),
 b AS (SELECT *, last_value(CASE WHEN NOT duplicate THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY value, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM o)
 SELECT user_id, event_id, duplicate, coalesce(NOT duplicate AND event_id <= before, false) AS crossover, CAST(coalesce(CASE WHEN NOT duplicate AND before IS NOT NULL THEN greatest(event_id - before - 1, 0) END, 0) AS BIGINT) AS skipped FROM b""")
def root_reconciliation(spark, d):
    out = ladders.reconcile(by_user(spark, d), ["user_id"], "value", "event_id", 0.05)
    return out.select("user_id", "event_id", "duplicate", "crossover", "skipped")


@query("stabilization_ladder", """WITH c AS (SELECT user_id, event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS change FROM events)
 SELECT user_id, event_id, round(change, 6) AS change, round(CASE WHEN lag(change) OVER w <> 0 THEN change / lag(change) OVER w END, 4) AS ratio FROM c WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def stabilization_ladder(spark, d):
    out = ladders.stabilization(by_user(spark, d), ["user_id"], "event_id", "value")
    return out.select("user_id", "event_id", F.round("change", 6).alias("change"), F.round("ratio", 4).alias("ratio"))


@query("interval_ladder", """WITH v AS (SELECT user_id, event_id, value - 1 AS lo, value + 1 AS hi FROM events), c AS (SELECT *, lo - lag(hi) OVER w AS change_lo, hi - lag(lo) OVER w AS change_hi FROM v WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
 p AS (SELECT *, lag(change_lo) OVER w AS a, lag(change_hi) OVER w AS b FROM c WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
 SELECT user_id, event_id, CASE WHEN a > 0 OR b < 0 THEN round(least(change_lo / a, change_lo / b, change_hi / a, change_hi / b), 4) + 0.0 END AS ratio_lo, CASE WHEN a > 0 OR b < 0 THEN round(greatest(change_lo / a, change_lo / b, change_hi / a, change_hi / b), 4) + 0.0 END AS ratio_hi FROM p""")
def interval_ladder(spark, d):
    v = by_user(spark, d).select("user_id", "event_id", (F.col("value") - 1).alias("lo"), (F.col("value") + 1).alias("hi"))
    out = ladders.interval_stabilization(v, ["user_id"], "event_id", "lo", "hi")
    return out.select("user_id", "event_id", (F.round("ratio_lo", 4) + 0.0).alias("ratio_lo"), (F.round("ratio_hi", 4) + 0.0).alias("ratio_hi"))


@query("mode_starvation", "SELECT user_id, min(CASE WHEN least(value, 50 + event_id % 7) < 20 THEN event_id END) AS first_starved, true AS strict FROM events GROUP BY user_id")
def mode_starvation(spark, d):
    e = by_user(spark, d).withColumn("raw", (50 + F.col("event_id") % 7).cast("double"))
    return ladders.first_starved(e, ["user_id"], "event_id", "value", "raw", 20.0)


@query("precision_sweep", """WITH s AS (SELECT l_partkey AS id, l_orderkey * 10 + l_linenumber AS bits, max(l_quantity) AS digits FROM lineitem GROUP BY ALL), x AS (SELECT *, (digits - lag(digits) OVER w) / (bits - lag(bits) OVER w) AS slope FROM s WINDOW w AS (PARTITION BY id ORDER BY bits))
 SELECT id, round(min(slope), 8) AS least_slope, round(max(slope), 8) AS most_slope, arg_max(digits, bits) >= 25 AS confirmed FROM x GROUP BY id""")
def precision_sweep(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("bits"), F.col("l_quantity").alias("digits"))
    s = s.groupBy("id", "bits").agg(F.max("digits").alias("digits"))
    out = ladders.sweep(s, ["id"], "bits", "digits", 25)
    return out.select("id", F.round("least_slope", 8).alias("least_slope"), F.round("most_slope", 8).alias("most_slope"), "confirmed")


@query("refinement_cohort", """WITH r AS (SELECT user_id, event_id, CASE WHEN value <> 0 THEN abs(value - lag(value) OVER w) / abs(value) END AS relative FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
 p AS (SELECT *, CAST(coalesce(relative <= 0.5, false) AS INT) AS pass FROM r), i AS (SELECT *, sum(1 - pass) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS island FROM p)
 SELECT user_id, event_id, CAST(sum(pass) OVER (PARTITION BY user_id, island ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run, sum(pass) OVER (PARTITION BY user_id, island ORDER BY event_id ROWS UNBOUNDED PRECEDING) >= 2 AS stabilized FROM i""")
def refinement_cohort(spark, d):
    return ladders.refinement(by_user(spark, d), ["user_id"], "event_id", "value", 0.5).select("user_id", "event_id", "run", "stabilized")


@query("sign_crossings", """WITH s AS (SELECT user_id, event_id, nullif(sign(round(value - 50, 0)), 0) AS s FROM events), l AS (SELECT *, last_value(s IGNORE NULLS) OVER w AS last, last_value(CASE WHEN s IS NOT NULL THEN event_id END IGNORE NULLS) OVER w AS lower FROM s
 WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT user_id, lower, event_id AS upper FROM l WHERE s <> last""")
def sign_crossings(spark, d):
    e = by_user(spark, d).withColumn("value", F.round(F.col("value") - 50, 0))
    return ladders.sign_crossings(e, ["user_id"], "event_id", "value").select("user_id", "lower", "upper")


@query("node_count", """WITH t AS (SELECT user_id, event_id, value - 50 AS v, max(abs(value - 50)) OVER (PARTITION BY user_id) AS top FROM events), k AS (SELECT user_id, event_id, v FROM t WHERE abs(v) >= 0.1 * top AND v <> 0),
 c AS (SELECT user_id, coalesce(sign(v) <> lag(sign(v)) OVER (PARTITION BY user_id ORDER BY event_id), false) AS t FROM k) SELECT user_id, CAST(sum(t::INT) AS BIGINT) AS nodes FROM c GROUP BY user_id""")
def node_count(spark, d):
    return ladders.node_count(by_user(spark, d).withColumn("value", F.col("value") - 50), ["user_id"], "event_id", "value", 0.1)


@query("parity_classify", """WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) SELECT a.vec_id AS vec_id, CASE WHEN max(abs(a.v - b.v)) <= 0.9 THEN 'even' WHEN max(abs(a.v + b.v)) <= 0.9 THEN 'odd' ELSE 'none' END AS parity
 FROM v a JOIN v b ON a.vec_id = b.vec_id AND b.i = 63 - a.i GROUP BY a.vec_id""")
def parity_classify(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    return ladders.parity(v, ["vec_id"], "i", "v", 0.9)


@query("linear_interpolation", """WITH g AS (SELECT vec_id, unnest(embedding)::DOUBLE AS y, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), c AS (SELECT vec_id, i, y, lead(y) OVER (PARTITION BY vec_id ORDER BY i) AS y1 FROM g),
 p AS (SELECT vec_id, CAST(vec_id % 60 AS DOUBLE) + 0.25 AS x FROM embeddings) SELECT p.vec_id AS vec_id, round(y + (y1 - y) * (x - floor(x)), 6) AS value FROM p JOIN c ON p.vec_id = c.vec_id AND c.i = CAST(floor(x) AS BIGINT)""")
def linear_interpolation(spark, d):
    e = table(spark, d, "embeddings")
    g = e.select("vec_id", F.posexplode("embedding").alias("x", "y")).select("vec_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    p = e.select("vec_id", ((F.col("vec_id") % 60).cast("double") + 0.25).alias("x"))
    return ladders.interpolate(g, p, ["vec_id"], "x", "y", 1.0).select("vec_id", F.round("value", 6).alias("value"))


@query("batch_packing", """WITH RECURSIVE d AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
 f AS (SELECT source, doc_id, i, n_chars AS used, 0::BIGINT AS batch FROM d WHERE i = 1 UNION ALL SELECT d.source, d.doc_id, d.i, CASE WHEN f.used > 0 AND f.used + d.n_chars > 20000 THEN d.n_chars ELSE f.used + d.n_chars END, CASE WHEN f.used > 0 AND f.used + d.n_chars > 20000 THEN f.batch + 1 ELSE f.batch END FROM f JOIN d ON d.source = f.source AND d.i = f.i + 1)
 SELECT source, doc_id, batch FROM f""")
def batch_packing(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return ladders.greedy_batches(docs, "source", "doc_id", "n_chars", 20000).select("source", "doc_id", "batch")


@query("research_sequence", "WITH r AS (SELECT user_id, event_id, value <= lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS bad FROM events) SELECT user_id, NOT bool_or(coalesce(bad, false)) AS strictly_increasing, min(CASE WHEN bad THEN event_id END) AS first_failure FROM r GROUP BY user_id")
def research_sequence(spark, d):
    return ladders.monotone(by_user(spark, d), ["user_id"], "event_id", "value")


@query("adjacent_overlap", "WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice AS lo, o_totalprice + 5000 AS hi FROM orders) SELECT o_custkey, o_orderkey, coalesce(lag(hi) OVER (PARTITION BY o_custkey ORDER BY lo, hi) >= lo, false) AS overlaps FROM r")
def adjacent_overlap(spark, d):
    r = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("lo"), (F.col("o_totalprice") + 5000).alias("hi"))
    return ladders.adjacent_overlap(r, ["o_custkey"], "lo", "hi").select("o_custkey", "o_orderkey", "overlaps")


@query("partition_check", "SELECT l_orderkey, bool_and(l_linenumber = coalesce(p + 1, 1)) AS contiguous FROM (SELECT l_orderkey, l_linenumber, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS p FROM lineitem) GROUP BY l_orderkey")
def partition_check(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("end"), (F.col("l_linenumber") - 1).alias("start"))
    rows = rows.withColumn("ok", ladders.contiguous(rows, ["l_orderkey"], "start", "end"))
    whole = F.bool_and("ok") & (F.min("start") == 0)
    return rows.groupBy("l_orderkey").agg(whole.alias("contiguous"))


@query("convergence_summary", "SELECT event_type AS series, round(min(value), 6) AS least, round(median(value), 6) AS median, count(*) AS n FROM events GROUP BY event_type")
def convergence_summary(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("series")).agg(F.round(F.min("value"), 6).alias("least"), F.round(F.median("value"), 6).alias("median"), F.count("*").alias("n"))


@query("pairwise_sum", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings")
def pairwise_sum(spark, d):
    v = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.round(aggregates.pairwise(v), 6).alias("total"))


@query("chunked_sum", "SELECT l_suppkey AS id, round(sum(l_extendedprice), 3) AS total FROM lineitem GROUP BY l_suppkey")
def chunked_sum(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("i"), F.col("l_extendedprice").alias("v"))
    return aggregates.chunked_sum(li, ["id"], "i", "v", 4096).select("id", F.round("total", 3).alias("total"))


@query("dot_product", "SELECT round(sum(p_retailprice * s_acctbal), 2) AS dot FROM part JOIN supplier ON p_partkey = s_suppkey")
def dot_product(spark, d):
    x = table(spark, d, "part").select(F.col("p_partkey").alias("i"), F.col("p_retailprice").alias("x"))
    y = table(spark, d, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("y"))
    return aggregates.dot(x, y, "i", "x", "y").select(F.round("dot", 2).alias("dot"))


@query("atom_kernels", """SELECT z, l_returnflag AS family, CASE WHEN NOT bool_or(l_extendedprice = z) THEN round(sum(l_quantity / nullif(l_extendedprice - z, 0)), 6) END AS k1, CASE WHEN NOT bool_or(l_extendedprice = z) THEN round(sum(abs(l_quantity / nullif(power(l_extendedprice - z, 2), 0))), 8) END AS abs_k2,
 round(min(abs(l_extendedprice - z)), 4) AS nearest, count(*) AS atoms FROM lineitem, (SELECT n_nationkey * 4000.5 + 10 AS z FROM nation) GROUP BY 1, 2""")
def atom_kernels(spark, d):
    atoms = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("family"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("w"))
    points = table(spark, d, "nation").select((F.col("n_nationkey") * 4000.5 + 10).cast("double").alias("z"))
    out = aggregates.atom_kernels(atoms, points, ["family"], "x", "w", "z", (1, 2))
    return out.select("z", "family", F.round("k1", 6).alias("k1"), F.round("abs_k2", 8).alias("abs_k2"), F.round("nearest", 4).alias("nearest"), "atoms")


@query("cutoff_ladder", "SELECT cutoff, count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem JOIN (SELECT unnest([1000.0, 20000.0, 40000.0]::DOUBLE[]) AS cutoff) ON l_returnflag <> 'R' OR l_extendedprice <= cutoff GROUP BY cutoff")
def cutoff_ladder(spark, d):
    cuts = spark.range(1).select(F.explode(F.array(F.lit(1000.0), F.lit(20000.0), F.lit(40000.0))).alias("cutoff"))
    li = table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity")
    return aggregates.cutoff_ladder(li, F.broadcast(cuts), F.col("l_returnflag") == "R", "l_extendedprice", "cutoff", F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"))


@query("dedup_totals", """WITH h AS (SELECT sha256(text) AS h, octet_length(encode(text)) AS b, source FROM documents), t AS (SELECT DISTINCT h FROM h WHERE source IN ('src1', 'src2')), o AS (SELECT DISTINCT h FROM h WHERE source IN ('src0', 'src3'))
 SELECT CASE WHEN t.h IS NOT NULL THEN 'local' WHEN o.h IS NOT NULL THEN 'copy' ELSE 'upload' END AS class, count(*) AS objects, CAST(sum(b) AS BIGINT) AS bytes FROM h LEFT JOIN t ON h.h = t.h LEFT JOIN o ON h.h = o.h GROUP BY 1""")
def dedup_totals(spark, d):
    h = table(spark, d, "documents").select(F.sha2("text", 256).alias("h"), F.octet_length("text").alias("b"), "source")
    return aggregates.presence_totals(h, h.filter(F.col("source").isin("src1", "src2")), h.filter(F.col("source").isin("src0", "src3")), ["h"], "b")


@query("durability", """WITH c AS (SELECT l_partkey AS object, l_suppkey AS copy, n_regionkey AS domain FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)
 SELECT object, count(DISTINCT copy) AS copies, count(DISTINCT domain) AS domains, CASE WHEN count(DISTINCT copy) < 3 THEN 'copies' WHEN count(DISTINCT domain) < 2 THEN 'domains' END AS deficit FROM c GROUP BY object""")
def durability(spark, d):
    c = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(F.broadcast(table(spark, d, "nation")), F.col("n_nationkey") == F.col("s_nationkey"))
    copies, domains = F.count_distinct("l_suppkey"), F.count_distinct("n_regionkey")
    return c.groupBy(F.col("l_partkey").alias("object")).agg(copies.alias("copies"), domains.alias("domains"), F.when(copies < 3, "copies").when(domains < 2, "domains").alias("deficit"))


@query("error_budget", "SELECT l_orderkey AS id, CASE WHEN bool_and(l_returnflag <> 'N') THEN round(sum(abs(l_discount)), 4) END AS radius, count(*) FILTER (WHERE l_returnflag = 'N') AS unknown_axes FROM lineitem GROUP BY l_orderkey")
def error_budget(spark, d):
    out = aggregates.error_budget(table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "id"), ["id"], "l_discount", F.col("l_returnflag") != "N")
    return out.select("id", F.round("radius", 4).alias("radius"), "unknown_axes")


@query("hypothesis_score", """WITH s AS (SELECT d.source AS family, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN l.toxic = 1 THEN 'fail' WHEN l.quality = 0 THEN 'ineligible' ELSE 'pass' END AS status FROM documents d LEFT JOIN labels l USING (doc_id))
 SELECT family, CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'ineligible') THEN 'ineligible' WHEN bool_and(status = 'pass') THEN 'pass' ELSE 'unresolved' END AS verdict FROM s GROUP BY family""")
def hypothesis_score(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("source").alias("family")).join(table(spark, d, "labels"), "doc_id", "left")
    status = F.when(F.col("toxic").isNull(), "missing").when(F.col("toxic") == 1, "fail").when(F.col("quality") == 0, "ineligible").otherwise("pass")
    return aggregates.verdict(rows.withColumn("status", status), ["family"], "status", 1)


@query("performance_report", "SELECT event_type AS stage, user_id % 3 AS shape, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most FROM events GROUP BY 1, 2")
def performance_report(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("stage"), (F.col("user_id") % 3).alias("shape")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("shard_audit", "SELECT source AS shard, count(*) AS objects, count(DISTINCT text) AS unique_objects, CAST(sum(n_chars) AS BIGINT) AS logical, CAST((SELECT sum(n) FROM (SELECT DISTINCT text, n_chars AS n FROM documents x WHERE x.source = d.source)) AS BIGINT) AS unique_size FROM documents d GROUP BY source")
def shard_audit(spark, d):
    h = table(spark, d, "documents").select("source", F.sha2("text", 256).alias("h"), "n_chars")
    per = h.groupBy("source", "h").agg(F.count("*").alias("n"), F.max("n_chars").alias("size"))
    return per.groupBy(F.col("source").alias("shard")).agg(F.sum("n").alias("objects"), F.count("*").alias("unique_objects"), F.sum(F.col("n") * F.col("size")).cast("long").alias("logical"), F.sum("size").cast("long").alias("unique_size"))


@query("capacity_ledger", "SELECT s_suppkey AS shard, CAST(sum(l_quantity) AS BIGINT) AS used, CAST(sum(l_quantity) AS BIGINT) + 500 <= 16000 AS accepts FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY 1")
def capacity_ledger(spark, d):
    used = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("shard")).agg(F.sum("l_quantity").cast("long").alias("used"))
    return used.join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("shard")), "shard", "left_semi").withColumn("accepts", F.try_add("used", F.lit(500)) <= 16000)


@query("matched_triple", """WITH p AS (SELECT l_orderkey AS id, max(CASE WHEN l_linenumber = 1 THEN l_extendedprice END) AS a, max(CASE WHEN l_linenumber = 2 THEN l_extendedprice END) AS b, max(CASE WHEN l_linenumber = 3 THEN l_extendedprice END) AS c FROM lineitem GROUP BY 1) SELECT id, a, b, c, a < b AND b < c AS ordered FROM p WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL""")
def matched_triple(spark, d):
    pick = lambda k: F.max(F.when(F.col("l_linenumber") == k, F.col("l_extendedprice")))
    p = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(pick(1).alias("a"), pick(2).alias("b"), pick(3).alias("c")).dropna()
    return p.withColumn("ordered", (F.col("a") < F.col("b")) & (F.col("b") < F.col("c")))


@query("assurance_level", "SELECT l_orderkey AS id, CASE WHEN bool_and(l_returnflag = 'N') THEN 'certified' WHEN count(DISTINCT l_suppkey) >= 2 THEN 'cross_checked' ELSE 'computed' END AS level FROM lineitem GROUP BY 1")
def assurance_level(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.when(F.bool_and(F.col("l_returnflag") == "N"), "certified").when(F.count_distinct("l_suppkey") >= 2, "cross_checked").otherwise("computed").alias("level"))
