"""Queries of the index, gates and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates, index
from ..registry import query
from ..sources.tables import table

LINE_SQL = """(SELECT CAST(l_partkey AS VARCHAR) AS C, l_orderkey AS N, CAST(l_linenumber AS BIGINT) AS P, l_suppkey AS ordinal, k AS observable, v AS value
 FROM (SELECT *, unnest(['quantity', 'price', 'tail_1', 'tail_x']) AS k,
   unnest([CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR), '1', l_returnflag]) AS v FROM lineitem))"""


def measurements(spark, d):
    """Line items as measurements: a map of observables, of which decimals alone are kept."""
    li = table(spark, d, "lineitem")
    values = {
        "quantity": F.col("l_quantity").cast("long").cast("string"), "price": F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"),
        "tail_1": F.lit("1"), "tail_x": F.col("l_returnflag"),
    }
    keys = {"C": F.col("l_partkey").cast("string"), "N": F.col("l_orderkey"), "P": F.col("l_linenumber").cast("long"), "ordinal": F.col("l_suppkey")}
    return index.flatten_columns(li.withColumns(keys), list(keys), values, ["indexed:tail_"])


@query("packet_flatten", f"SELECT observable, count(*) AS n, sum(CAST(value AS BIGINT))::BIGINT AS total FROM {LINE_SQL} WHERE NOT regexp_matches(observable, '^tail_[0-9]+$') AND regexp_matches(value, '^[0-9]+$') GROUP BY observable")
def packet_flatten(spark, d):
    return measurements(spark, d).groupBy("observable").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("long")).alias("total"))


@query("index_query", f"SELECT * FROM {LINE_SQL} WHERE observable = 'price' AND P = 1 ORDER BY C, N, P, ordinal, observable LIMIT 200")
def index_query(spark, d):
    return index.index_query(measurements(spark, d), 200, observable="price", P=1)


@query("index_inventory", """SELECT source AS path, count(*) AS rows, CAST(sum(CAST('0x' || substr(sha256(text), 1, 8) AS BIGINT)) AS BIGINT) AS checksum,
 CASE WHEN bool_or(n_chars > 40000) THEN 'failed' ELSE 'indexed' END AS status, CASE WHEN bool_or(n_chars > 40000) THEN 'too large' END AS reason FROM documents GROUP BY source ORDER BY path LIMIT 200""")
def index_inventory(spark, d):
    """A source's rows are summed up by a checksum that no order changes, so none is gathered in one place."""
    docs = table(spark, d, "documents").select("source", "n_chars", F.conv(F.substring(F.sha2("text", 256), 1, 8), 16, 10).cast("long").alias("h"))
    big = F.bool_or(F.col("n_chars") > 40000)
    return docs.groupBy(F.col("source").alias("path")).agg(
        F.count("*").alias("rows"), F.sum("h").alias("checksum"), F.when(big, "failed").otherwise("indexed").alias("status"), F.when(big, "too large").alias("reason")
    ).orderBy("path").limit(200)


@query("field_policy", "SELECT p_type AS name, count(*) AS n FROM part WHERE NOT starts_with(p_type, 'ECO') GROUP BY p_type")
def field_policy(spark, d):
    return table(spark, d, "part").filter(index.allowed(F.col("p_type"), ["prefix:ECO"])).groupBy(F.col("p_type").alias("name")).agg(F.count("*").alias("n"))


GATE = """SELECT o_orderkey AS id, list_filter([CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'status' END, CASE WHEN o_totalprice > 200000 THEN 'quality' END,
 CASE WHEN o_orderdate < TIMESTAMP '1993-01-01' THEN 'too_old' END], lambda x: x IS NOT NULL) AS reasons FROM orders"""


@query("manifest_acceptance", f"SELECT array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS accepted, count(*) AS n FROM ({GATE}) GROUP BY ALL")
def manifest_acceptance(spark, d):
    out = gates.gated(
        table(spark, d, "orders"), ("status", ~F.col("o_orderstatus").isin("O", "F")), ("quality", F.col("o_totalprice") > 200000),
        ("too_old", F.col("o_orderdate") < F.lit("1993-01-01").cast("timestamp")),
    )
    return out.groupBy(F.array_join("reasons", ",").alias("reasons"), "accepted").agg(F.count("*").alias("n"))


@query("quality_satisfies", """WITH g(grade, rnk) AS (VALUES ('experimental', 0), ('candidate', 1), ('reviewed', 2), ('certified', 3), ('published', NULL), ('quarantined', NULL), ('deprecated', NULL))
 SELECT a.grade AS grade, b.grade AS least, CASE WHEN a.grade IN ('quarantined', 'deprecated') OR b.grade IN ('quarantined', 'deprecated') THEN false
 WHEN a.grade = 'published' OR b.grade = 'published' THEN a.grade = b.grade ELSE a.rnk >= b.rnk END AS satisfies FROM g a, g b""")
def quality_satisfies(spark, d):
    grades = [*gates.RANKS, "published", "quarantined", "deprecated"]
    one = spark.range(1).select(F.explode(F.array(*map(F.lit, grades))).alias("grade"))
    both = one.crossJoin(one.withColumnRenamed("grade", "least"))  # of the seven fixed grades
    return both.withColumn("satisfies", gates.quality_satisfies(F.col("grade"), F.col("least")))


@query("resource_feasibility", """SELECT l_orderkey AS id, k AS kind, v AS estimate, b AS bound FROM (SELECT l_orderkey, unnest(['quantity', 'price']) AS k, unnest([sum(l_quantity), round(sum(l_extendedprice), 2)]) AS v,
 unnest([200.0::DOUBLE, 250000.0::DOUBLE]) AS b FROM lineitem GROUP BY l_orderkey) WHERE v > b""")
def resource_feasibility(spark, d):
    per = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.sum("l_quantity").alias("quantity"), F.round(F.sum("l_extendedprice"), 2).alias("price"), F.count("*").cast("double").alias("rows")
    )
    return gates.limit_violations(per, "id", {"quantity": 200.0, "price": 250000.0, "rows": None})


@query("shard_can_accept", """SELECT p_partkey AS write, count(*) AS shards, min(s_suppkey) AS first_shard FROM part JOIN supplier ON s_suppkey % 5 = p_partkey % 5
 WHERE s_suppkey % 3 <> 0 AND (s_nationkey % 2 = p_size % 2) AND CAST(round(abs(s_acctbal)) AS BIGINT) + p_size * 100 <= 9000 GROUP BY 1""")
def shard_can_accept(spark, d):
    """Shards judge each kind of write once, whatever the number of writes of it; no shard lists kinds, so the type tells none apart."""
    part = table(spark, d, "part").select("p_partkey", "p_size", (F.col("p_partkey") % 5).alias("class"))
    both = part.select("class", "p_size").distinct().join(table(spark, d, "supplier").withColumn("class", F.col("s_suppkey") % 5), "class")
    ok = gates.shard_accepts(
        F.col("s_suppkey") % 3 != 0, F.col("s_nationkey") % 2, F.col("p_size") % 2, F.array().cast("array<string>"), F.lit("any"),
        F.round(F.abs("s_acctbal")).cast("long"), (F.col("p_size") * 100).cast("long"), F.lit(9000),
    )
    found = both.filter(ok).groupBy("class", "p_size").agg(F.count("*").alias("n"), F.min("s_suppkey").alias("first"))
    return part.join(found, ["class", "p_size"]).groupBy(F.col("p_partkey").alias("write")).agg(F.sum("n").alias("shards"), F.min("first").alias("first_shard"))


@query("observable_compatibility", """SELECT a.p_partkey AS id, CASE WHEN a.p_brand IS DISTINCT FROM b.p_brand THEN 'p_brand' WHEN a.p_type IS DISTINCT FROM b.p_type THEN 'p_type'
 WHEN a.p_size IS DISTINCT FROM b.p_size THEN 'p_size' END AS first_difference FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def observable_compatibility(spark, d):
    p = table(spark, d, "part")
    s = F.struct("p_brand", "p_type", "p_size")
    both = p.select("p_partkey", s.alias("a")).join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), s.alias("b")), "p_partkey")
    return both.select(F.col("p_partkey").alias("id"), gates.first_difference(["p_brand", "p_type", "p_size"]).alias("first_difference"))


@query("spectral_reach", "SELECT p_partkey AS id, round(2 * pi() * p_size / ln(p_retailprice), 6) AS reach, CAST(ceil(round(30 * ln(p_retailprice) / (2 * pi()), 9)) AS BIGINT) AS least_modes, p_size >= ceil(round(30 * ln(p_retailprice) / (2 * pi()), 9)) AS reaches FROM part")
def spectral_reach(spark, d):
    least = F.ceil(F.round(30 * F.log("p_retailprice") / (2 * F.pi()), 9)).cast("long")
    reach = F.round(2 * F.pi() * F.col("p_size") / F.log("p_retailprice"), 6)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), reach.alias("reach"), least.alias("least_modes"), (F.col("p_size") >= least).alias("reaches"))


@query("cutoff_decision", "SELECT CASE WHEN c_acctbal + 500 <= 4000 THEN 'satisfied' WHEN c_acctbal - 500 > 4000 THEN 'refuted' ELSE 'inconclusive' END AS decision, count(*) AS n FROM customer GROUP BY 1")
def cutoff_decision(spark, d):
    b = F.col("c_acctbal")
    return table(spark, d, "customer").groupBy(gates.cutoff_decision(b - 500, b + 500, F.lit(4000)).alias("decision")).agg(F.count("*").alias("n"))


@query("secret_free", r"SELECT source, count(*) AS n FROM documents WHERE regexp_matches(coalesce(text, ''), '(?i)(password|secret|api_key)\s*=') GROUP BY source")
def secret_free(spark, d):
    return table(spark, d, "documents").filter(F.col("text").rlike(r"(?i)(password|secret|api_key)\s*=")).groupBy("source").agg(F.count("*").alias("n"))


@query("phase_log", """SELECT event_type AS phase, count(*) AS calls, round(sum(value), 4) AS seconds, count(*) FILTER (WHERE value > 90) AS failures,
 CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS counter, arg_max(event_id, (ts, event_id)) AS last_event FROM events GROUP BY event_type""")
def phase_log(spark, d):
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.groupBy(F.col("event_type").alias("phase")).agg(
        F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("seconds"), F.count_if(F.col("value") > 90).alias("failures"),
        F.sum("k").alias("counter"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"),
    )


@query("jsonl_chunks", """WITH r AS (SELECT doc_id, sha256(text) AS h, octet_length(encode(text)) AS b, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS chunk FROM documents)
 SELECT CAST(chunk AS BIGINT) AS chunk, count(*) AS n, CAST(sum(b) AS BIGINT) AS bytes, sha256(string_agg(h, '' ORDER BY doc_id)) AS digest FROM r GROUP BY chunk""")
def jsonl_chunks(spark, d):
    """Chunks of 64 rows in id order: ids are ranked by range partition and count before it, not in one window."""
    from ..operators.ranks import dense_position

    rows = dense_position(table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"), F.octet_length("text").alias("b")), "doc_id")
    rows = rows.withColumn("chunk", F.floor(F.col("position") / 64))
    digest = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "h"))), lambda x: x["h"]), ""), 256)
    return rows.groupBy("chunk").agg(F.count("*").alias("n"), F.sum("b").cast("long").alias("bytes"), digest.alias("digest"))


@query("unreferenced_objects", "SELECT c_custkey AS object FROM customer EXCEPT ALL SELECT DISTINCT o_custkey FROM orders")
def unreferenced_objects(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("object")).join(table(spark, d, "orders"), F.col("object") == F.col("o_custkey"), "left_anti")


@query("inventory_equality", "SELECT (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS missing, (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) AS unexpected")
def inventory_equality(spark, d):
    a, b = table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    both = a.withColumn("e", F.lit(1)).unionByName(b.withColumn("e", F.lit(2))).groupBy("k").agg(F.bit_or("e").alias("e"))
    return both.agg(F.count_if(F.col("e") == 1).alias("missing"), F.count_if(F.col("e") == 2).alias("unexpected"))


@query("distinct_across_layers", "SELECT k, min(layer) AS layer FROM (SELECT c_nationkey AS k, 1 AS layer FROM customer UNION ALL SELECT s_nationkey, 0 FROM supplier) GROUP BY k")
def distinct_across_layers(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.lit(1).alias("layer"))
    return c.unionByName(table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.lit(0).alias("layer"))).groupBy("k").agg(F.min("layer").alias("layer"))


@query("shared_intermediates", "SELECT p_partkey AS id, len(list_intersect(list_transform(string_split(p_name, ' '), lambda x: lower(trim(x))), list_transform(string_split(p_type, ' '), lambda x: lower(trim(x))))) = 0 AS independent FROM part")
def shared_intermediates(spark, d):
    words = lambda c: F.transform(F.split(c, " "), lambda x: F.lower(F.trim(x)))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.size(F.array_intersect(words("p_name"), words("p_type"))) == 0).alias("independent"))


@query("interval_hull", """SELECT o_custkey AS id, min(o_totalprice - 1000) AS hull_lo, max(o_totalprice + 1000) AS hull_hi,
 CASE WHEN max(o_totalprice - 50000) <= min(o_totalprice + 50000) THEN max(o_totalprice - 50000) END AS cut_lo, CASE WHEN max(o_totalprice - 50000) <= min(o_totalprice + 50000) THEN min(o_totalprice + 50000) END AS cut_hi FROM orders GROUP BY o_custkey""")
def interval_hull(spark, d):
    t = F.col("o_totalprice")
    lo, hi = F.max(t - 50000), F.min(t + 50000)
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(
        F.min(t - 1000).alias("hull_lo"), F.max(t + 1000).alias("hull_hi"), F.when(lo <= hi, lo).alias("cut_lo"), F.when(lo <= hi, hi).alias("cut_hi")
    )


@query("csv_escape", """SELECT doc_id, CASE WHEN regexp_matches(text, '[",\n\r]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS cell FROM documents""")
def csv_escape(spark, d):
    from ..functions.text import csv_cell

    return table(spark, d, "documents").select("doc_id", csv_cell(F.col("text")).alias("cell"))
