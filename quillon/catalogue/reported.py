"""Queries of acceptance with warnings, durability, capacity, scores, phase reports and lookups by identity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports
from ..registry import query
from ..sources.tables import table


def version(major, minor, patch):
    return F.struct(*[c.cast("int").alias(n) for c, n in zip((major, minor, patch), ("major", "minor", "patch"), strict=True)])


@query("manifest_policy", """WITH m AS (SELECT o_orderkey AS id, o_orderkey % 3 + 1 AS s, (o_custkey % 4, o_orderkey % 5, 0) AS lo, CASE WHEN o_orderkey % 6 = 0 THEN (2, o_custkey % 7, 0) END AS hi,
  (o_orderkey % 3, 0, 0) AS p, CASE WHEN o_orderstatus = 'O' THEN (1, 0, 0) END AS floor, o_orderpriority = '5-LOW' AS private,
  CASE o_orderkey % 7 WHEN 0 THEN 'deprecated' WHEN 1 THEN 'quarantined' WHEN 2 THEN 'published' WHEN 3 THEN 'candidate' ELSE 'certified' END AS q FROM orders),
 r AS (SELECT id, q, list_filter([CASE WHEN floor IS NOT NULL AND p < floor THEN 'producer_precedes_floor' END, CASE WHEN s = 3 THEN 'schema_version' END, CASE WHEN (2, 3, 0) < lo THEN 'reader_too_old' END,
  CASE WHEN hi IS NOT NULL AND (2, 3, 0) > hi THEN 'reader_too_new' END, CASE WHEN private THEN 'visibility' END, CASE WHEN q = 'quarantined' THEN 'quarantined' END,
  CASE WHEN q <> 'certified' THEN 'quality' END], lambda x: x IS NOT NULL) AS reasons FROM m)
 SELECT id, array_to_string(reasons, ',') AS reasons, CASE WHEN q = 'deprecated' THEN 'deprecated_without_evidence' ELSE '' END AS warnings, len(reasons) = 0 AS accepted FROM r""")
def manifest_policy(spark, d):
    """Orders as manifests under a policy that lets deprecated ones through to the quality check."""
    k, c, zero = F.col("o_orderkey"), F.col("o_custkey"), F.lit(0)
    m = table(spark, d, "orders").select(
        k.alias("id"), (k % 3 + 1).alias("schema_version"), version(c % 4, k % 5, zero).alias("minimum_reader"), F.when(k % 6 == 0, version(F.lit(2), c % 7, zero)).alias("maximum_reader"),
        version(k % 3, zero, zero).alias("producer"), F.when(F.col("o_orderstatus") == "O", version(F.lit(1), zero, zero)).alias("producer_floor"),
        F.when(F.col("o_orderpriority") == "5-LOW", "private").otherwise("public").alias("visibility"),
        F.element_at(F.array(*map(F.lit, ["deprecated", "quarantined", "published", "candidate", "certified", "certified", "certified"])), (k % 7 + 1).cast("int")).alias("quality"),
    )
    out = reports.accepted(m, [1, 2], (2, 3, 0), ["public"], "reviewed", allow_deprecated=True)
    return out.select("id", F.array_join("reasons", ",").alias("reasons"), F.array_join("warnings", ",").alias("warnings"), "accepted")


COPIES = """c AS (SELECT l_partkey AS object, l_orderkey * 8 + l_linenumber AS seq, l_suppkey AS copy, s_nationkey AS locator, n_regionkey AS domain,
  CASE WHEN l_returnflag = 'R' THEN 'returned' WHEN l_quantity < 5 THEN 'short' END AS bad FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey),
 g AS (SELECT *, row_number() OVER (PARTITION BY object, copy ORDER BY seq) AS a, row_number() OVER (PARTITION BY object, locator ORDER BY seq) AS b FROM c WHERE bad IS NULL)"""


def part_copies(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    li = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(n, F.col("n_nationkey") == F.col("s_nationkey"))
    return li.select(
        F.col("l_partkey").alias("object"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), F.col("l_suppkey").alias("copy"), F.col("s_nationkey").alias("locator"),
        F.col("n_regionkey").alias("domain"), F.lit(False).alias("archived"), "l_returnflag", "l_quantity",
    )


def assessed(spark, d):
    return reports.durability(part_copies(spark, d), [("returned", F.col("l_returnflag") == "R"), ("short", F.col("l_quantity") < 5)], 3, 2)


@query("durability_assessment", f"""WITH {COPIES}, k AS (SELECT object, count(*) AS copies, count(DISTINCT domain) AS domains FROM g WHERE a = 1 AND b = 1 GROUP BY 1)
 SELECT object, coalesce(copies, 0) AS copies, coalesce(domains, 0) AS domains, array_to_string(list_filter([CASE WHEN coalesce(copies, 0) < 3 THEN 'copies' END, CASE WHEN coalesce(domains, 0) < 2 THEN 'domains' END], lambda x: x IS NOT NULL), ',') AS deficits
 FROM (SELECT DISTINCT object FROM c) LEFT JOIN k USING (object)""")
def durability_assessment(spark, d):
    """Parts with their suppliers as copies: what is refused or repeats counts for nothing."""
    return assessed(spark, d)[0].select("object", "copies", "domains", F.array_join("deficits", ",").alias("deficits"))


@query("refused_copies", f"""WITH {COPIES} SELECT reason, count(*) AS n FROM (SELECT bad AS reason FROM c WHERE bad IS NOT NULL
 UNION ALL SELECT CASE WHEN a > 1 THEN 'copy_repeats' ELSE 'locator_repeats' END FROM g WHERE a > 1 OR b > 1) GROUP BY 1""")
def refused_copies(spark, d):
    return assessed(spark, d)[1].groupBy("reason").agg(F.count("*").alias("n"))


@query("capacity_assessment", "SELECT l_suppkey AS shard, CAST(sum(l_quantity) AS BIGINT) AS used, CAST(sum(l_quantity) AS BIGINT) + l_suppkey * 10 AS projected, CAST(sum(l_quantity) AS BIGINT) + l_suppkey * 10 <= 15500 AS accepts FROM lineitem GROUP BY 1")
def capacity_assessment(spark, d):
    used = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("shard")).agg(F.sum("l_quantity").cast("long").alias("used"))
    return reports.capacity(used, F.col("shard") * 10, F.lit(15500))


@query("output_report", """SELECT o_orderpriority AS family, count(*) FILTER (WHERE o_orderstatus = 'F') AS matched, count(*) FILTER (WHERE o_orderstatus = 'O') AS mismatched, count(*) FILTER (WHERE o_orderstatus = 'P') AS absent,
 count(*) FILTER (WHERE o_totalprice > 100000) AS recomputed, count(*) FILTER (WHERE o_totalprice <= 100000) AS reused, min(o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS first_mismatch FROM orders GROUP BY 1""")
def output_report(spark, d):
    status = F.element_at(F.create_map(*map(F.lit, ["F", "match", "O", "mismatch", "P", "absent"])), F.col("o_orderstatus"))
    rows = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("family"), status.alias("status"), F.when(F.col("o_totalprice") > 100000, "recomputed").otherwise("reused").alias("origin")
    )
    return reports.output_totals(rows, ["family"])


@query("frozen_scores", """WITH o AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 'fail' WHEN 'A' THEN 'ineligible' ELSE 'pass' END AS status, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS nth FROM lineitem),
 r AS (SELECT o_custkey AS family, status FROM orders LEFT JOIN (SELECT * FROM o WHERE nth = 1) ON l_orderkey = o_orderkey)
 SELECT family, count(*) AS cases, count(*) FILTER (WHERE status = 'pass') AS passed, CASE WHEN bool_or(coalesce(status = 'fail', false)) THEN 'fail' WHEN bool_or(coalesce(status = 'ineligible', false)) THEN 'ineligible' WHEN bool_and(coalesce(status = 'pass', false)) THEN 'pass' ELSE 'unresolved' END AS verdict FROM r GROUP BY 1""")
def frozen_scores(spark, d):
    """Orders as frozen cases of a customer's hypothesis, their first line as the observation; of lines with one number the one that is stored first."""
    cases = table(spark, d, "orders").select(F.col("o_custkey").alias("family"), F.col("o_orderkey").alias("case"))
    status = F.when(F.col("l_returnflag") == "R", "fail").when(F.col("l_returnflag") == "A", "ineligible").otherwise("pass")
    seen = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case"), F.struct("l_linenumber", "_metadata.file_path", "_metadata.row_index").alias("seq"), status.alias("status"))
    return reports.scored(cases, seen)[0]


@query("phase_report", """SELECT user_id AS attempt, event_type AS phase, count(*) AS calls, round(sum(value), 4) AS seconds, count(*) FILTER (WHERE value > 90) AS failures,
 CAST(sum(coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0)) AS BIGINT) AS bytes FROM events WHERE value >= 0 GROUP BY 1, 2""")
def phase_report(spark, d):
    details = F.map_from_arrays(F.array(F.lit("sent_bytes"), F.lit("rows")), F.array(F.coalesce(F.get_json_object("props", "$.k"), F.lit("")), F.lit("7")))
    e = table(spark, d, "events").select(
        F.col("user_id").alias("attempt"), F.col("event_id").alias("line"), F.col("event_type").alias("phase"), F.when(F.col("value") > 90, "failed").otherwise("done").alias("outcome"),
        F.col("value").alias("seconds"), details.alias("details"),
    )
    return reports.phase_statistics(e, ["attempt"])[0].withColumn("seconds", F.round("seconds", 4))


@query("latest_checkpoints", "SELECT user_id AS attempt, arg_max(event_type, (ts, event_id)) AS phase, CASE WHEN arg_max(value, (ts, event_id)) > 50 THEN 'pending' ELSE 'done' END AS outcome, count(*) AS seen FROM events GROUP BY 1")
def latest_checkpoints(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("attempt"), "ts", "event_id", F.col("event_type").alias("phase"), F.when(F.col("value") > 50, "pending").otherwise("done").alias("outcome"))
    return reports.latest(e, ["attempt"], ["ts", "event_id"])


@query("source_report", "SELECT l_orderkey AS manifest, count(*) AS declared, count(*) FILTER (WHERE p_partkey IS NULL) AS absent, count(*) FILTER (WHERE p_size % 10 <> l_linenumber % 10) AS differing, bool_and(p_partkey IS NOT NULL AND p_size % 10 = l_linenumber % 10) AS matches FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 45) ON l_partkey = p_partkey GROUP BY 1")
def source_report(spark, d):
    p = table(spark, d, "part").filter("p_size < 45").select(F.col("p_partkey").alias("source"), (F.col("p_size") % 10).cast("string").alias("digest"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("manifest"), F.col("l_partkey").alias("source"), (F.col("l_linenumber") % 10).cast("string").alias("digest"))
    return reports.source_matches(li, p)


@query("superseded_documents", "SELECT a.doc_id AS id, b.doc_id AS replacement FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id + 1 AND b.source = a.source")
def superseded_documents(spark, d):
    """A document is replaced by the next one of its source, if that is the next one at all."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), "source", F.col("doc_id").alias("replacement"))
    return reports.superseded(docs, after, ["doc_id", "source"]).select(F.col("doc_id").alias("id"), "replacement")


@query("identity_report", "WITH h AS (SELECT o_custkey AS c, o_orderpriority AS p, count(*) AS n, min(o_orderkey) AS k FROM orders GROUP BY 1, 2), w AS (SELECT c_custkey AS c, p FROM customer, (SELECT unnest(['1-URGENT', '5-LOW']) AS p)) SELECT w.c AS family, w.p AS semantic, CASE WHEN n = 1 THEN k END AS artifact, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'found' END AS found FROM w LEFT JOIN h ON h.c = w.c AND h.p = w.p")
def identity_report(spark, d):
    held = table(spark, d, "orders").select(F.col("o_custkey").alias("family"), F.col("o_orderpriority").alias("semantic"), F.col("o_orderkey").alias("artifact"))
    wanted = table(spark, d, "customer").select(F.col("c_custkey").alias("family"), F.explode(F.array(F.lit("1-URGENT"), F.lit("5-LOW"))).alias("semantic"))
    return reports.by_identity(wanted, held, ["family", "semantic"])


@query("first_configurations", "SELECT target, config, ordinal FROM (SELECT p_brand AS target, p_partkey AS config, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS INT) AS ordinal FROM part) WHERE ordinal <= 3")
def first_configurations(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("target"), F.col("p_partkey").alias("config"), "p_retailprice")
    return reports.first_of_targets(p, "target", ["p_retailprice", "config"], 3).select("target", "config", "ordinal")


@query("convergence_report", "SELECT user_id AS series, count(value) AS n, min(value) AS least, round(median(value), 6) AS median, max(value) AS most, CAST(0 AS BIGINT) AS unresolved FROM events GROUP BY 1")
def convergence_report(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("series"), "value")
    return reports.convergence(e, ["series"]).withColumn("median", F.round("median", 6))
