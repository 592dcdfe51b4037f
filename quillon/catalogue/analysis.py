"""Queries of publication tables, audits, transforms, forms and finite pipelines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..operators import dag, forms, generators, linalg, roots
from ..registry import query
from ..sources import store
from ..sources.tables import table


@query("latex_escape", r"SELECT p_partkey AS id, replace(replace(replace(replace(p_brand || '_' || p_type || '&%', '&', '\&'), '%', '\%'), '#', '\#'), '_', '\_') AS cell FROM part")
def latex_escape(spark, d):
    cell = text.latex_cell(F.concat("p_brand", F.lit("_"), "p_type", F.lit("&%")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), cell.alias("cell"))


@query("publication_table", """SELECT event_type AS series, CAST(date_trunc('day', ts) AS DATE) AS cutoff, round(min(value), 6) AS least, round(median(value), 6) AS median, 'events' AS provenance FROM events GROUP BY 1, 2""")
def publication_table(spark, d):
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("series"), F.to_date("ts").alias("cutoff"))
    return e.agg(F.round(F.min("value"), 6).alias("least"), F.round(F.median("value"), 6).alias("median")).withColumn("provenance", F.lit("events"))


@query("fetch_missing", "SELECT sha256(text) AS digest FROM documents WHERE source = 'src1' EXCEPT SELECT sha256(text) FROM documents WHERE source <> 'src1'")
def fetch_missing(spark, d):
    docs = table(spark, d, "documents").select("source", F.sha2("text", 256).alias("digest"))
    return store.missing(docs.filter("source = 'src1'").select("digest").distinct(), docs.filter("source <> 'src1'"))


@query("stream_split", "SELECT doc_id, CAST(k AS INT) AS seq, CAST(k * 1000 AS BIGINT) AS start, CAST(least(1000, n_chars - k * 1000) AS BIGINT) AS length FROM documents, LATERAL (SELECT unnest(range(0, greatest(1, CAST(ceil(n_chars / 1000.0) AS BIGINT)))) AS k)")
def stream_split(spark, d):
    return store.parts(table(spark, d, "documents"), "doc_id", "n_chars", 1000)


@query("package_verify", "SELECT coalesce(a.k, b.k) AS path, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'unexpected' WHEN a.s <> b.s THEN 'size' END AS problem FROM (SELECT c_custkey AS k, c_nationkey AS s FROM customer) a FULL JOIN (SELECT o_custkey AS k, CAST(max(o_orderkey) % 25 AS INT) AS s FROM orders GROUP BY 1) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.s <> b.s")
def package_verify(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("path"), F.col("c_nationkey").alias("bytes"), F.lit("x").alias("digest"))
    b = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("path")).agg((F.max("o_orderkey") % 25).cast("int").alias("bytes")).withColumn("digest", F.lit("x"))
    return store.verify(a, b)


@query("kind_family", "SELECT r_name AS family, count(*) AS kinds, min(n_name) AS first_kind FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def kind_family(spark, d):
    both = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 5 regions
    return both.groupBy(F.col("r_name").alias("family")).agg(F.count("*").alias("kinds"), F.min("n_name").alias("first_kind"))


@query("registration_audit", "SELECT p_type AS kind, 'missing' AS problem FROM (SELECT DISTINCT p_type FROM part WHERE p_size < 25 EXCEPT SELECT DISTINCT p_type FROM part WHERE p_brand = 'Brand#11') UNION ALL SELECT p_type, 'unexpected' FROM (SELECT DISTINCT p_type FROM part WHERE p_brand = 'Brand#11' EXCEPT SELECT DISTINCT p_type FROM part WHERE p_size < 25)")
def registration_audit(spark, d):
    p = table(spark, d, "part")
    both = p.groupBy(F.col("p_type").alias("kind")).agg(F.bool_or(F.col("p_size") < 25).alias("a"), F.bool_or(F.col("p_brand") == "Brand#11").alias("b"))
    return both.filter("a <> b").select("kind", F.when(F.col("a"), "missing").otherwise("unexpected").alias("problem"))


@query("admission_closure", "SELECT o_orderkey AS root, c_acctbal >= 0 AND n_regionkey < 4 AS admitted FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def admission_closure(spark, d):
    """A root is admitted if all it depends on is."""
    from .numeric import edges

    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias("node")
    bad = table(spark, d, "customer").filter("c_acctbal < 0").select(name("c", "c_custkey")).unionByName(table(spark, d, "region").filter("r_regionkey >= 4").select(name("r", "r_regionkey")))
    roots_ = table(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("root"))
    reach = dag.closure(edges(spark, d), roots_).join(bad.withColumn("bad", F.lit(True)), "node", "left")
    out = reach.groupBy("root").agg((~F.bool_or(F.coalesce("bad", F.lit(False)))).alias("admitted"))
    return out.select(F.substring("root", 2, 20).cast("long").alias("root"), "admitted")


@query("cache_duplication_audit", "SELECT event_id AS id, user_id AS semantic FROM events WHERE event_type = 'view' AND value < 10")
def cache_duplication_audit(spark, d):
    return table(spark, d, "events").filter("event_type = 'view' AND value < 10").select(F.col("event_id").alias("id"), F.col("user_id").alias("semantic"))


@query("output_totals", "SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS matched, count(*) FILTER (WHERE o_orderstatus = 'O') AS mismatched, count(*) FILTER (WHERE o_orderstatus = 'P') AS absent FROM orders")
def output_totals(spark, d):
    is_ = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return table(spark, d, "orders").agg(is_("F").alias("matched"), is_("O").alias("mismatched"), is_("P").alias("absent"))


@query("corpus_acceptance", "SELECT source AS shard, count(*) AS objects, CAST(sum(n_chars) AS BIGINT) AS size, sum(n_chars) > 150000 AS rolls_over, max(n_chars) <= 100000 AS within FROM documents GROUP BY source")
def corpus_acceptance(spark, d):
    n = F.col("n_chars")
    return table(spark, d, "documents").groupBy(F.col("source").alias("shard")).agg(F.count("*").alias("objects"), F.sum(n).alias("size"), (F.sum(n) > 150000).alias("rolls_over"), (F.max(n) <= 100000).alias("within"))


@query("source_matching", "SELECT l_orderkey AS manifest, count(*) FILTER (WHERE p_partkey IS NULL) AS absent FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 45) ON l_partkey = p_partkey GROUP BY 1")
def source_matching(spark, d):
    p = table(spark, d, "part").filter("p_size < 45").select("p_partkey")
    both = table(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"), "left")
    return both.groupBy(F.col("l_orderkey").alias("manifest")).agg(F.count_if(F.col("p_partkey").isNull()).alias("absent"))


@query("prefix_observations", "SELECT l_orderkey AS matrix, l_linenumber AS dimension, k AS observable, round(v, 4) AS value FROM (SELECT l_orderkey, l_linenumber, unnest(['quantity', 'price', 'discount']) AS k, unnest([l_quantity, l_extendedprice, l_discount]) AS v FROM lineitem)")
def prefix_observations(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("matrix"), F.col("l_linenumber").alias("dimension"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"))
    return li.unpivot(["matrix", "dimension"], ["quantity", "price", "discount"], "observable", "value").withColumn("value", F.round("value", 4))


@query("prefix_ladder", "SELECT n_nationkey AS matrix_id, CAST(k AS BIGINT) AS dimension, round((k + 1) / k::DOUBLE, 9) AS pivot FROM nation, (SELECT unnest(range(1, 13)) AS k) WHERE k <= 5 + n_nationkey % 8")
def prefix_ladder(spark, d):
    """Pivots of second differences are (k + 1) / k."""
    from .numeric import laplacians

    return forms.prefix_pivots(laplacians(spark, d)).select("matrix_id", "dimension", F.round("pivot", 9).alias("pivot"))


@query("truncated_transform", """WITH u AS (SELECT exp(-ln(4.0::DOUBLE) + k * (2 * ln(4.0::DOUBLE) / 2000)) AS u, CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * (2 * ln(4.0::DOUBLE) / 2000) / 3 AS w FROM (SELECT unnest(range(0, 2001)) AS k)),
 s AS (SELECT DISTINCT p_size, p_size / 50.0::DOUBLE AS sigma, p_size / 10.0::DOUBLE AS tau FROM part),
 v AS (SELECT p_size, sum(w * u * exp((sigma - 1) * ln(u)) * cos(tau * ln(u)) * (u * exp(-u) / power(1 + exp(-u), 2))) AS re, sum(w * u * exp((sigma - 1) * ln(u)) * sin(tau * ln(u)) * (u * exp(-u) / power(1 + exp(-u), 2))) AS im FROM s, u GROUP BY 1)
 SELECT p_partkey AS id, round(re, 7) AS re, round(im, 7) AS im FROM part JOIN v USING (p_size)""")
def truncated_transform(spark, d):
    """The integral of u^(s-1) omega(u) over [1/4, 4] by 64 nodes; the SQL takes Simpson's rule in ln u."""
    from ..operators import transforms

    s = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 50.0).alias("sigma"), (F.col("p_size") / 10.0).alias("tau"))
    return transforms.truncated(s, "id", "sigma", "tau", 4.0, 64).select("id", F.round("re", 7).alias("re"), F.round("im", 7).alias("im"))


@query("omega_transform_even", "SELECT round(sum(w * t * exp(-t) / power(1 + exp(-t), 2)), 8) AS integral FROM (SELECT k * 0.01 AS t, CASE WHEN k IN (0, 1000) THEN 0.005 ELSE 0.01 END AS w FROM (SELECT unnest(range(0, 1001)) AS k))")
def omega_transform_even(spark, d):
    return generators.grid(spark, 0.0, 10.0, 1000).agg(F.round(F.sum(F.col("weight") * numbers.omega(F.col("x"))), 8).alias("integral"))


@query("weighted_distance", "SELECT user_id, round(sqrt(sum(abs(value - 50) * abs(value - 50) * exp(-event_id / 10000.0))), 5) AS distance FROM events GROUP BY user_id")
def weighted_distance(spark, d):
    gap = F.abs(F.col("value") - 50)
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.sqrt(F.sum(gap * gap * F.exp(-F.col("event_id") / 10000.0))), 5).alias("distance"))


@query("profile_overlap", "SELECT a.vec_id AS id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS overlap FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def profile_overlap(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    both = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return both.select(F.col("vec_id").alias("id"), F.round(dot("x", "y") / F.sqrt(dot("x", "x") * dot("y", "y")), 6).alias("overlap"))


@query("state_geometry", "SELECT vec_id AS id, round(list_sum(list_transform(range(0, 64), lambda i: (i - 31.5) * (i - 31.5) * power(embedding[i + 1]::DOUBLE, 2))) / list_sum(list_transform(embedding, lambda x: power(x::DOUBLE, 2))), 5) AS second_moment FROM embeddings")
def state_geometry(spark, d):
    sq = F.transform("embedding", lambda x, i: F.pow(x.cast("double"), 2.0))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    moment = F.transform("embedding", lambda x, i: (i - 31.5) * (i - 31.5) * F.pow(x.cast("double"), 2.0))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.round(total(moment) / total(sq), 5).alias("second_moment"))


@query("profile_scale", "SELECT user_id, round(sum(value * (event_id % 13)) / nullif(sum(power(event_id % 13, 2)), 0), 6) AS scale FROM events GROUP BY user_id")
def profile_scale(spark, d):
    """Least-squares scale between two profiles."""
    k = (F.col("event_id") % 13).cast("double")
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.try_divide(F.sum(F.col("value") * k), F.sum(k * k)), 6).alias("scale"))


@query("simplex_forms", """SELECT concat_ws(',', a, b, c) AS index, round(factorial(a)::DOUBLE * factorial(b) * factorial(c) / factorial(a + b + c + 3), 12) AS moment, 0 AS gap
 FROM (SELECT unnest(range(0, 5))::INT AS a), (SELECT unnest(range(0, 5))::INT AS b), (SELECT unnest(range(0, 5))::INT AS c) WHERE a + b + c <= 4""")
def simplex_forms(spark, d):
    """Monomial moments over the simplex (product of factorials over the factorial of the sum) against one integral an axis."""
    got = forms.simplex_moments(generators.multi_indices(spark, 3, 4))
    a, b, c = (F.col("index")[k] for k in range(3))
    want = _power_integral(a, b + c + 2) * _power_integral(b, c + 1) * _power_integral(c, F.lit(0))
    gap = F.round(F.abs(F.col("moment") / want - 1), 6).cast("int")
    return got.select("index", F.round("moment", 12).alias("moment"), gap.alias("gap")).withColumn("index", F.array_join(F.col("index").cast("array<string>"), ","))


def _power_integral(p, m):
    """Integral of x^p (1 - x)^m over [0, 1], by the binomial series."""
    fact = lambda x: F.factorial(x.cast("int")).cast("double")
    terms = F.transform(F.sequence(F.lit(0), m), lambda k: F.pow(F.lit(-1.0), k) * fact(m) / fact(k) / fact(m - k) / (p + k + 1))
    return F.aggregate(terms, F.lit(0.0), lambda x, t: x + t)


@query("rank_one_spectrum")
def rank_one_spectrum(spark, d):
    """Diagonal plus rank one for each nation; interlacing is tested against dense spectra."""
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("matrix_id"), (F.col("s_acctbal") / 1000).alias("d"), F.lit(0.5).alias("u"), F.lit(0.7).alias("alpha"))
    return roots.rank_one_spectrum(s, "matrix_id").select("matrix_id", "ordinal", F.round("value", 8).alias("value"))


@query("rank_one_equal_diagonal", """WITH n AS (SELECT s_nationkey AS matrix_id, count(*) AS n, sum(power(s_suppkey % 7 + 1, 2)) AS u2 FROM supplier GROUP BY 1)
 SELECT matrix_id, CAST(k AS BIGINT) AS ordinal, round(CASE WHEN k = n - 1 THEN 2 + 0.7 * u2 ELSE 2 END, 6) AS value FROM n, (SELECT unnest(range(0, 1000)) AS k) WHERE k < n""")
def rank_one_equal_diagonal(spark, d):
    """2 I + 0.7 u u^T has all but one eigenvalue 2, and that is 2 + 0.7 |u|^2."""
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("matrix_id"), F.lit(2.0).alias("d"), (F.col("s_suppkey") % 7 + 1.0).alias("u"), F.lit(0.7).alias("alpha"))
    return roots.rank_one_spectrum(s, "matrix_id").select("matrix_id", "ordinal", F.round("value", 6).alias("value"))


@query("finite_form_pipeline")
def finite_form_pipeline(spark, d):
    """Prime powers to roots for several cutoffs, one form a group."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        found, _, least = roots.finite_form(int(key[0]), 12)
        return pd.DataFrame({"cutoff": key[0], "ordinal": range(len(found)), "root": found.round(6), "eigenvalue": round(least, 6)})

    cuts = spark.range(1).select(F.explode(F.array(*[F.lit(c).cast("long") for c in (10, 30, 100, 300)])).alias("cutoff"))
    return cuts.groupBy("cutoff").applyInPandas(run, "cutoff long, ordinal long, root double, eigenvalue double")


@query("gram_spectrum", """WITH g AS (SELECT i, j, sum(x[i + 1]::DOUBLE * x[j + 1]::DOUBLE) AS v FROM (SELECT embedding AS x FROM embeddings), (SELECT unnest(range(0, 64)) AS i), (SELECT unnest(range(0, 64)) AS j) GROUP BY i, j)
 SELECT count(DISTINCT i) AS n, round(sum(CASE WHEN i = j THEN v END), 4) AS trace, round(sum(v * v), 2) AS squares FROM g""")
def gram_spectrum(spark, d):
    """The Gram matrix's eigenvalues add up to its trace, and their squares to the squares of its entries."""
    g = linalg.gram(table(spark, d, "embeddings"), "vec_id", "embedding")
    w = linalg.eigenvalues(g.withColumn("matrix_id", F.lit(0)))
    return w.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("trace"), F.round(F.sum(F.col("value") * F.col("value")), 2).alias("squares"))


@query("stored_vector_chunks", "SELECT CAST(vec_id // 100 AS BIGINT) AS chunk, count(*) AS n, round(sum(list_sum(list_transform(embedding, lambda x: x::DOUBLE))), 4) AS total FROM embeddings GROUP BY 1")
def stored_vector_chunks(spark, d):
    s = F.aggregate(F.transform("embedding", lambda x: x.cast("double")), F.lit(0.0), lambda a, v: a + v)
    return table(spark, d, "embeddings").groupBy(F.floor(F.col("vec_id") / 100).alias("chunk")).agg(F.count("*").alias("n"), F.round(F.sum(s), 4).alias("total"))


@query("error_classes", "SELECT l_orderkey AS id, array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS classes FROM lineitem GROUP BY 1")
def error_classes(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("classes"))


@query("root_transfer", "SELECT l_orderkey AS id, l_linenumber AS ordinal, round(l_extendedprice - (l_extendedprice * l_extendedprice - 2e9) / (2 * l_extendedprice), 4) AS moved FROM lineitem")
def root_transfer(spark, d):
    x = F.col("l_extendedprice")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("ordinal"), F.round(x - (x * x - 2e9) / (2 * x), 4).alias("moved"))
