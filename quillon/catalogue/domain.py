"""Queries of states, special matrices, captured runs, planners and plug-ins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .. import plugins
from ..operators import generators, governance, linalg, roots, states
from ..plans import capture
from ..registry import query
from ..sources import work
from ..sources.tables import table
from .numeric import laplacians


@query("weighted_norm", "SELECT p_size AS size, round(sum(w * abs(sin(p_size * x)) / sqrt(x)), 8) AS norm, round(sum(w * abs(sin(p_size * x) - x) / sqrt(x)), 8) AS distance FROM (SELECT DISTINCT p_size FROM part), (SELECT 1 + 0.01 * k AS x, CASE WHEN k IN (0, 200) THEN 0.005 ELSE 0.01 END AS w FROM (SELECT unnest(range(0, 201)) AS k)) GROUP BY 1")
def weighted_norm(spark, d):
    """sin(s u) on [1, 3] by itself and against u, under u^-1/2; the second through an evaluator that the caller authorises."""
    grid = generators.grid(spark, 1.0, 3.0, 200)
    sizes = table(spark, d, "part").select(F.col("p_size").alias("size")).distinct()
    rows = sizes.crossJoin(F.broadcast(grid)).withColumnRenamed("x", "u").withColumn("f", F.sin(F.col("size") * F.col("u")))  # 201 nodes
    target = plugins.Evaluator("identity", lambda u: u)
    one = states.weighted_norm(rows, ["size"], "u", "weight", F.col("f"), 0.5).withColumnRenamed("distance", "norm")
    two = states.weighted_norm(rows.withColumn("g", target.column(F.col("u"), True)), ["size"], "u", "weight", F.col("f"), 0.5, F.col("g"))
    return one.join(two, "size").select("size", F.round("norm", 8).alias("norm"), F.round("distance", 8).alias("distance"))


STATE = "(SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS v, -1 + 2.0::DOUBLE * unnest(range(0, 64)) / 63 AS x FROM embeddings)"


@query("full_state_geometry", f"SELECT vec_id AS id, round(sum(v * v), 5) AS mass, round(sum(x * x * v * v) / sum(v * v), 6) AS second, round(sum(power(x, 4) * v * v) / sum(v * v), 6) AS fourth, round(sum(CASE WHEN abs(x) > 0.75 THEN v * v ELSE 0 END) / sum(v * v), 6) AS outer_mass, min(v) AS least, round(sum(CASE WHEN v < 0 THEN v * v ELSE 0 END) / sum(v * v), 6) AS negative FROM {STATE} GROUP BY 1")
def full_state_geometry(spark, d):
    out = states.geometry(table(spark, d, "embeddings"), "embedding", 0.75)
    return out.select(F.col("vec_id").alias("id"), F.round("mass", 5).alias("mass"), *[F.round(c, 6).alias(c) for c in ("second", "fourth", "negative")], F.round("outer", 6).alias("outer_mass"), "least")


@query("profile_comparison", "SELECT user_id, round(sum(value * (event_id % 13)) / sum(power(event_id % 13, 2)), 6) AS scale, round(sqrt(sum(value * value) - power(sum(value * (event_id % 13)), 2) / sum(power(event_id % 13, 2))), 4) AS residual FROM events GROUP BY user_id HAVING sum(power(event_id % 13, 2)) > 0")
def profile_comparison(spark, d):
    e = table(spark, d, "events").select("user_id", "value", (F.col("event_id") % 13).cast("double").alias("k"))
    return states.compared_profiles(e, ["user_id"], "value", "k").filter("scale IS NOT NULL").select("user_id", F.round("scale", 6).alias("scale"), F.round("residual", 4).alias("residual"))


@query("prolate_spectrum", "SELECT n_nationkey AS id, CASE WHEN n_nationkey = 0 THEN 0.0 END AS lowest, round(sum(2.0 * i * (2 * i + 1) + power(n_nationkey / 4.0, 2) * (4.0 * i * (2 * i + 1) - 1) / ((4 * i + 3) * (4 * i - 1))), 6) AS trace, count(*) AS n FROM nation, (SELECT unnest(range(0, 12)) AS i) GROUP BY n_nationkey")
def prolate_spectrum(spark, d):
    """Eigenvalues for c = n/4 add up to the trace; for c = 0 the lowest is 0."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), (F.col("n_nationkey") / 4.0).alias("c"))
    w = linalg.eigenvalues(states.prolate_matrix(n, "id", "c", 12), "id")
    return w.groupBy("id").agg(F.when(F.col("id") == 0, F.round(F.min("value"), 9) + 0.0).alias("lowest"), F.round(F.sum("value"), 6).alias("trace"), F.count("*").alias("n"))


@query("prolate_ordering", "SELECT n_nationkey AS id, true AS ascending, true AS rises FROM nation WHERE n_nationkey > 0")
def prolate_ordering(spark, d):
    """Eigenvalues are simple and not below those for c = 0, k (k + 1) of even degrees."""
    n = table(spark, d, "nation").filter("n_nationkey > 0").select(F.col("n_nationkey").alias("id"), (F.col("n_nationkey") / 4.0).alias("c"))
    w = linalg.eigenvalues(states.prolate_matrix(n, "id", "c", 12), "id")
    free = 2.0 * F.col("ordinal") * (2 * F.col("ordinal") + 1)
    from pyspark.sql import Window

    step = F.coalesce(F.col("value") > F.lag("value").over(Window.partitionBy("id").orderBy("ordinal")), F.lit(True))
    return w.withColumn("step", step).groupBy("id").agg(F.bool_and("step").alias("ascending"), F.bool_and(F.col("value") >= free - 1e-9).alias("rises"))


@query("kernel_positivity", "WITH t AS (SELECT s_nationkey AS nation, CAST(s_acctbal AS BIGINT) // 1000 AS v FROM supplier) SELECT nation, count(*) AS n, count(*) - count(DISTINCT v) AS duplicates, true AS positive, count(*) = 1 OR count(*) > count(DISTINCT v) AS flat FROM t GROUP BY 1 HAVING count(*) = 1 OR count(*) > count(DISTINCT v)")
def kernel_positivity(spark, d):
    """A kernel's matrix has no eigenvalue below 0, and 0 itself where two ordinates are equal."""
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.expr("CAST(rint(s_acctbal) AS BIGINT) DIV 1000").cast("double").alias("v"))
    out = states.positivity(s, "nation", "v", 1.0)
    out = out.filter("n = 1 OR duplicates > 0")
    return out.select("nation", "n", "duplicates", (F.col("least") > -1e-9).alias("positive"), ((F.col("n") == 1) | (F.abs("least") < 1e-9)).alias("flat"))


def rank_one(spark, d):
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("matrix_id"), F.col("s_suppkey").alias("k"), (F.col("s_suppkey") % 40 + 0.0).alias("d"), (F.col("s_suppkey") % 3 + 1.0).alias("u"), F.lit(0.7).alias("alpha"))


def dense(spark, d):
    """The same matrices entry by entry."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("matrix_id").orderBy("k")) - 1
    r = work.written(rank_one(spark, d).withColumn("i", place), "rank-one")
    both = linalg.met(r.select("matrix_id", "i", "d", "u", "alpha"), r.select("matrix_id", F.col("i").alias("j"), F.col("u").alias("w")), "matrix_id")
    return both.select("matrix_id", "i", "j", (F.col("alpha") * F.col("u") * F.col("w") + F.when(F.col("i") == F.col("j"), F.col("d")).otherwise(0.0)).alias("v"))


@query("independent_routes", "SELECT s_nationkey AS matrix_id, count(*) AS n, 'agree' AS verdict FROM supplier GROUP BY 1")
def independent_routes(spark, d):
    """Diagonal plus rank one by its secular equation and as a dense matrix, entry by entry with like rows folded, value by value."""
    one = roots.rank_one_spectrum(rank_one(spark, d), "matrix_id")
    return states.agreement(one, linalg.folded_eigenvalues(dense(spark, d)), ["matrix_id"], "ordinal", "value", 1e-8).select("matrix_id", "n", "verdict")


@query("three_evaluators", "SELECT s_nationkey AS matrix_id, round(sum(s_suppkey % 40 + 0.7 * power(s_suppkey % 3 + 1, 2)), 6) AS source, round(sum(s_suppkey % 40 + 0.7 * power(s_suppkey % 3 + 1, 2)), 6) AS matrix, round(sum(s_suppkey % 40 + 0.7 * power(s_suppkey % 3 + 1, 2)), 6) AS zeros FROM supplier GROUP BY 1")
def three_evaluators(spark, d):
    """One number by the source terms, by the matrix and by its zeros."""
    source = rank_one(spark, d).groupBy("matrix_id").agg(F.round(F.sum(F.col("d") + F.col("alpha") * F.col("u") * F.col("u")), 6).alias("source"))
    matrix = dense(spark, d).filter("i = j").groupBy("matrix_id").agg(F.round(F.sum("v"), 6).alias("matrix"))
    zeros = roots.rank_one_spectrum(rank_one(spark, d), "matrix_id").groupBy("matrix_id").agg(F.round(F.sum("value"), 6).alias("zeros"))
    return source.join(matrix, "matrix_id").join(zeros, "matrix_id")


@query("reproduced_run", "SELECT count(*) AS saved, count(*) AS again, 0::BIGINT AS lost, 0::BIGINT AS gained FROM (SELECT o_custkey FROM orders GROUP BY 1)")
def reproduced_run(spark, d):
    """A run that is saved and replayed over other partitions, bit by bit, in exact decimals."""
    run = lambda o: o.groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"), F.min("o_orderkey").alias("first"))
    orders = table(spark, d, "orders")
    return capture.reproduced(capture.saved(run(orders)), run(orders.repartition(11, "o_orderkey")))


@query("captured_diagnostics", "SELECT 'parts' AS diagnostic, 'captured' AS outcome, count(*) AS rows FROM part UNION ALL SELECT 'broken', 'failed', NULL UNION ALL SELECT 'brands', 'captured', count(DISTINCT p_brand) FROM part")
def captured_diagnostics(spark, d):
    """Three diagnostics, of which one fails while it runs."""
    p = table(spark, d, "part")
    return capture.capture(spark, {
        "parts": lambda: p.select("p_partkey"), "broken": lambda: p.select(F.when(F.col("p_partkey") >= 0, F.raise_error(F.lit("broken"))).cast("int").alias("x")),
        "brands": lambda: p.select("p_brand").distinct(),
    }).select("diagnostic", "outcome", "rows")


@query("file_structure_report", "SELECT CASE WHEN s_suppkey % 5 = 1 THEN 'not_json' WHEN s_suppkey % 5 = 2 THEN 'digest_differs' END AS problem, count(*) AS files FROM supplier GROUP BY 1")
def file_structure_report(spark, d):
    """A file for each supplier under the digest of its content: some are no JSON, some have another name."""
    k = F.col("s_suppkey")
    body = F.when(k % 5 == 1, F.concat(F.lit("{"), k.cast("string"))).otherwise(F.to_json(F.struct("s_suppkey", "s_name")))
    name = F.when(k % 5 == 2, F.sha2(k.cast("string"), 256)).otherwise(F.sha2(F.concat(body, F.lit("\n")), 256))
    path = work.fresh(spark, "files")
    # Folders of two digits first: a listing takes a task for each folder of the upper level.
    rows = table(spark, d, "supplier").select(name.alias("name"), body.alias("body")).withColumn("shard", F.substring("name", 1, 2))
    work.texts(rows, path, "name", "shard", "name")
    return states.file_report(spark, path, "*.txt", "name=([0-9a-f]+)").groupBy("problem").agg(F.count("*").alias("files"))


@query("certificate_bundle", "SELECT array_to_string(CASE WHEN len(r) > 0 THEN r ELSE ['claim_not_replayed'] END, ',') AS findings, count(*) AS n FROM (SELECT list_filter([CASE WHEN o_orderpriority = '5-LOW' THEN 'kind' END, CASE WHEN o_orderkey % 7 = 0 THEN 'digest' END, CASE WHEN coalesce(c, 0) <> o_orderkey % 4 + 2 THEN 'records' END], lambda x: x IS NOT NULL) AS r FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey) GROUP BY 1")
def certificate_bundle(spark, d):
    records = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("c"))
    o = table(spark, d, "orders").join(records, "o_orderkey", "left")
    own = F.sha2(F.col("o_orderkey").cast("string"), 256)
    found = states.certificate_problems(F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")), own, F.when(F.col("o_orderkey") % 7 > 0, own).otherwise("x"), F.coalesce("c", F.lit(0)), F.col("o_orderkey") % 4 + 2)
    return o.groupBy(F.array_join(found, ",").alias("findings")).agg(F.count("*").alias("n"))


def catalog(spark):
    """What this engine can do, as a table (kind, name, most): solvers by the greatest order that one task takes, scalars by their digits."""
    rows = [("solver", n, 4096) for n in ("dense", "tridiagonal_qr", "sturm", "lanczos", "lobpcg", "shift_invert", "rank_one")] + [("scalar", "double", 15), ("scalar", "decimal", 1000), ("certificate", "rational", 1)]
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("name"), F.lit(m).alias("most")) for k, n, m in rows])))


@query("capability_catalog", "SELECT * FROM (VALUES ('solver', 7), ('scalar', 2), ('certificate', 1)) t(kind, n)")
def capability_catalog(spark, d):
    return catalog(spark).groupBy("kind").agg(F.count("*").cast("int").alias("n"))


@query("planned_preflight", "SELECT CASE WHEN p_size > 40 THEN 'lanczos' WHEN p_type LIKE 'ECO%' THEN 'tridiagonal_qr' WHEN p_size % 10 = 0 THEN 'arnoldi' ELSE 'dense' END AS route, CASE WHEN p_size <= 40 AND p_type NOT LIKE 'ECO%' AND p_size % 10 = 0 THEN 'unsupported' WHEN p_size * 100 > 4096 THEN 'insufficient' END AS code, count(*) AS n FROM part GROUP BY ALL")
def planned_preflight(spark, d):
    """A domain's planner chooses a route, and the catalog says if it can be taken at that order."""
    planner = plugins.Planner("parts", ((F.col("p_size") > 40, "lanczos"), (F.startswith("p_type", F.lit("ECO")), "tridiagonal_qr"), (F.col("p_size") % 10 == 0, "arnoldi"), (F.lit(True), "dense")))
    asked = table(spark, d, "part").select(F.col("p_partkey").alias("request"), F.lit("solver").alias("kind"), planner.column().alias("name"), (F.col("p_size") * 100).alias("least"))
    failed = governance.capability_failures(asked, catalog(spark)).select("request", "code")
    return asked.join(failed, "request", "left").groupBy(F.col("name").alias("route"), "code").agg(F.count("*").alias("n"))


@query("plugin_solver", "SELECT outcome, count(*) AS matrices FROM (SELECT CASE n_nationkey % 8 WHEN 0 THEN 'ZeroDivisionError' WHEN 1 THEN 'invalid' ELSE 'solved' END AS outcome FROM nation) GROUP BY 1")
def plugin_solver(spark, d):
    """A user's solver that fails on order 5, returns one value too few on order 6, and solves the others."""

    def solve(a):
        w = np.linalg.eigvalsh(a)
        return w[1:] if len(a) == 6 else w / (0 if len(a) == 5 else 1) if len(a) != 5 else 1 // 0

    out = plugins.EigenSolver("own", solve).spectra(laplacians(spark, d))
    return out.groupBy("matrix_id", "outcome").agg(F.count("*").alias("k")).groupBy("outcome").agg(F.count("*").alias("matrices"))


@query("plugin_function", "SELECT event_id AS id, sqrt(value + 1) AS y FROM events")
def plugin_function(spark, d):
    f = plugins.RealFunction("root", lambda x: np.sqrt(x + 1), lambda x: 0.5 / np.sqrt(x + 1))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), f.column(F.col("value")).alias("y"))
