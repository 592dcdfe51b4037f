"""Queries of observation ladders, transforms, roots, generators, derivation graphs and variational forms."""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

import pandas as pd
from pyspark.sql import functions as F

from ..functions import analytic, numbers, shown
from ..functions.certified import rowwise
from ..operators import aggregates, dag, forms, generators, ladders, observed, precise, roots, selection, transforms
from ..operators.ranks import dense_position
from ..registry import query
from ..sources.tables import table
from .numeric import edges, laplacians

SIZES = "(SELECT n_nationkey AS matrix_id, 5 + n_nationkey % 8 AS n FROM nation)"
PRIMES = "(SELECT n AS p FROM (SELECT unnest(range(2, 1200)) AS n) ANTI JOIN (SELECT DISTINCT a * b AS n FROM (SELECT unnest(range(2, 36)) AS a), (SELECT unnest(range(2, 600)) AS b)) USING (n))"
POWERS = f"(SELECT CAST(round(power(p, j)) AS BIGINT) AS n, p, j FROM {PRIMES}, (SELECT unnest(range(1, 11))::INT AS j) WHERE round(power(p, j)) <= 1100)"


@query("ladder_deltas", "SELECT event_id AS id, round(v - b, 6) AS signed, round(CASE WHEN b <> 0 THEN (v - b) / abs(b) END, 6) AS relative FROM (SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS v, lag(CASE WHEN event_type <> 'error' THEN value END) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)")
def ladder_deltas(spark, d):
    out = observed.deltas(table(spark, d, "events"), ["user_id"], "event_id", "value", F.col("event_type") != "error")
    return out.select(F.col("event_id").alias("id"), F.round("signed", 6).alias("signed"), F.round("relative", 6).alias("relative"))


@query("scheduled_ladder", "SELECT l_orderkey AS series, l_linenumber AS step, l_partkey AS part, fits, CASE WHEN fits THEN round(l_quantity - lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), 6) END AS change FROM (SELECT *, bool_and(CASE WHEN l_suppkey % 50 = 0 THEN 'other' ELSE 'q' || l_linenumber END = 'q' || l_linenumber) OVER (PARTITION BY l_orderkey) AS fits FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) = 1))")
def scheduled_ladder(spark, d):
    """The quadrature of a step is q and its number; a series with another one is refused whole."""
    li = selection.best(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], [F.col(c) for c in ("l_partkey", "l_suppkey", "l_extendedprice")])
    name = F.concat(F.lit("q"), F.col("l_linenumber").cast("string"))
    li = li.select(F.col("l_orderkey").alias("series"), F.col("l_linenumber").alias("step"), F.col("l_partkey").alias("part"), F.when(F.col("l_suppkey") % 50 == 0, "other").otherwise(name).alias("quadrature"), F.col("l_quantity").alias("value"))
    schedule = spark.range(1, 8).select(F.col("id").cast("int").alias("step")).withColumn("wanted", F.concat(F.lit("q"), F.col("step").cast("string")))
    return observed.scheduled(li, schedule, ["series"], "step", "quadrature", "value").select("series", "step", "part", "fits", F.round("change", 6).alias("change"))


@query("complete_windows", """WITH l AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) = 1),
 r AS (SELECT l_orderkey, l_linenumber <> row_number() OVER w AS gap, coalesce(lag(l_linenumber * 100 + l_quantity) OVER w >= l_linenumber * 100 + l_quantity, false) AS bad, coalesce(lag(l_linenumber * 100 + l_quantity + 70) OVER w >= l_linenumber * 100 + l_quantity, false) AS over, l_suppkey % 9 > 0 AS ok FROM l WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)),
 p AS (SELECT l_orderkey, count(*) AS n, bool_or(gap) AS gap, bool_or(bad) AS bad, bool_or(over) AS over, bool_and(ok) AS ok FROM r GROUP BY 1)
 SELECT CASE WHEN coalesce(n, 0) <> o_orderkey % 6 + 1 THEN 'count' WHEN gap THEN 'ordinals' WHEN bad THEN 'order' WHEN over THEN 'overlap' WHEN NOT coalesce(ok, true) THEN 'unverified' ELSE 'complete' END AS status, count(*) AS windows FROM orders LEFT JOIN p ON l_orderkey = o_orderkey GROUP BY 1""")
def complete_windows(spark, d):
    li = selection.best(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], [F.col(c) for c in ("l_partkey", "l_suppkey", "l_extendedprice")])
    lo = F.col("l_linenumber") * 100 + F.col("l_quantity")
    li = li.select(F.col("l_orderkey").alias("window"), "l_linenumber", lo.alias("lo"), (lo + 70).alias("hi"), (F.col("l_suppkey") % 9 > 0).alias("ok"))
    expected = table(spark, d, "orders").select(F.col("o_orderkey").alias("window"), (F.col("o_orderkey") % 6 + 1).alias("count"))
    return observed.window_status(li, "window", "l_linenumber", "lo", "hi", "ok", expected).groupBy("status").agg(F.count("*").alias("windows"))


def floor_points(spark, d):
    p = table(spark, d, "part")
    cutoff = 2 + F.col("p_partkey") % 1000 + F.when(F.col("p_size") % 4 == 0, 0.5).otherwise(0.0)
    return observed.prime_floor(p.select(F.col("p_partkey").alias("id"), cutoff.alias("cutoff"), (F.col("p_retailprice") / 1000).alias("measured"), (F.col("p_size") / 10).alias("smooth")), "cutoff", 1100)


@query("prime_floor", f"WITH p AS (SELECT p_partkey AS id, 2 + p_partkey % 1000 AS f, p_size % 4 <> 0 AS whole FROM part), c AS (SELECT f, count(*) AS k, max(n) AS m, bool_or(n = f AND j = 1) AS pr FROM (SELECT DISTINCT f FROM p) JOIN {POWERS} ON n <= f GROUP BY 1) SELECT id, whole AND pr AS cutoff_is_prime, k AS prime_powers, m AS largest FROM p JOIN c USING (f)")
def prime_floor(spark, d):
    return floor_points(spark, d).select("id", "cutoff_is_prime", "prime_powers", "largest")


@query("prime_floor_report", "SELECT round(max(abs(p_retailprice / 1000 - p_size / 10)), 6) AS modulation, true AS has_nonprime, count(*) AS points FROM part")
def prime_floor_report(spark, d):
    return observed.floor_report(floor_points(spark, d), "measured", "smooth").withColumn("modulation", F.round("modulation", 6))


MOMENTS = f"(SELECT matrix_id, k AS dimension, sum(1 / w) AS t1, sum(1 / w / w) AS t2, sum(1 / w / w / w) AS t3 FROM (SELECT matrix_id, k, 2 - 2 * cos(j * pi() / (k + 1)) AS w FROM {SIZES}, (SELECT unnest(range(1, 13)) AS k), (SELECT unnest(range(1, 13)) AS j) WHERE k <= n AND j <= k) GROUP BY 1, 2)"


@query("inverse_moments", f"SELECT matrix_id, dimension, round(t1, 5) AS t1, round(t2, 4) AS t2, round(t3, 3) AS t3 FROM {MOMENTS}")
def inverse_moments(spark, d):
    return observed.inverse_moments(laplacians(spark, d)).select("matrix_id", "dimension", F.round("t1", 5).alias("t1"), F.round("t2", 4).alias("t2"), F.round("t3", 3).alias("t3"))


@query("two_mode_fit", f"SELECT matrix_id, dimension, CASE WHEN dimension = 1 THEN 'single_dimension' ELSE 'resolved' END AS status, CASE WHEN dimension > 1 THEN round(1 / (sqrt(t2) * (s + sqrt(2 - s * s)) / 2), 6) END AS lowest, CASE WHEN dimension = 2 THEN 3.0 END AS second FROM (SELECT *, 2 * cos(acos(-least(t3 / power(t2, 1.5), 1)) / 3) AS s FROM {MOMENTS})")
def two_mode_fit(spark, d):
    """Of two dimensions the fit is exact: values 1 and 3."""
    out = observed.two_modes(observed.inverse_moments(laplacians(spark, d)))
    return out.select("matrix_id", "dimension", "status", F.round("lowest", 6).alias("lowest"), F.when(F.col("dimension") == 2, F.round("second", 6)).alias("second"))


@query("prefix_nesting", f"SELECT matrix_id, dimension, matrix_id % 3 > 0 OR dimension < 3 AS equal FROM {SIZES}, (SELECT unnest(range(1, 13)) AS dimension) WHERE dimension <= n")
def prefix_nesting(spark, d):
    """A prior report of some matrices has another entry at its third place."""
    m = laplacians(spark, d)
    other = m.withColumn("v", F.when((F.col("matrix_id") % 3 == 0) & (F.col("i") == 2) & (F.col("j") == 2), F.col("v") + 1).otherwise(F.col("v")))
    return observed.nested(forms.prefix_pivots(m), forms.prefix_pivots(other), ["matrix_id", "dimension"], ["pivot", "trace1"])


@query("ground_index_outcome", f"WITH e AS (SELECT matrix_id, n, 2 - 2 * cos(pi() / (n + 1)) + (matrix_id % 3 - 1) * 0.3 AS x FROM {SIZES}), c AS (SELECT matrix_id, count(*) FILTER (WHERE w < x - 0.01) AS a, count(*) FILTER (WHERE w < x + 0.01) AS b FROM e, LATERAL (SELECT 2 - 2 * cos(k * pi() / (n + 1)) AS w FROM (SELECT unnest(range(1, 13)) AS k) WHERE k <= n) GROUP BY 1) SELECT matrix_id, CASE WHEN a > 0 THEN 'refuted' WHEN b = 1 THEN 'established' ELSE 'inconclusive' END AS outcome FROM c")
def ground_index_outcome(spark, d):
    """Enclosures around the lowest value, below it and above it."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("matrix_id"), (5 + F.col("n_nationkey") % 8).alias("n"))
    x = 2 - 2 * F.cos(F.pi() / (F.col("n") + 1)) + (F.col("matrix_id") % 3 - 1) * 0.3
    count = lambda at: numbers.sturm_count(F.array_repeat(F.lit(2.0), F.col("n")), F.array_repeat(F.lit(-1.0), F.col("n") - 1), at)
    return n.select("matrix_id", observed.ground_index(count(x - 0.01), count(x + 0.01)).alias("outcome"))


@query("strip_bound", "WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, value FROM events) SELECT user_id, CASE WHEN user_id % 5 > 0 THEN round(sum(value * 0.01 * exp(0.5 * k / 100.0)) + 0.25, 6) END AS bound, CASE WHEN user_id % 5 = 0 AND count(*) > 1 THEN 'not_contiguous' END AS problem FROM e GROUP BY user_id HAVING user_id % 5 > 0 OR count(*) > 1")
def strip_bound(spark, d):
    """Panels of a hundredth; some users' panels leave a gap at the second."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    e = table(spark, d, "events").select("user_id", place.alias("k"), F.col("value").alias("error"))
    shift = F.when((F.col("user_id") % 5 == 0) & (F.col("k") > 1), 1).otherwise(0)
    e = e.select("user_id", ((F.col("k") - 1 + shift) / 100).alias("left"), ((F.col("k") + shift) / 100).alias("right"), "error")
    out = observed.strip_bound(e, "user_id", "left", "right", "error", 0.5, 0.25)
    return out.filter("user_id % 5 > 0 OR problem IS NOT NULL").select("user_id", F.round("bound", 6).alias("bound"), "problem")


@query("residual_gap", "SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 OR c_nationkey = 0 THEN 'invalid' WHEN c_acctbal / 1000 >= c_nationkey THEN 'inconclusive' ELSE 'reliable' END AS status, CASE WHEN c_acctbal >= 0 AND c_nationkey > 0 AND c_acctbal / 1000 < c_nationkey THEN round(c_acctbal / 1000 / c_nationkey, 6) END AS bound FROM customer")
def residual_gap(spark, d):
    bound, status = observed.gap_bound(F.col("c_acctbal") / 1000, F.col("c_nationkey").cast("double"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), status.alias("status"), F.round(bound, 6).alias("bound"))


@query("compare_reductions", "SELECT l_orderkey AS id, round(abs(sum(l_quantity) - sum(l_linenumber * 7.0)), 6) AS difference, CASE WHEN l_orderkey % 2 = 0 THEN l_orderkey % 3 = 0 ELSE abs(sum(l_quantity) - sum(l_linenumber * 7.0)) <= 20 END AS agrees FROM lineitem GROUP BY 1")
def compare_reductions(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id"))
    left = li.agg(F.sum("l_quantity").alias("value")).withColumns({"digest": F.sha2(F.col("id").cast("string"), 256), "alike": F.col("id") % 2 == 0})
    right = li.agg(F.sum(F.col("l_linenumber") * 7.0).alias("value")).withColumn("digest", F.when(F.col("id") % 3 == 0, F.sha2(F.col("id").cast("string"), 256)).otherwise("x"))
    return observed.reduction_agreement(left, right, "id", "value", "digest", 20.0).withColumn("difference", F.round("difference", 6))


@query("owned_pairwise_sum", "SELECT vec_id AS id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 9) AS total, true AS same FROM embeddings")
def owned_pairwise_sum(spark, d):
    """The same tree over the same numbers, held in a row or spread over rows: the same bits."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    rows = aggregates.chunked_sum(e.select("id", F.posexplode("x").alias("k", "v")), ["id"], "k", "v", 1)
    both = e.withColumn("own", aggregates.pairwise(F.col("x"))).join(rows, "id")
    return both.select("id", F.round("own", 9).alias("total"), (F.col("own") == F.col("total")).alias("same"))


@query("exact_sign_crossings", "SELECT user_id, event_id AS upper FROM (SELECT *, lag(s) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM (SELECT user_id, event_id, sign(value - 50) AS s FROM events WHERE value <> 50)) WHERE s <> b")
def exact_sign_crossings(spark, d):
    """Signs of text too small for a double: the difference from 50, times 10^-400."""
    text = F.concat(F.format_string("%.10f", F.col("value") - 50), F.lit("e-400"))
    e = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("value") == 50, "0").otherwise(text).alias("text"))
    return ladders.exact_crossings(e, ["user_id"], "event_id", "text").select("user_id", "upper")


@query("real_crossings", "SELECT n_nationkey AS id, round(r, 7) AS root FROM (SELECT n_nationkey, unnest([acos(n_nationkey / 40.0), 2 * pi() - acos(n_nationkey / 40.0), 2 * pi() + acos(n_nationkey / 40.0)]) AS r FROM nation) WHERE r <= 10")
def real_crossings(spark, d):
    """Sign changes of cos t = n/40 on [0, 10], scanned and halved."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"))
    return transforms.crossings(n, ["id"], lambda t: F.cos(t) - F.col("id") / 40.0, 0.0, 10.0, 97).select("id", F.round("root", 7).alias("root"))


@query("precise_crossings", "SELECT n_nationkey AS id, round(acos(n_nationkey / 40.0::DOUBLE), 11) AS root, 'converged' AS outcome FROM nation WHERE n_nationkey > 0")
def precise_crossings(spark, d):
    """The first of them at 25 digits: the scan's sign change, then halving in decimals."""

    def first(k):
        f = lambda t: analytic.cos_sin(t, 25)[0] - Decimal(int(k)) / 40
        grid = [Decimal(j) / 10 for j in range(100)]
        signs = [f(t) > 0 for t in grid]
        j = next(j for j in range(99) if signs[j] != signs[j + 1])
        root, outcome = precise.bisection(f, grid[j], grid[j + 1], 25)
        return float(root), outcome

    out = table(spark, d, "nation").filter("n_nationkey > 0").select(F.col("n_nationkey").alias("id"), rowwise(first, "struct<root:double,outcome:string>")("n_nationkey").alias("r"))
    return out.select("id", F.round("r.root", 11).alias("root"), F.col("r.outcome").alias("outcome"))


@query("safeguarded_newton", "SELECT p_partkey AS id, round(power(p_retailprice, 1 / 3.0::DOUBLE), 8) AS root, p_retailprice IS NOT NULL AS found FROM part")
def safeguarded_newton(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit(0.5).alias("lo"), (F.col("p_retailprice") + 1).alias("hi"), F.col("p_retailprice").alias("parameter"))
    out = roots.refined(p, "id", lambda x, a: x**3 - a, lambda x, _: 3 * x * x)
    return out.select("id", F.round("root", 8).alias("root"), F.col("outcome").isin("converged", "exact").alias("found"))


@query("pole_aware_roots", "SELECT p_partkey AS id, p_size::DOUBLE AS lower, round(p_size + 1.0, 7) AS root FROM part UNION ALL SELECT p_partkey, p_size + 2.0, round(p_size + 3.5, 7) FROM part")
def pole_aware_roots(spark, d):
    """1/(t - a) + 1/(t - a - 2) between its poles, and its mirror image about a + 3.5 between the next ones; no pole is a root."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("a"))
    poles = p.select("id", "a", F.explode(F.array(F.col("a"), F.col("a") + 2, F.col("a") + 5)).alias("pole"))
    near = lambda t: 1 / (t - F.col("a")) + 1 / (t - F.col("a") - 2)
    far = lambda t: 1 / (t - F.col("a") - 2) + 1 / (t - F.col("a") - 5)
    out = roots.between_poles(poles, "id", "pole", lambda t: F.when(t < F.col("a") + 2, near(t)).otherwise(far(t)), 15)
    return out.select("id", "lower", F.round("root", 7).alias("root"))


@query("precise_roots", "SELECT p_size AS size, round(sqrt(p_size + 0.5::DOUBLE), 12) AS bisection, round(sqrt(p_size + 0.5::DOUBLE), 12) AS newton, true AS agree FROM (SELECT DISTINCT p_size FROM part)")
def precise_roots(spark, d):
    """x^2 = s + 1/2 at 40 digits by two methods, which agree to 39."""

    def both(s):
        a = Decimal(int(s)) + Decimal("0.5")
        x, _ = precise.bisection(lambda t: t * t - a, 0, a + 1, 40)
        y, _ = precise.newton(lambda t: t * t - a, lambda t: 2 * t, 0, a + 1, 40)
        return float(x), float(y), abs(x - y) <= Decimal("1e-39")

    out = table(spark, d, "part").select(F.col("p_size").alias("size")).distinct().select("size", rowwise(both, "struct<x:double,y:double,agree:boolean>")("size").alias("r"))
    return out.select("size", F.round("r.x", 12).alias("bisection"), F.round("r.y", 12).alias("newton"), F.col("r.agree").alias("agree"))


@query("adaptive_refinement", "SELECT p_size AS size, CASE WHEN p_size % 3 = 0 THEN 10 WHEN p_size % 3 = 1 THEN 20 ELSE 40 END AS digits, p_size % 7 > 0 OR p_size % 3 < 2 AS accepted FROM (SELECT DISTINCT p_size FROM part)")
def adaptive_refinement(spark, d):
    """Only what an attempt refuses is tried with more digits; some are refused by the last as well."""
    tasks = table(spark, d, "part").select(F.col("p_size").alias("size")).distinct()
    need = F.when(F.col("size") % 3 == 0, 10).when(F.col("size") % 3 == 1, 20).when(F.col("size") % 7 > 0, 40).otherwise(80)
    return roots.retried(tasks, lambda t, n: t.withColumn("accepted", need <= n), (10, 20, 40)).select("size", "digits", "accepted")


# --- Generators and number theory


@query("character_at_power", f"SELECT p, j, [0, 1, 0, -1][p % 4 + 1] ** j AS chi4, CASE WHEN p % 5 = 0 THEN 0 WHEN p % 5 IN (1, 4) THEN 1 WHEN j % 2 = 0 THEN 1 ELSE -1 END AS chi5 FROM {POWERS}")
def character_at_power(spark, d):
    out = generators.character_powers(spark, 1100, 5).withColumnRenamed("chi", "chi5")
    return out.select("p", "j", numbers.character_at_power(4, F.col("p"), F.col("j")).cast("double").alias("chi4"), "chi5")


@query("character_prime_powers", f"SELECT [0, 1, -1][p % 3 + 1] AS chi, count(*) AS n, CAST(sum(n) AS BIGINT) AS total FROM {POWERS} WHERE j = 1 GROUP BY 1")
def character_prime_powers(spark, d):
    return generators.character_powers(spark, 1100, 3).filter("j = 1").groupBy("chi").agg(F.count("*").alias("n"), F.sum("n").alias("total"))


@query("partition_orbits", "WITH RECURSIVE p AS (SELECT CAST([] AS INT[]) AS parts, 0 AS degree UNION ALL SELECT list_append(parts, k), degree + k FROM p, (SELECT unnest(range(1, 6))::INT AS k) WHERE len(parts) < 4 AND degree + k <= 5 AND (len(parts) = 0 OR k <= parts[-1])), x AS (SELECT array_to_string(parts, '+') AS parts, parts AS a FROM p), c AS (SELECT parts, coalesce(product(factorial(m::INT)), 1) AS below, 4 - coalesce(sum(m), 0) AS zeros FROM (SELECT parts, v, count(*) AS m FROM (SELECT parts, unnest(a) AS v FROM x) GROUP BY 1, 2 UNION ALL SELECT parts, 0, 0 FROM x WHERE len(a) = 0) GROUP BY 1) SELECT parts, CAST(24 / below / factorial(zeros::INT) AS BIGINT) AS arrangements FROM c")
def partition_orbits(spark, d):
    """Distinct arrangements in four places, against the multinomial."""
    out = generators.orbit(generators.partitions(spark, 4, 5), "parts", 4)
    return out.groupBy(F.array_join(F.col("parts").cast("array<string>"), "+").alias("parts")).agg(F.count_distinct("arrangement").alias("arrangements"))


@query("quadrature_orders", "SELECT p_partkey AS id, mode, CAST(ceil(greatest(40, 3 * mode + p_partkey % 200 // 2) / 16.0) * 16 AS BIGINT) AS order_ FROM part, LATERAL (SELECT unnest(range(0, p_size + 1)) AS mode)")
def quadrature_orders(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size", (F.col("p_partkey") % 200).alias("bits"))
    return generators.quadrature_orders(p, "p_size", 40, "bits", 16).select("id", "mode", F.col("order").alias("order_"))


@query("basis_profile", "SELECT p_partkey AS id, round((1 + 0.5 * cos(2 * pi() * p_size / 150.0) + 0.25 * cos(4 * pi() * p_size / 150.0)) / (1 + 0.5 * cos(2 * pi() / 3) + 0.25 * cos(4 * pi() / 3)), 9) AS profile FROM part")
def basis_profile(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 50.0).alias("u"))
    return generators.basis_profile(p, "u", [1.0, 0.5, 0.25], 3.0).select("id", F.round("profile", 9).alias("profile"))


@query("dirichlet_grid_plan", "SELECT c_custkey AS id, CASE WHEN c_acctbal > 0 AND c_nationkey >= 3 THEN round(2 * c_acctbal / (c_nationkey + 1), 8) END AS step, array_to_string(list_filter([CASE WHEN c_acctbal <= 0 THEN 'width' END, CASE WHEN c_nationkey < 3 THEN 'points' END], lambda x: x IS NOT NULL), ',') AS problems FROM customer")
def dirichlet_grid_plan(spark, d):
    out = generators.dirichlet_plan(table(spark, d, "customer"), "c_acctbal", "c_nationkey")
    return out.select(F.col("c_custkey").alias("id"), F.round("step", 8).alias("step"), F.array_join("problems", ",").alias("problems"))


@query("grid_schemes", "SELECT scheme, variable, round(sum(w * exp(-x)), 9) AS integral FROM (SELECT s AS scheme, 'u' AS variable, CASE s WHEN 'trapezoid' THEN CASE WHEN k IN (0, 400) THEN 0.5 ELSE 1 END ELSE CAST(k < 400 AS INT) END * 0.01 AS w, 1 + 0.01 * (k + CASE s WHEN 'right' THEN 1 WHEN 'midpoint' THEN 0.5 ELSE 0 END) AS x FROM (SELECT unnest(range(0, 401)) AS k), (SELECT unnest(['left', 'right', 'midpoint', 'trapezoid']) AS s) UNION ALL SELECT s, 'ln u', w * exp(l), exp(l) FROM (SELECT s, CASE s WHEN 'trapezoid' THEN CASE WHEN k IN (0, 400) THEN 0.5 ELSE 1 END ELSE CAST(k < 400 AS INT) END * (ln(5.0::DOUBLE) / 400) AS w, (ln(5.0::DOUBLE) / 400) * (k + CASE s WHEN 'right' THEN 1 WHEN 'midpoint' THEN 0.5 ELSE 0 END) AS l FROM (SELECT unnest(range(0, 401)) AS k), (SELECT unnest(['left', 'right', 'midpoint', 'trapezoid']) AS s))) GROUP BY ALL")
def grid_schemes(spark, d):
    """e^-x over [1, 5] by four rules, uniform in x and in ln x."""
    out = None
    for name, rule in (("u", generators.grid), ("ln u", generators.log_grid)):
        for scheme in ("left", "right", "midpoint", "trapezoid"):
            row = rule(spark, 1.0, 5.0, 400, scheme).agg(F.lit(scheme).alias("scheme"), F.lit(name).alias("variable"), F.round(F.sum(F.col("weight") * F.exp(-F.col("x"))), 9).alias("integral"))
            out = row if out is None else out.unionByName(row)
    return out


@query("prolate_asymptotics", "SELECT p_partkey AS id, CASE WHEN p_partkey % 8 % 2 = 0 AND p_size >= 1 THEN round(ln(2 * sqrt(pi())) + (p_partkey % 8) * ln(8.0::DOUBLE) + (p_partkey % 8 + 0.5) * ln(2 * pi()) - ln(factorial((p_partkey % 8)::INT)::DOUBLE) + (p_partkey % 8 + 0.5) * ln(p_size::DOUBLE) - 4 * pi() * p_size, 7) END AS log_deficiency FROM part")
def prolate_asymptotics(spark, d):
    """Odd modes have none."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(numbers.prolate_log_deficiency(F.col("p_partkey") % 8, F.col("p_size").cast("double")), 7).alias("log_deficiency"))


@query("multi_index_order", "SELECT concat_ws(',', a, b, c) AS index, row_number() OVER (ORDER BY a + b + c, a, b, c) - 1 AS position FROM (SELECT unnest(range(0, 6))::INT AS a), (SELECT unnest(range(0, 6))::INT AS b), (SELECT unnest(range(0, 6))::INT AS c) WHERE a + b + c <= 5")
def multi_index_order(spark, d):
    out = dense_position(generators.multi_indices(spark, 3, 5), "degree", "index")
    return out.withColumn("index", F.array_join(F.col("index").cast("array<string>"), ",")).select("index", "position")


@query("exact_decimals", "SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part, CAST(sign(round(l_discount * 100) - round(l_tax * 100) - 2) AS INT) AS against_sum, l_discount AS double, CASE WHEN l_discount = l_tax THEN 99 ELSE CASE WHEN abs(l_discount - l_tax) / greatest(l_discount, l_tax) <= 0.1000001 THEN 1 ELSE 0 END END AS digits FROM lineitem")
def exact_decimals(spark, d):
    """A number against a sum of two, as a double, and in how many digits it agrees with another; all from text."""
    from ..functions import exact

    a, b = F.format_string("%.2f", "l_discount"), F.format_string("%.2f", "l_tax")
    out = exact.matching_digits(a, b)
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), exact.compare_to_sum(a, F.array(b, F.lit("0.02"))).alias("against_sum"), exact.to_double(a).alias("double"),
        out.alias("digits"),
    )


@query("decimal_enclosure", "SELECT o_orderkey AS id, floor(o_totalprice / power(10, length(CAST(floor(o_totalprice) AS BIGINT)::VARCHAR) - 2)) * power(10, length(CAST(floor(o_totalprice) AS BIGINT)::VARCHAR) - 2) AS lo, o_totalprice AS exact FROM orders")
def decimal_enclosure(spark, d):
    """The lower end at two digits, and all digits of the double, read back."""
    from ..functions import exact

    e = exact.enclose(F.format_string("%.2f", "o_totalprice"), F.lit(2))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), e.alias("e"), exact.from_double(F.col("o_totalprice")).alias("x")).select("id", F.col("e.lo").cast("double").alias("lo"), F.col("x").cast("double").alias("exact"))


# --- Graphs


BUDGET = 1_000_000_000


@query("derivation_plan_graph", f"""WITH RECURSIVE c AS (SELECT o_custkey AS k, min(round(o_totalprice * 100))::BIGINT AS cost FROM orders GROUP BY 1),
 u AS (SELECT 'c' || c_custkey AS node, n_regionkey, cost FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN c ON k = c_custkey),
 free AS (SELECT *, row_number() OVER (ORDER BY node) AS i FROM u WHERE n_regionkey <> 3 AND cost IS NOT NULL),
 first AS (SELECT {BUDGET} - (SELECT count(*) FROM region WHERE r_regionkey <> 3) - 2 * (SELECT count(*) FROM nation WHERE n_regionkey <> 3) AS b),
 f AS (SELECT node, i, cost <= b AS taken, b - CASE WHEN cost <= b THEN cost ELSE 0 END AS rest FROM free, first WHERE i = 1
  UNION ALL SELECT x.node, x.i, x.cost <= f.rest, f.rest - CASE WHEN x.cost <= f.rest THEN x.cost ELSE 0 END FROM f JOIN free x ON x.i = f.i + 1)
 SELECT 'r' || r_regionkey AS node, 0 AS level, CASE WHEN r_regionkey = 3 THEN 'no_candidate' ELSE 'planned' END AS status FROM region
 UNION ALL SELECT 'n' || n_nationkey, 1, CASE WHEN n_regionkey = 3 THEN 'blocked' ELSE 'planned' END FROM nation
 UNION ALL SELECT u.node, 2, CASE WHEN n_regionkey = 3 THEN 'blocked' WHEN cost IS NULL THEN 'no_candidate' WHEN taken THEN 'planned' ELSE 'over_budget' END FROM u LEFT JOIN f ON f.node = u.node""")
def derivation_plan_graph(spark, d):
    """Regions, nations and customers in dependency order; a customer's cheapest order is its candidate, one region has none, and the budget binds."""
    e = edges(spark, d).filter("node NOT LIKE 'o%'")
    nodes = e.select("node").unionByName(e.select(F.col("dep").alias("node")))
    orders = table(spark, d, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("node"), F.col("o_orderkey").alias("candidate"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cost")
    )
    fixed = nodes.filter("node NOT LIKE 'c%' AND node <> 'r3'").distinct().select(
        "node", F.lit(0).cast("long").alias("candidate"), F.when(F.startswith("node", F.lit("r")), 1).otherwise(2).cast("long").alias("cost")
    )
    return dag.planned(nodes, e, orders.unionByName(fixed), [F.col("cost"), F.col("candidate")], BUDGET).select("node", "level", "status")


@query("identity_resolution", "SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN c_nationkey % 5 = 0 THEN 'missing' ELSE 'resolved' END AS outcome FROM orders JOIN customer ON c_custkey = o_custkey) GROUP BY 1")
def identity_resolution(spark, d):
    """Orders with their customers, nations and regions; a fifth of the nations is not known."""
    e = edges(spark, d)
    name = F.col("node")
    all_ = e.select("node").unionByName(e.select(F.col("dep").alias("node"))).distinct()
    known = all_.filter(~(F.startswith(name, F.lit("n")) & (F.substring(name, 2, 9).try_cast("int") % 5 == 0)))
    start = table(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("root"))
    return dag.resolved(start, e, known, 8, 100).groupBy("outcome").agg(F.count("*").alias("n"))


@query("prune_protection", "SELECT 'c' || c_custkey AS node, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS protected FROM customer UNION ALL SELECT 'n' || n_nationkey, EXISTS (SELECT 1 FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = n_nationkey AND o_orderstatus = 'P') FROM nation")
def prune_protection(spark, d):
    """What open orders reach, over any number of steps."""
    e = edges(spark, d)
    live = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("root"))
    candidates = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))
    candidates = candidates.unionByName(table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node")))
    return dag.protected(candidates, e, live)


@query("invalidated_nodes", "SELECT 'r' || r_regionkey AS node, 0 AS depth FROM region WHERE r_regionkey = 2 UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'c' || c_custkey, 2 FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2 UNION ALL SELECT 'o' || o_orderkey, 3 FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2")
def invalidated_nodes(spark, d):
    return dag.invalidated(edges(spark, d), table(spark, d, "region").filter("r_regionkey = 2").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node")))


@query("source_ancestry", "SELECT 'c' || c_custkey AS root, 2 AS ancestors, CAST(n_nationkey % 4 = 0 AS BIGINT) AS wrong FROM customer JOIN nation ON n_nationkey = c_nationkey")
def source_ancestry(spark, d):
    """A customer's nation and region; some nations are not what was recorded."""
    e = edges(spark, d).filter("node NOT LIKE 'o%'")
    recorded = e.select(F.col("dep").alias("node")).distinct().withColumn("digest", F.sha2("node", 256))
    off = F.startswith("node", F.lit("n")) & (F.coalesce(F.substring("node", 2, 9).try_cast("int"), F.lit(1)) % 4 == 0)
    seen = recorded.withColumn("digest", F.when(off, "other").otherwise(F.col("digest")))
    start = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("root"))
    return dag.ancestry(start, e, recorded, seen)


# --- Variational forms


@query("variational_forms", "SELECT k, 1 AS degree_count, round(2.0 * k / (k + 1), 9) AS ratio FROM (SELECT unnest([2, 3, 4]) AS k)")
def variational_forms(spark, d):
    """Of the constant alone: J / I = 2 k / (k + 1), exactly."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(key[0])
        _, gram, form = forms.monomial_forms(k, 0)
        return pd.DataFrame({"k": [k], "degree_count": [len(gram)], "ratio": [round(float(form[0][0] / gram[0][0]), 9)]})

    return spark.range(2, 5).groupBy(F.col("id").cast("int").alias("k")).applyInPandas(run, "k int, degree_count int, ratio double")


@query("variational_routes", "SELECT k, true AS symmetric_agrees, true AS certificate_agrees, true AS orthogonal, true AS apart, CASE k WHEN 2 THEN 4 ELSE 4 END AS orbits FROM (SELECT unnest([2, 3]) AS k)")
def variational_routes(spark, d):
    """The greatest ratio to degree two on monomials and on orbit sums, the exact ratio of its vector, an exact orthogonal basis, and the permutation sectors."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(key[0])
        basis, gram, form = forms.monomial_forms(k, 2)
        _, small, own = forms.symmetric_forms(k, 2)
        whole, x = forms.largest_ratio(form, gram)
        symmetric, _ = forms.largest_ratio(own, small)
        certain = forms.rayleigh_ratio(form, gram, x)
        near, tail = forms.band_action(basis, form, 2)
        vectors = forms.orthonormal(gram)
        dot = lambda p, q: sum((a * gram[i][j] * b for i, a in enumerate(p) for j, b in enumerate(q)), Fraction(0))
        orthogonal = all(dot(p, q) == (size if i == j else 0) for i, (p, size) in enumerate(vectors) for j, (q, _) in enumerate(vectors))
        orbits, _, apart = forms.sectors(basis, form)
        return pd.DataFrame({
            "k": [k], "symmetric_agrees": [abs(whole - symmetric) < 1e-9], "certificate_agrees": [abs(float(certain) - whole) < 1e-9 and near == form and tail == 0],
            "orthogonal": [orthogonal], "apart": [apart], "orbits": [orbits],
        })

    return spark.range(2, 4).groupBy(F.col("id").cast("int").alias("k")).applyInPandas(run, "k int, symmetric_agrees boolean, certificate_agrees boolean, orthogonal boolean, apart boolean, orbits int")
