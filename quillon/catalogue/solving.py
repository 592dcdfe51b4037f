"""Queries of factorisations, eigensolvers and precise solvers, on second-difference matrices with closed forms."""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from ..functions import exact
from ..operators import linalg, precise, solvers
from ..registry import query
from ..sources.tables import table
from .numeric import COO, VEC, coo, vec
from .spectra import SPECTRUM, by_matrix

#: Entries of the matrices' unit eigenvectors, up to sign.
ENTRY = "round(abs(sqrt(2.0 / (n + 1)) * sin(k * (i + 1) * pi() / (n + 1))), 7)"
PLACES = "(SELECT unnest(range(0, 12)) AS i)"
SIZES = "(SELECT n_nationkey AS matrix_id, 5 + n_nationkey % 8 AS n FROM nation)"


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.diag(a).copy(), np.diag(a, 1).copy()


@query("lu_factors", f"SELECT matrix_id, CAST(i AS BIGINT) AS i, round((i + 2) / (i + 1)::DOUBLE, 9) AS pivot, 0.0::DOUBLE AS residual, 'factored' AS outcome FROM {SIZES}, {PLACES} WHERE i < n")
def lu_factors(spark, d):
    """Pivots of the factors, and how far their product is from the permuted matrix."""

    def solve(a):
        f, order, outcome = solvers.lu(a)
        gap = np.abs((np.tril(f, -1) + np.eye(len(a))) @ np.triu(f) - a[order]).max()
        return [(k, round(float(f[k, k]), 9), round(float(gap), 9) + 0.0, outcome) for k in range(len(a))]

    return by_matrix(spark, d, solve, "i long, pivot double, residual double, outcome string")


@query("blocked_lu_factors", f"SELECT matrix_id, CAST(i AS BIGINT) AS i, round((i + 2) / (i + 1)::DOUBLE, 9) AS pivot, true AS same FROM {SIZES}, {PLACES} WHERE i < n")
def blocked_lu_factors(spark, d):
    """By panels of three, against the factors of the plain elimination."""

    def solve(a):
        f, order, _ = solvers.blocked_lu(a, 3)
        g, plain, _ = solvers.lu(a)
        same = bool(np.abs(f - g).max() < 1e-12 and (order == plain).all())
        return [(k, round(float(f[k, k]), 9), same) for k in range(len(a))]

    return by_matrix(spark, d, solve, "i long, pivot double, same boolean")


@query("tridiagonal_solve", f"SELECT matrix_id, CAST(i AS BIGINT) AS i, round((i + 1) * (n - i) / 2.0::DOUBLE, 7) AS pivoted, round((i + 1) * (n - i) / 2.0::DOUBLE, 7) AS plain FROM {SIZES}, {PLACES} WHERE i < n")
def tridiagonal_solve(spark, d):
    def solve(a):
        x, y = (solvers.tridiagonal_solve(*tridiagonal(a), np.ones(len(a)), p) for p in (True, False))
        return [(k, round(float(x[k]), 7), round(float(y[k]), 7)) for k in range(len(a))]

    return by_matrix(spark, d, solve, "i long, pivoted double, plain double")


@query("householder_form", f"SELECT matrix_id, round(sum(1 / w), 6) AS trace, round(sum(1 / w / w), 5) AS squares FROM {SPECTRUM} GROUP BY 1")
def householder_form(spark, d):
    """The tridiagonal form of the full inverse keeps its trace and the squares of its entries."""

    def solve(a):
        diagonal, off, _ = solvers.householder(np.linalg.inv(a))
        return [(round(float(diagonal.sum()), 6), round(float((diagonal**2).sum() + 2 * (off**2).sum()), 5))]

    return by_matrix(spark, d, solve, "trace double, squares double")


@query("tridiagonal_qr", f"SELECT matrix_id, k - 1 AS ordinal, round(w, 8) AS value, 'converged' AS outcome FROM {SPECTRUM}")
def tridiagonal_qr(spark, d):
    def solve(a):
        w, outcome = solvers.tridiagonal_qr(*tridiagonal(a))
        return [(k, round(float(v), 8), outcome) for k, v in enumerate(w)]

    return by_matrix(spark, d, solve, "ordinal long, value double, outcome string")


@query("selected_eigenvalues", f"SELECT matrix_id, 'index' AS asked, round(w, 9) AS value FROM {SPECTRUM} WHERE k BETWEEN 2 AND 4 UNION ALL SELECT matrix_id, 'interval', round(w, 9) FROM {SPECTRUM} WHERE w >= 0.55 AND w < 2.3")
def selected_eigenvalues(spark, d):
    def solve(a):
        t = tridiagonal(a)
        return [("index", round(float(v), 9)) for v in solvers.selected_values(*t, 1, 3)] + [("interval", round(float(v), 9)) for v in solvers.values_between(*t, 0.55, 2.3)]

    return by_matrix(spark, d, solve, "asked string, value double")


@query("selected_eigenpairs", f"SELECT matrix_id, k - 1 AS ordinal, CAST(i AS BIGINT) AS i, round(w, 9) AS value, {ENTRY} AS size, 'converged' AS outcome FROM {SPECTRUM}, {PLACES} WHERE i < n AND k <= 3")
def selected_eigenpairs(spark, d):
    def solve(a):
        pairs = solvers.selected_pairs(*tridiagonal(a), 0, 2)
        return [(k, i, round(w, 9), round(abs(float(x[i])), 7) + 0.0, outcome) for k, (w, x, outcome) in enumerate(pairs) for i in range(len(a))]

    return by_matrix(spark, d, solve, "ordinal long, i long, value double, size double, outcome string")


@query("dense_eigenvector", f"SELECT matrix_id, CAST(i AS BIGINT) AS i, {ENTRY} AS size, 'converged' AS outcome FROM {SPECTRUM}, {PLACES} WHERE i < n AND k = 2")
def dense_eigenvector(spark, d):
    """The vector of a value that is given: the second of the spectrum."""

    def solve(a):
        x, _, outcome = solvers.eigenvector(a, 2 - 2 * float(np.cos(2 * np.pi / (len(a) + 1))))
        return [(i, round(abs(float(v)), 7) + 0.0, outcome) for i, v in enumerate(x)]

    return by_matrix(spark, d, solve, "i long, size double, outcome string")


@query("eigenvector_recovery", f"SELECT a.matrix_id AS matrix_id, round(a.w, 8) AS value, round(b.w - a.w, 7) AS gap, 'converged' AS outcome FROM {SPECTRUM} a JOIN {SPECTRUM} b ON a.matrix_id = b.matrix_id AND b.k = 2 WHERE a.k = 1")
def eigenvector_recovery(spark, d):
    def solve(a):
        value, _, gap, outcome = solvers.recovered(a, 0)
        return [(round(value, 8), round(gap, 7), outcome)]

    return by_matrix(spark, d, solve, "value double, gap double, outcome string")


@query("complete_eigensystem", f"SELECT matrix_id, k - 1 AS ordinal, round(1 / w, 7) AS value, round(1 / w, 7) AS quotient FROM {SPECTRUM}")
def complete_eigensystem(spark, d):
    """Every value of the full inverse with its own vector's Rayleigh quotient; the largest value comes first."""

    def solve(a):
        m = np.linalg.inv(a)
        w, v = linalg.jacobi(m)
        return [(len(a) - 1 - k, round(float(w[k]), 7), round(float(v[:, k] @ m @ v[:, k]), 7)) for k in range(len(a))]

    return by_matrix(spark, d, solve, "ordinal long, value double, quotient double")


@query("inertia_at_eigenvalue", f"SELECT matrix_id, count(*) FILTER (WHERE w > 2 + 1e-9) AS above, count(*) FILTER (WHERE w < 2 - 1e-9) AS below, count(*) FILTER (WHERE abs(w - 2) <= 1e-9) AS equal FROM {SPECTRUM} GROUP BY 1")
def inertia_at_eigenvalue(spark, d):
    """Exact counts at 2, where the shifted matrix has no diagonal at all and odd orders have an eigenvalue."""

    def solve(a):
        above, below, equal = exact.inertia([[int(v) for v in row] for row in a], 2)
        return [(above, below, equal)]

    return by_matrix(spark, d, solve, "above long, below long, equal long")


@query("block_subspace", f"SELECT matrix_id, k - n AS place, round(w, 7) AS value, 'converged' AS outcome FROM {SPECTRUM} WHERE k > n - 2")
def block_subspace(spark, d):
    """The two largest, from a run that is stopped after three steps and resumed from its basis."""

    def solve(a):
        _, basis, _ = solvers.block_subspace(a, 2, 3)
        w, _, outcome = solvers.block_subspace(a, 2, 20_000, basis)
        return [(k - 1, round(float(v), 7), outcome) for k, v in enumerate(w)]

    return by_matrix(spark, d, solve, "place long, value double, outcome string")


@query("lobpcg_generalized", f"SELECT matrix_id, k - 1 AS ordinal, round(w / (w + 1), 8) AS value, 'converged' AS outcome FROM {SPECTRUM} WHERE k <= 2")
def lobpcg_generalized(spark, d):
    """The two least of A x = w (A + I) x, with the diagonal as preconditioner."""

    def solve(a):
        w, _, outcome = solvers.lobpcg(a, a + np.eye(len(a)), 2, lambda r: r / np.diag(a)[:, None])
        return [(k, round(float(v), 8), outcome) for k, v in enumerate(w)]

    return by_matrix(spark, d, solve, "ordinal long, value double, outcome string")


@query("shift_invert_values", f"SELECT matrix_id, 'subspace' AS route, round(w, 7) AS value FROM {SPECTRUM} QUALIFY row_number() OVER (PARTITION BY matrix_id ORDER BY abs(w - 1.234)) <= 2 UNION ALL SELECT matrix_id, 'krylov', round(w, 7) FROM {SPECTRUM} QUALIFY row_number() OVER (PARTITION BY matrix_id ORDER BY abs(w - 1.234)) <= 2")
def shift_invert_values(spark, d):
    def solve(a):
        one, two = solvers.shift_invert(a, 1.234, 2, 20_000)[0], solvers.krylov_shift_invert(a, 1.234, 2)[0]
        return [("subspace", round(float(v), 7)) for v in one] + [("krylov", round(float(v), 7)) for v in two]

    return by_matrix(spark, d, solve, "route string, value double")


@query("thick_restart_lanczos", f"SELECT matrix_id, k - 1 AS ordinal, round(w, 7) AS value, 2::BIGINT AS counted, 'converged' AS outcome FROM {SPECTRUM} WHERE k <= 2")
def thick_restart_lanczos(spark, d):
    def solve(a):
        w, counted, outcome = solvers.thick_restart(a, 2, 5)
        return [(k, round(float(v), 7), counted, outcome) for k, v in enumerate(w)]

    return by_matrix(spark, d, solve, "ordinal long, value double, counted long, outcome string")


@query("boundary_count", f"SELECT matrix_id, count(*) FILTER (WHERE w < 0.95) AS below, count(*) FILTER (WHERE w < 0.95) AS exact_below, true AS agrees FROM {SPECTRUM} GROUP BY 1")
def boundary_count(spark, d):
    """Values under a boundary by the recurrence in doubles, against exact inertia."""

    def solve(a):
        below = solvers.count_below(*tridiagonal(a), 0.95)
        certain = exact.inertia([[int(v) for v in row] for row in a], Fraction(19, 20))[1]
        return [(int(below), int(certain), below == certain)]

    return by_matrix(spark, d, solve, "below long, exact_below long, agrees boolean")


@query("solver_cross_checks", f"SELECT matrix_id, kind, round(w, 7) AS lowest, 'agree' AS verdict FROM (SELECT matrix_id, w, unnest(['dense', 'generalized', 'precise']) AS kind FROM {SPECTRUM} WHERE k = 1) WHERE kind <> 'generalized' UNION ALL SELECT matrix_id, 'generalized', round(w / (w + 1), 7), 'agree' FROM {SPECTRUM} WHERE k = 1")
def solver_cross_checks(spark, d):
    """Pairs of independent routes: QR and rotations, LOBPCG and whitening, precise halving and precise rotations."""

    def solve(a):
        b, out = a + np.eye(len(a)), []
        two = precise.selected(np.diag(a).tolist(), np.diag(a, 1).tolist(), 0, 1, 20), precise.jacobi(a.tolist(), 20)[:2]
        for name, x, y in (
            ("dense", solvers.tridiagonal_qr(*tridiagonal(a))[0], linalg.jacobi(a)[0]),
            ("generalized", solvers.lobpcg(a, b, 2)[0], solvers.whitened(a, b)[0][:2]),
            ("precise", *(np.array([float(v) for v in t]) for t in two)),
        ):
            out.append((name, round(float(x[0]), 7), solvers.checked(x, y, 1e-7)[1]))
        return out

    return by_matrix(spark, d, solve, "kind string, lowest double, verdict string")


@query("precise_spectra", f"SELECT matrix_id, route, round(CASE WHEN route = 'whitened' THEN w / (w + 1) ELSE w END, 11) AS value FROM (SELECT matrix_id, w, unnest(['sturm', 'rotations', 'whitened', 'inverse', 'krylov']) AS route FROM {SPECTRUM} WHERE k = 1)")
def precise_spectra(spark, d):
    """The least eigenvalue at 30 digits by five solvers, shown to eleven."""

    def solve(a):
        m, b = a.tolist(), (a + np.eye(len(a))).tolist()
        found = {
            "sturm": precise.selected(np.diag(a).tolist(), np.diag(a, 1).tolist(), 0, 0, 30)[0], "rotations": precise.jacobi(m, 30)[0],
            "whitened": precise.whitened(m, b, 30)[0], "inverse": precise.nearest(m, 0, 30)[0], "krylov": precise.krylov(m, 0, 1, 30)[0],
        }
        return [(k, round(float(v), 11)) for k, v in found.items()]

    return by_matrix(spark, d, solve, "route string, value double")


@query("precise_generalized", f"SELECT matrix_id, round(w / (w + 1), 11) AS value, true AS accurate FROM {SPECTRUM} WHERE k = 1")
def precise_generalized(spark, d):
    """The least of A x = w (A + I) x by iteration in the metric of A + I, at 25 digits."""

    def solve(a):
        value, residual = precise.nearest(a.tolist(), 0, 25, (a + np.eye(len(a))).tolist())
        return [(round(float(value), 11), residual <= Decimal("1e-25"))]

    return by_matrix(spark, d, solve, "value double, accurate boolean")


@query("adaptive_precision", f"SELECT matrix_id, round(w, 11) AS value, 'accepted' AS outcome, 3::BIGINT AS attempts FROM {SPECTRUM} WHERE k = 1")
def adaptive_precision(spark, d):
    """Digits double from 10 until the residual is under 1e-30: the third attempt, at 40 digits."""

    def solve(a):
        value, outcome, attempts = precise.adaptive(lambda digits: precise.nearest(a.tolist(), 0, digits), Decimal("1e-30"))
        return [(round(float(value), 11), outcome, len(attempts))]

    return by_matrix(spark, d, solve, "value double, outcome string, attempts long")


@query("ritz_projection", f"SELECT matrix_id, i, j, a, b FROM {SIZES}, (VALUES (0, 0, 2.0::DOUBLE, 1.0::DOUBLE), (0, 1, 1, 1), (0, 2, 0, 0), (1, 0, 1, 1), (1, 1, 2, 2), (1, 2, -1, 0), (2, 0, 0, 0), (2, 1, -1, 0), (2, 2, 2, 1)) t(i, j, a, b)")
def ritz_projection(spark, d):
    """The pair of a subspace whose basis is not orthogonal: e0, e0 + e1, e2."""

    def solve(a):
        v = np.zeros((len(a), 3))
        v[0, 0] = v[0, 1] = v[1, 1] = v[2, 2] = 1
        p, q = solvers.ritz_pair(a, v)
        return [(i, j, float(p[i, j]) + 0.0, float(q[i, j]) + 0.0) for i in range(3) for j in range(3)]

    return by_matrix(spark, d, solve, "i int, j int, a double, b double")


@query("gram_schur_complement", f"SELECT s.matrix_id AS matrix_id, round(product(w + 0.5) / any_value(below), 8) AS last FROM {SPECTRUM} s JOIN (SELECT matrix_id, product(2.5 - 2 * cos(k * pi() / n)) AS below FROM {SIZES}, (SELECT unnest(range(1, 13)) AS k) WHERE k < n GROUP BY 1) b ON b.matrix_id = s.matrix_id GROUP BY 1")
def gram_schur_complement(spark, d):
    """Of the last entry of A - z G for G = I and z = -1/2: a ratio of two determinants."""
    return by_matrix(spark, d, lambda a: [(round(float(solvers.gram_schur(a, np.eye(len(a)), -0.5, len(a) - 1)[0, 0]), 8),)], "last double")


@query("modular_product", f"SELECT matrix_id, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST(CASE WHEN i = j THEN CASE WHEN i = 0 OR i = n - 1 THEN 5 ELSE 6 END WHEN abs(i - j) = 1 THEN -4 ELSE 1 END AS BIGINT) AS v FROM {SIZES}, {PLACES}, (SELECT unnest(range(0, 12)) AS j) WHERE i < n AND j < n AND abs(i - j) <= 2")
def modular_product(spark, d):
    """A times A by residues and the Chinese remainder theorem."""

    def solve(a):
        m = exact.modular_product([[int(v) for v in row] for row in a], [[int(v) for v in row] for row in a])
        return [(i, j, m[i][j]) for i in range(len(a)) for j in range(len(a)) if m[i][j]]

    return by_matrix(spark, d, solve, "i long, j long, v long")


# --- Operators on coordinate tables


@query("matrix_free_apply", "SELECT a.s_suppkey AS i, round(sum(exp(-abs(a.s_suppkey - b.s_suppkey) / 10.0) * b.s_acctbal), 4) AS v FROM supplier a, supplier b GROUP BY 1")
def matrix_free_apply(spark, d):
    """Entries are a formula of their indices; nothing is stored but the vector."""
    x = table(spark, d, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("v"))
    return linalg.matrix_free(x, lambda i, j: F.exp(-F.abs(i - j) / 10.0)).select("i", F.round("v", 4).alias("v"))


@query("composite_apply", f"SELECT w.i AS i, round(coalesce(sum(-m.v * x.x), 0) + any_value(w.x) * 3 + 0.5 * any_value(w.x) * (SELECT sum(x * x) FROM {VEC}), 2) AS v FROM {VEC} w LEFT JOIN {COO} m ON m.i = w.i LEFT JOIN {VEC} x ON x.i = m.j GROUP BY w.i")
def composite_apply(spark, d):
    """-(A - 3 I) + 0.5 x x^T on x: negated, shifted and rank-one updated without storing anything new."""
    x = vec(spark, d)
    return linalg.composite(coo(spark, d), x, sigma=3.0, sign=-1.0, rank_one=(0.5, x)).select("i", F.round("v", 2).alias("v"))


@query("diagonal_apply", "SELECT p_partkey AS i, p_size * p_retailprice AS v FROM part")
def diagonal_apply(spark, d):
    p = table(spark, d, "part")
    return linalg.diagonal_apply(p.select(F.col("p_partkey").alias("i"), F.col("p_size").cast("double").alias("v")), p.select(F.col("p_partkey").alias("i"), F.col("p_retailprice").alias("v")))


@query("stored_diagonal_apply", "SELECT p_partkey // 256 AS chunk, count(*) AS n, round(sum(p_size * p_retailprice), 3) AS total FROM part GROUP BY 1")
def stored_diagonal_apply(spark, d):
    """Chunks of 256 entries, each multiplied where it lies."""
    chunk = lambda name: linalg.chunked(table(spark, d, "part"), "p_partkey", name, 256)
    out = linalg.chunked_multiply(chunk(F.col("p_size").cast("double")), chunk(F.col("p_retailprice")))
    total = F.aggregate("entries", F.lit(0.0), lambda a, x: a + x)
    return out.select("chunk", F.size("entries").cast("long").alias("n"), F.round(total, 3).alias("total"))


@query("exact_apply", "SELECT l_orderkey AS i, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2)) * CAST(l_discount AS DECIMAL(18, 2))) AS DECIMAL(38, 4)) AS v FROM lineitem GROUP BY 1")
def exact_apply(spark, d):
    """Entries and vector as decimals: the sums are exact, whatever the partitions."""
    li = table(spark, d, "lineitem")
    m = li.select(F.col("l_orderkey").alias("i"), F.monotonically_increasing_id().alias("j"), F.col("l_extendedprice").cast("decimal(18,2)").alias("v"), F.col("l_discount").cast("decimal(18,2)").alias("x"))
    return m.groupBy("i").agg(F.sum(F.col("v") * F.col("x")).cast("decimal(38,4)").alias("v"))


@query("batch_reproducibility", f"SELECT t.task AS task, count(DISTINCT m.i) AS rows, 0::BIGINT AS different FROM {COO} m JOIN {VEC} w ON w.i = m.j, (SELECT unnest(range(0, 3)) AS task) t GROUP BY 1")
def batch_reproducibility(spark, d):
    """Two runs of a batch, dealt out differently, entry by entry in exact decimals."""
    x = vec(spark, d).select("i", F.round("v", 2).cast("decimal(18,2)").alias("v")).withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(2)).cast("array<bigint>")))
    m = coo(spark, d).select("i", "j", F.col("v").cast("decimal(18,2)").alias("v"))
    other = 2 * linalg.tasks(table(spark, d, "lineitem")) + 5
    one, two = linalg.batch(m, x, [0, 1, 2]), linalg.batch(m.repartition(other, "j"), x.repartition(5), [0, 1, 2])
    return linalg.compare_batches(one, two)


@query("restartable_assembly", "SELECT l_suppkey AS block, count(*) AS n, round(sum(l_quantity), 2) AS total, l_suppkey % 3 = 0 AS resumed FROM lineitem GROUP BY l_suppkey")
def restartable_assembly(spark, d):
    """A third of the blocks were done by an earlier run; only the others are assembled."""
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("block"), "l_quantity")
    build = lambda rows: rows.groupBy("block").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"))
    done = build(li.filter("block % 3 = 0"))
    return linalg.resumed(li, done, "block", build)


@query("fixed_block_contraction", "SELECT user_id, round(sum(value * (event_id % 11)), 6) AS dot FROM events GROUP BY user_id")
def fixed_block_contraction(spark, d):
    """Products summed exactly and rounded once."""
    e = table(spark, d, "events").select("user_id", "value", (F.col("event_id") % 11).cast("double").alias("q"))
    return linalg.block_contraction(e, "user_id", "value", "q").select("user_id", F.round("dot", 6).alias("dot"))


@query("rayleigh_components", "SELECT l_returnflag AS form, round(2 * sum(p_size * l_quantity * s_acctbal) / ((SELECT sum(p_size * p_size) FROM part) + (SELECT sum(s_acctbal * s_acctbal) FROM supplier)), 8) AS quotient FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1")
def rayleigh_components(spark, d):
    """One vector's quotient, split over the forms that add up to the operator."""
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("form"), (2 * F.col("l_partkey")).alias("i"), (2 * F.col("l_suppkey") + 1).alias("j"), F.col("l_quantity").alias("v"))
    both = li.unionByName(li.select("form", F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    return linalg.rayleigh_parts(both, vec(spark, d), "form").select("form", F.round("quotient", 8).alias("quotient"))
