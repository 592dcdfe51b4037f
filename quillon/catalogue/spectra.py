"""Queries of eigensolvers on second-difference matrices, whose spectra are known in closed form."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import exact
from ..operators import linalg
from ..registry import query
from .numeric import laplacians

SPECTRUM = "(SELECT n_nationkey AS matrix_id, 5 + n_nationkey % 8 AS n, k, 2 - 2 * cos(k * pi() / (6 + n_nationkey % 8)) AS w FROM nation, (SELECT unnest(range(1, 13)) AS k) WHERE k <= 5 + n_nationkey % 8)"


def by_matrix(spark, d, solve, schema: str):
    """One result row or more from each dense matrix."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *row) for row in solve(linalg._dense(pdf))], columns=["matrix_id", *[c.split(" ")[0] for c in schema.split(", ")]])

    return laplacians(spark, d).groupBy("matrix_id").applyInPandas(run, f"matrix_id int, {schema}")


@query("inverse_iteration", f"SELECT matrix_id, round(arg_min(w, abs(w - 0.9)), 9) AS value, 'converged' AS outcome FROM {SPECTRUM} GROUP BY 1")
def inverse_iteration(spark, d):
    def solve(a):
        value, _, _, outcome = linalg.inverse_iteration(a, 0.9, 3000)
        return [(round(value, 9), outcome)]

    return by_matrix(spark, d, solve, "value double, outcome string")


@query("lanczos_lowest", f"SELECT matrix_id, round(min(w), 8) AS value FROM {SPECTRUM} GROUP BY 1")
def lanczos_lowest(spark, d):
    return by_matrix(spark, d, lambda a: [(round(float(linalg.lanczos(a, len(a))[0]), 8),)], "value double")


@query("power_iteration", f"SELECT matrix_id, round(max(w), 6) AS value FROM {SPECTRUM} GROUP BY 1")
def power_iteration(spark, d):
    def solve(a):
        x = np.arange(1.0, len(a) + 1) * (-1.0) ** np.arange(len(a))
        for _ in range(2000):
            x = a @ x
            x /= np.linalg.norm(x)
        return [(round(float(x @ a @ x), 6),)]

    return by_matrix(spark, d, solve, "value double")


@query("generalized_spectrum", f"SELECT matrix_id, k - 1 AS ordinal, round(w / (w + 1), 8) AS value FROM {SPECTRUM}")
def generalized_spectrum(spark, d):
    """A x = w (A + I) x, by Cholesky whitening."""
    return by_matrix(spark, d, lambda a: [(k, round(float(v), 8)) for k, v in enumerate(linalg.generalized(a, a + np.eye(len(a))))], "ordinal long, value double")


@query("exact_inertia", f"SELECT matrix_id, count(*) FILTER (WHERE w > 1.1) AS positive, count(*) FILTER (WHERE w < 1.1) AS negative FROM {SPECTRUM} GROUP BY 1")
def exact_inertia(spark, d):
    """By exact LDL of A - 11/10 I; no eigenvalue is computed."""

    def solve(a):
        counts = exact.inertia([[int(v) for v in row] for row in a], Fraction(11, 10))
        return [counts[:2]]

    return by_matrix(spark, d, solve, "positive long, negative long")


@query("eigenvalue_count_certificate", f"SELECT matrix_id, count(*) FILTER (WHERE w BETWEEN 0.4 AND 1.7) AS n FROM {SPECTRUM} GROUP BY 1")
def eigenvalue_count_certificate(spark, d):
    """Difference of two exact inertias."""

    def solve(a):
        m = [[int(v) for v in row] for row in a]
        return [(exact.inertia(m, Fraction(17, 10))[1] - exact.inertia(m, Fraction(2, 5))[1],)]

    return by_matrix(spark, d, solve, "n long")


@query("eigenvector_validation", f"SELECT matrix_id, k - 1 AS ordinal, CAST(i AS BIGINT) AS i, round(abs(sqrt(2.0 / (n + 1)) * sin(k * (i + 1) * pi() / (n + 1))), 8) AS size, true AS valid FROM {SPECTRUM}, (SELECT unnest(range(0, 12)) AS i) WHERE i < n")
def eigenvector_validation(spark, d):
    """Entries of unit eigenvectors (up to their sign), with whether residual and orthogonality hold."""

    def solve(a):
        w, v = linalg.jacobi(a)
        valid = bool(np.abs(a @ v - v * w).max() < 1e-10 and np.abs(v.T @ v - np.eye(len(a))).max() < 1e-10)
        return [(k, i, round(abs(float(v[i, k])), 8) + 0.0, valid) for k in range(len(a)) for i in range(len(a))]

    return by_matrix(spark, d, solve, "ordinal long, i long, size double, valid boolean")


@query("determinant_by_lu", f"SELECT matrix_id, CAST(max(n) + 1 AS DOUBLE) AS determinant FROM {SPECTRUM} GROUP BY 1")
def determinant_by_lu(spark, d):
    return by_matrix(spark, d, lambda a: [(round(float(np.linalg.det(a)), 6),)], "determinant double")


@query("schur_complement", f"SELECT matrix_id, round((max(n) + 1) / max(n)::DOUBLE, 8) AS last FROM {SPECTRUM} GROUP BY 1")
def schur_complement(spark, d):
    """Of the last entry over the leading block."""
    return by_matrix(spark, d, lambda a: [(round(float(a[-1, -1] - a[-1, :-1] @ np.linalg.solve(a[:-1, :-1], a[:-1, -1])), 8),)], "last double")


@query("leading_block_spectra", "SELECT n_nationkey AS matrix_id, k AS dimension, round(2 - 2 * cos(pi() / (k + 1)), 8) AS lowest FROM nation, (SELECT unnest(range(1, 13))::INT AS k) WHERE k <= 5 + n_nationkey % 8")
def leading_block_spectra(spark, d):
    return by_matrix(spark, d, lambda a: [(k, round(float(np.linalg.eigvalsh(a[:k, :k])[0]), 8)) for k in range(1, len(a) + 1)], "dimension int, lowest double")


@query("polynomial_root_count", "SELECT n_nationkey AS id, CAST((SELECT count(*) FROM (SELECT unnest(range(1, 6)) AS r) WHERE r <= n_nationkey / 4.0) AS BIGINT) AS roots FROM nation")
def polynomial_root_count(spark, d):
    """Sturm counts of (x-1)(x-2)(x-3)(x-4)(x-5) over (0, n/4]."""
    from ..sources.tables import table

    p = [-120, 274, -225, 85, -15, 1]

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"id": [key[0]], "roots": [exact.root_count(p, 0, Fraction(int(key[0]), 4))]})

    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id")).groupBy("id").applyInPandas(run, "id int, roots long")
