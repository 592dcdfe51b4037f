"""Root finding and spectra that need iteration, one group of rows for each problem."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.work import written


def newton(f: Callable, df: Callable, a: float, b: float, tolerance: float = 1e-14, steps: int = 100) -> tuple[float, str]:
    """Newton's method that halves the bracket where a step leaves it; (root, outcome)."""
    fa, fb = f(a), f(b)
    if fa == 0:
        return a, "exact"
    if fb == 0:
        return b, "exact"
    if fa * fb > 0:
        return float("nan"), "no_sign_change"
    x = (a + b) / 2
    for _ in range(steps):
        y = f(x)
        if y == 0:
            return x, "exact"
        if y * fa < 0:
            b = x
        else:
            a, fa = x, y
        slope = df(x)
        step = x - y / slope if slope else a
        new = step if a < step < b else (a + b) / 2
        if abs(new - x) <= tolerance * max(1.0, abs(x)) or b - a <= tolerance * max(1.0, abs(x)):
            return new, "converged"
        x = new
    return x, "step_limit"


#: Gaps of a task.
GAPS = 256


def secular_roots(poles: np.ndarray, weights: np.ndarray, constant: float = 1.0, gaps: slice = slice(None)) -> np.ndarray:
    """Roots of constant + sum w / (p - t), one in each gap (or in those of ``gaps``) between poles for weights of one sign, by bisection until it stands still."""
    order = np.argsort(poles)
    p, w = poles[order], weights[order]
    reach = np.abs(w).sum() / abs(constant) + 1.0
    ends = np.append(p, p[-1] + reach) if constant * w.sum() > 0 else np.append(p[0] - reach, p)
    lo, hi = ends[:-1][gaps].copy(), ends[1:][gaps].copy()
    rising = np.sign(w.sum())
    for _ in range(200):
        mid = (lo + hi) / 2
        with np.errstate(divide="ignore"):
            y = constant + (w[None, :] / (p[None, :] - mid[:, None])).sum(1)
        up = y * rising < 0
        before, lo, hi = (lo, hi), np.where(up, mid, lo), np.where(up, hi, mid)
        if np.array_equal(lo, before[0]) and np.array_equal(hi, before[1]):
            break
    return (lo + hi) / 2


def rank_one_spectrum(df: DataFrame, by: str) -> DataFrame:
    """(by, ordinal, value) of diag(d) + alpha u u^T from rows (by, d, u, alpha): secular equation, one root a gap.

    A group's poles are one list, which goes to tasks of ``GAPS`` gaps each; a task holds a table of its gaps and all poles.
    """
    kind = df.schema[by].dataType.simpleString()

    def poles(key, pdf: pd.DataFrame) -> pd.DataFrame:
        alpha = float(pdf["alpha"].iloc[0])
        moved = pdf[pdf["u"] != 0].groupby("d", as_index=False)["u"].agg(lambda u: float(np.sqrt((u**2).sum())))
        fixed = pdf[pdf["u"] == 0]["d"].tolist()
        for _, g in pdf[pdf["u"] != 0].groupby("d"):
            fixed += g["d"].tolist()[1:]  # equal entries keep all but one of their values
        d, u = moved["d"].to_numpy(), moved["u"].to_numpy()
        if not alpha or not len(d):
            return pd.DataFrame({"group": [key[0]], "poles": [[]], "weights": [[]], "fixed": [np.concatenate([d, fixed])], "start": [0]})
        starts = range(0, len(d), GAPS)
        return pd.DataFrame({"group": key[0], "poles": [d] * len(starts), "weights": [alpha * u * u] * len(starts), "fixed": [fixed, *[[]] * (len(starts) - 1)], "start": starts})

    def found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                p = np.asarray(r.poles, np.float64)
                values = secular_roots(p, np.asarray(r.weights, np.float64), gaps=slice(r.start, r.start + GAPS)) if len(p) else p
                yield pd.DataFrame({"group": r.group, "value": np.concatenate([values, np.asarray(r.fixed, np.float64)])})

    lists = df.groupBy(by).applyInPandas(poles, f"group {kind}, poles array<double>, weights array<double>, fixed array<double>, start long")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = written(lists.repartition(n, "group", "start").mapInPandas(found, f"group {kind}, value double"), "spectrum")
    return values.select(F.col("group").alias(by), (F.row_number().over(W.partitionBy("group").orderBy("value")) - 1).cast("long").alias("ordinal"), "value")


def finite_form(cutoff: int, modes: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(roots, even state, least eigenvalue) of a small finite form: prime powers, even sector, ground state, secular roots.

    The form is the prime component on cosines of ln k plus a quadratic diagonal; the roots are those of the state's
    secular function between its poles j^2.
    """
    n = np.arange(2, cutoff + 1)
    sieve = np.ones(cutoff + 1, bool)
    for p in range(2, int(cutoff**0.5) + 1):
        if sieve[p]:
            sieve[p * p :: p] = False
    primes = n[sieve[2:]]
    powers = [(p**j, np.log(p)) for p in primes.tolist() for j in range(1, cutoff.bit_length()) if p**j <= cutoff]
    k = np.arange(modes + 1)
    length = np.log(cutoff)
    a = np.diag((2 * np.pi * k / length) ** 2 + 1.0)
    for q, weight in powers:
        c = np.cos(2 * np.pi * k * np.log(q) / length)
        a -= weight / np.sqrt(q) * np.outer(c, c) / length
    w, v = np.linalg.eigh(a)
    xi = v[:, 0] * np.sign(v[np.abs(v[:, 0]).argmax(), 0])
    return secular_roots(k[1:].astype(float) ** 2, -np.abs(xi[1:]) - 1e-300, float(abs(xi[0]))), xi, float(w[0])


def refined(tasks: DataFrame, key: str, f: Callable, slope: Callable, tolerance: float = 1e-13) -> DataFrame:
    """(key, root, outcome) of brackets (key, lo, hi, parameter): Newton's method within the bracket, a batch of rows at a time.

    ``f`` and ``slope`` take (x, parameter). Rows keep their keys, so their order doesn't matter; a row that fails doesn't stop others.
    """

    def run(batches):
        for pdf in batches:
            got = [newton(lambda x, p=p: f(x, p), lambda x, p=p: slope(x, p), lo, hi, tolerance) for lo, hi, p in zip(pdf["lo"], pdf["hi"], pdf["parameter"], strict=True)]
            yield pd.DataFrame({key: pdf[key], "root": [g[0] for g in got], "outcome": [g[1] for g in got]})

    return tasks.select(key, "lo", "hi", "parameter").mapInPandas(run, f"{key} {tasks.schema[key].dataType.simpleString()}, root double, outcome string")


def between_poles(poles: DataFrame, by: str, pole: str, f: Callable, cells: int = 16, halvings: int = 60) -> DataFrame:
    """(by, lower, root) of sign changes of f strictly inside the gaps of neighbouring poles; f maps a column to a column over the rows' own.

    Each gap is scanned by so many cells that keep off its ends, so a pole's own change of sign is never taken for a root.
    """
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    from ..functions.numbers import bisect

    gaps = poles.withColumn("__next", F.lead(pole).over(W.partitionBy(by).orderBy(pole))).filter(F.col("__next") > F.col(pole))
    width, margin = F.col("__next") - F.col(pole), 1e-6
    at = lambda k: F.col(pole) + width * (margin + (1 - 2 * margin) * k / cells)
    scan = gaps.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))).withColumns({"__a": at(F.col("__k")), "__b": at(F.col("__k") + 1)})
    signed = scan.withColumns({"__fa": F.signum(f(F.col("__a"))), "__fb": F.signum(f(F.col("__b")))}).filter("__fa = 0 OR __fa * __fb < 0")
    root = F.when(F.col("__fa") == 0, F.col("__a")).otherwise(bisect(f, F.col("__a"), F.col("__b"), halvings))
    return signed.select(by, F.col(pole).alias("lower"), root.alias("root"))


def retried(tasks: DataFrame, attempt: Callable[[DataFrame, int], DataFrame], digits: tuple[int, ...]) -> DataFrame:
    """Tasks through attempts of growing precision: each attempt (tasks, digits) adds a column accepted, and only what it refused goes on.

    Attempts are written, so none is repeated; the last keeps what it refused, with accepted = false.
    """
    from pyspark.sql import functions as F

    from ..sources.work import written

    done, left = None, tasks
    for k, n in enumerate(digits):
        got = written(attempt(left, n).withColumn("digits", F.lit(n)), "retried")
        own = got if k == len(digits) - 1 else got.filter("accepted")
        done = own if done is None else done.unionByName(own)
        left = got.filter("NOT accepted").select(*tasks.columns)
        if left.isEmpty():
            break
    return done
