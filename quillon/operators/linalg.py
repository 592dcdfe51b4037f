"""Linear algebra on coordinate tables (matrix_id, i, j, v) and vectors (vector_id, i, v); dense kernels by group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.work import written
from .exact_sums import exact_dots


def apply(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """(i, v) of A x for tables (i, j, v) and (i, v): one join and one aggregation, whatever the storage."""
    x = vector.select(F.col("i").alias("j"), F.col("v").alias("x"))
    return matrix.join(x, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("v"))


def mirrored(lower: DataFrame) -> DataFrame:
    """A symmetric matrix from its lower triangle."""
    return lower.unionByName(lower.filter("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))


#: Stored entries of a task, and those below which a table is not cut further.
ENTRIES, LEAST = 500_000, 50_000


def tasks(rows: DataFrame) -> int:
    """How many tasks the rows of a matrix are dealt out to: as many as the shuffle has, more where these would hold over ``ENTRIES`` each."""
    n = rows.count()
    return max(1, min(n // LEAST, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), -(-n // ENTRIES))


def assembled(parts: DataFrame, n: int | None = None) -> DataFrame:
    """(i, j, v): the matrix that parts (i, j, v) of entries add up to, dealt out by column to ``n`` tasks, so that a vector meets it where it lies."""
    return parts.repartition(n or tasks(parts), "j").groupBy("i", "j").agg(F.sum("v").alias("v"))


def banded(matrix: DataFrame, width: int) -> DataFrame:
    return matrix.filter(F.abs(F.col("i") - F.col("j")) <= width)


def shifted(matrix: DataFrame, sigma: float) -> DataFrame:
    """A - sigma I for a matrix with a stored diagonal."""
    return matrix.withColumn("v", F.when(F.col("i") == F.col("j"), F.col("v") - sigma).otherwise(F.col("v")))


def tridiagonal_apply(df: DataFrame, by: list[str], i: str, d: str, e: str, x: str) -> DataFrame:
    """Three-point stencil: e[k] couples k and k + 1."""
    w = W.partitionBy(*by).orderBy(i)
    before = F.coalesce(F.lag(F.col(e) * F.col(x)).over(w), F.lit(0.0))
    after = F.coalesce(F.col(e) * F.lead(x).over(w), F.lit(0.0))
    return df.withColumn("y", F.col(d) * F.col(x) + before + after)


def gram(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(i, j, v) of sum over rows of x_i x_j: outer products are summed inside each task before the shuffle."""

    def run(batches):
        import pyarrow as pa

        total = None
        for b in batches:
            x = np.array(b.column(0).to_pylist(), np.float64)
            if len(x):
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = (g.reshape(-1) for g in np.indices(total.shape))
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.reshape(-1))], names=["i", "j", "v"])

    return vectors.select(vector).mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def normalized(df: DataFrame, by: list[str], v: str) -> DataFrame:
    """Unit vectors; scaled by the largest entry first, so squares stay in range."""
    w = W.partitionBy(*by)
    top = F.max(F.abs(v)).over(w)
    out = df.withColumn("__t", top).withColumn("__s", F.when(F.col("__t") > 0, F.col(v) / F.col("__t")))
    return out.withColumn(v, F.col("__s") / F.sqrt(F.sum(F.col("__s") * F.col("__s")).over(w))).drop("__t", "__s")


def rayleigh(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """x^T A x / x^T x."""
    y = apply(matrix, vector).withColumnRenamed("v", "y")
    return vector.join(y, "i", "left").agg((F.sum(F.col("v") * F.coalesce("y", F.lit(0.0))) / F.sum(F.col("v") * F.col("v"))).alias("quotient"))


def _dense(pdf: pd.DataFrame) -> np.ndarray:
    n = int(max(pdf["i"].max(), pdf["j"].max())) + 1
    a = np.zeros((n, n))
    np.add.at(a, (pdf["i"], pdf["j"]), pdf["v"])
    return a


def eigenvalues(matrices: DataFrame, by: str = "matrix_id") -> DataFrame:
    """(matrix, ordinal, value) ascending for each symmetric matrix; a matrix is one group."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        w = np.linalg.eigvalsh(_dense(pdf))
        return pd.DataFrame({by: key[0], "ordinal": np.arange(len(w)), "value": w})

    return matrices.groupBy(by).applyInPandas(run, f"{by} {matrices.schema[by].dataType.simpleString()}, ordinal long, value double")


#: Rows of a matrix's or its classes' lists that are broadcast; beyond, they are joined by shuffle.
LISTED = 1_000_000


def _small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= LISTED else rows


def folded_eigenvalues(matrices: DataFrame, by: str = "matrix_id") -> DataFrame:
    """(matrix, ordinal, value) ascending for each symmetric matrix, whose entries are stored once each, in both triangles, with all of its diagonal.

    Rows that exchanging leaves as they are (equal diagonal d, equal entry a between them, equal entries elsewhere) are a class: m of them have m - 1 eigenvalues
    d - a, and the others are those of the matrix of classes. Classes are found where the entries lie, by sums of hashes of a row; only a matrix of classes is one group.
    """
    # 40 bits of a hash a summand, so that sums of 16 million stay whole numbers.
    mark = lambda *c: F.shiftright(F.xxhash64(*c), 24)
    beside = F.col("i") != F.col("j")
    signed = lambda i, v: [mark(i, v), mark(v, i)]
    one, two = signed(F.col("j"), F.col("v"))
    rows = matrices.groupBy(by, "i").agg(
        F.max(F.when(~beside, F.col("v"))).alias("own"), *[F.coalesce(F.sum(F.when(beside, x)), F.lit(0)).alias(n) for n, x in (("one", one), ("two", two), ("values", mark("v")))]
    )
    w = W.partitionBy(by, "own", "values")
    rows = written(rows.withColumn("first", F.min("i").over(w)), "rows")
    heads = rows.filter("i = first").select(by, F.col("first"), *[F.col(c).alias(f"first_{c}") for c in ("one", "two")])
    # By row alone, two numbers make one key, which is found much faster than three.
    links = matrices.join(_small(rows.filter("i <> first").select(by, "i", "first")), [by, "i"]).filter("j = first").select(by, "i", F.col("v").alias("a"))
    judged = rows.join(heads, [by, "first"]).join(links, [by, "i"], "left")
    gone, theirs = signed(F.col("first"), F.col("a")), signed(F.col("i"), F.col("a"))
    alike = (F.col("one") - gone[0] == F.col("first_one") - theirs[0]) & (F.col("two") - gone[1] == F.col("first_two") - theirs[1])
    judged = judged.withColumn("head", F.when(F.col("i") == F.col("first"), F.col("i")).when(alike, F.col("first")).otherwise(F.col("i")))
    classes = judged.groupBy(by, "head").agg(F.count("*").alias("m"), F.max("own").alias("own"), F.max("a").alias("a"))
    # Rows that only looked like their first one are classes of their own.
    classes = classes.withColumns({"place": F.row_number().over(W.partitionBy(by).orderBy("head")) - 1, "a": F.when(F.col("m") > 1, F.col("a")).otherwise(0.0)})
    classes = written(classes, "classes")
    side = lambda c, p: _small(classes.select(by, F.col("head").alias(c), *[F.col(n).alias(f"{p}_{n}") for n in ("m", "place", "a")]))
    both = matrices.join(side("i", "left"), [by, "i"]).join(side("j", "right"), [by, "j"])
    value = F.when(beside, F.sqrt(F.col("left_m").cast("double") * F.col("right_m")) * F.col("v")).otherwise(F.col("v") + (F.col("left_m") - 1) * F.col("left_a"))
    quotient = eigenvalues(both.select(by, F.col("left_place").alias("i"), F.col("right_place").alias("j"), value.alias("v")), by)
    repeated = classes.filter("m > 1").select(by, (F.col("own") - F.col("a")).alias("value"), F.explode(F.sequence(F.lit(2).cast("long"), F.col("m"))))
    values = written(quotient.select(by, "value").unionByName(repeated.select(by, "value")), "spectrum")
    return values.select(by, (F.row_number().over(W.partitionBy(by).orderBy("value")) - 1).cast("long").alias("ordinal"), "value")


def met(one: DataFrame, two: DataFrame, by: str) -> DataFrame:
    """Pairs of rows of the groups of two tables, dealt out by row of the first: about ``PAIRS`` a task, whatever the number of groups."""
    pairs = one.groupBy(by).count().join(two.groupBy(by).agg(F.count("*").alias("other")), by).agg(F.sum(F.col("count") * F.col("other"))).first()[0] or 0
    return one.repartition(max(1, min(-(-pairs // PAIRS), TASKS)), *one.columns).join(_small(two), by)


def jacobi(a: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors by cyclic rotations: an independent route to the library's."""
    a, n = a.copy(), len(a)
    v = np.eye(n)
    for _ in range(sweeps):
        off = np.sqrt((np.tril(a, -1) ** 2).sum())
        if off <= 1e-15 * max(1.0, np.abs(a).max()):
            break
        for p in range(n - 1):
            for q in range(p + 1, n):
                if a[p, q] == 0:
                    continue
                theta = (a[q, q] - a[p, p]) / (2 * a[p, q])
                t = (1 if theta >= 0 else -1) / (abs(theta) + np.hypot(theta, 1))
                c = 1 / np.hypot(t, 1)
                s = t * c
                for m in (a, a.T):
                    x, y = m[:, p].copy(), m[:, q].copy()
                    m[:, p], m[:, q] = c * x - s * y, s * x + c * y
                x, y = v[:, p].copy(), v[:, q].copy()
                v[:, p], v[:, q] = c * x - s * y, s * x + c * y
    order = np.argsort(np.diag(a))
    return np.diag(a)[order], v[:, order]


def cross_checked(matrices: DataFrame, by: str = "matrix_id", tolerance: float = 1e-9) -> DataFrame:
    """(matrix, largest difference of the two routes, ends of the spectrum by rotations, agrees)."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        a = _dense(pdf)
        own = jacobi(a)[0]
        gap = float(np.abs(np.linalg.eigvalsh(a) - own).max())
        return pd.DataFrame({by: [key[0]], "gap": [gap], "lowest": [own[0]], "highest": [own[-1]], "agrees": [gap <= tolerance * max(1.0, np.abs(a).max())]})

    return matrices.groupBy(by).applyInPandas(run, f"{by} {matrices.schema[by].dataType.simpleString()}, gap double, lowest double, highest double, agrees boolean")


def lu_solve(systems: DataFrame, by: str = "matrix_id") -> DataFrame:
    """(matrix, i, v) of A x = b by pivoted elimination, from rows (matrix, i, j, v) with j = -1 for b; singular systems give none."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        a = _dense(pdf[pdf["j"] >= 0])
        b = np.zeros(len(a))
        right = pdf[pdf["j"] < 0]
        b[right["i"].to_numpy(int)] = right["v"]
        try:
            x = np.linalg.solve(a, b)
        except np.linalg.LinAlgError:
            x = np.zeros(0)
        return pd.DataFrame({by: key[0], "i": np.arange(len(x)), "v": x})

    return systems.groupBy(by).applyInPandas(run, f"{by} {systems.schema[by].dataType.simpleString()}, i long, v double")


def inverse_iteration(a: np.ndarray, shift: float, steps: int = 50, tolerance: float = 1e-13) -> tuple[float, np.ndarray, float, str]:
    """(value, vector, residual, outcome) of the eigenpair nearest to a shift."""
    n = len(a)
    x = np.ones(n) / np.sqrt(n) + np.arange(n) * 1e-3
    for _ in range(steps):
        try:
            y = np.linalg.solve(a - shift * np.eye(n), x)
        except np.linalg.LinAlgError:
            shift += 1e-12 * max(1.0, abs(shift))
            continue
        x = y / np.linalg.norm(y)
        value = float(x @ a @ x)
        residual = float(np.linalg.norm(a @ x - value * x))
        if residual <= tolerance * max(1.0, np.abs(a).max()):
            return value, x, residual, "converged"
    return value, x, residual, "step_limit"


def lanczos(a: np.ndarray, k: int) -> np.ndarray:
    """Ritz values after k steps with full reorthogonalisation."""
    n = len(a)
    q = np.zeros((n, k + 1))
    q[:, 0] = np.ones(n) / np.sqrt(n)
    d, e = [], []
    for j in range(k):
        w = a @ q[:, j]
        d.append(float(q[:, j] @ w))
        for _ in range(2):
            w -= q[:, : j + 1] @ (q[:, : j + 1].T @ w)
        b = float(np.linalg.norm(w))
        if b < 1e-12:
            break
        e.append(b)
        q[:, j + 1] = w / b
    e = e[: len(d) - 1]
    return np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))


def generalized(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Eigenvalues of A x = w B x by Cholesky whitening."""
    low = np.linalg.cholesky(b)
    c = np.linalg.solve(low, np.linalg.solve(low, a).T)
    return np.linalg.eigvalsh((c + c.T) / 2)


#: Pairs of a task, and tasks at most.
PAIRS, TASKS = 20_000_000, 20_000


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt out by a key so that each task meets about ``PAIRS`` pairs of them with themselves: what is to be paired is small where it is stored."""
    n = rows.count()
    return rows.repartition(max(1, min(n, -(-n * n // PAIRS), TASKS)), key)


def matrix_free(vector: DataFrame, entry) -> DataFrame:
    """(i, v) of A x for entries given by a function of two index columns. Every pair is computed, as the operator says; no side is stored."""
    return dealt(vector.select("i"), "i").join(vector.select(F.col("i").alias("j"), F.col("v").alias("x"))).groupBy("i").agg(F.sum(entry(F.col("i"), F.col("j")) * F.col("x")).alias("v"))


def composite(matrix: DataFrame, vector: DataFrame, sigma: float = 0.0, sign: float = 1.0, rank_one: tuple[float, DataFrame] | None = None) -> DataFrame:
    """(i, v) of (sign (A - sigma I) + alpha u u^T) x; the rank-one part needs one number, u^T x."""
    y = apply(matrix, vector).withColumnRenamed("v", "y")
    out = vector.join(y, "i", "left").select("i", (F.lit(sign) * (F.coalesce("y", F.lit(0.0)) - sigma * F.col("v"))).alias("v"))
    if rank_one is None:
        return out
    alpha, u = rank_one
    u = u.select("i", F.col("v").alias("u"))
    dot = u.join(vector, "i").agg(F.sum(F.col("u") * F.col("v")).alias("dot"))
    return out.join(u, "i", "left").crossJoin(F.broadcast(dot)).select("i", (F.col("v") + alpha * F.coalesce("u", F.lit(0.0)) * F.col("dot")).alias("v"))  # one row


def diagonal_apply(diagonal: DataFrame, vector: DataFrame) -> DataFrame:
    return diagonal.join(vector.select("i", F.col("v").alias("x")), "i").select("i", (F.col("v") * F.col("x")).alias("v"))


def chunked(df: DataFrame, index: str, value, size: int) -> DataFrame:
    """(chunk, entries: values in order) of a vector stored by chunks of at most ``size`` entries."""
    rows = df.select(F.floor(F.col(index) / size).alias("chunk"), F.struct(F.col(index).alias("i"), value.alias("v")).alias("e"))
    return rows.groupBy("chunk").agg(F.transform(F.array_sort(F.collect_list("e")), lambda x: x["v"]).alias("entries"))


def chunked_multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Entry by entry, chunk by chunk."""
    return a.join(b.select("chunk", F.col("entries").alias("other")), "chunk").select("chunk", F.zip_with("entries", "other", lambda x, y: x * y).alias("entries"))


def batch(matrix: DataFrame, vectors: DataFrame, among: list | None = None) -> DataFrame:
    """(task, i, v) of A x for the vectors (task, i, v) of many tasks. If ``among`` names them all, their sums stand side by side, so that an entry is met once."""
    x = vectors.select("task", F.col("i").alias("j"), F.col("v").alias("x"))
    if among is None:
        return matrix.join(x, "j").groupBy("task", "i").agg(F.sum(F.col("v") * F.col("x")).alias("v"))
    wide = x.groupBy("j").agg(*[F.max(F.when(F.col("task") == t, F.struct("x"))).alias(f"x{k}") for k, t in enumerate(among)])
    cell = [F.struct(F.sum(F.col("v") * F.col(f"x{k}.x")).alias("v"), F.count(f"x{k}").alias("n"), F.lit(t).cast(vectors.schema["task"].dataType).alias("task")) for k, t in enumerate(among)]
    sums = matrix.join(wide, "j").groupBy("i").agg(F.array(*cell).alias("cells"))
    return sums.select("i", F.explode("cells").alias("c")).filter("c.n > 0").select("c.task", "i", "c.v")


def compare_batches(one: DataFrame, two: DataFrame) -> DataFrame:
    """(task, rows, different) of two runs: entries that differ in any bit or that one run lacks."""
    both = one.join(two.select("task", "i", F.col("v").alias("w")), ["task", "i"], "full_outer")
    return both.groupBy("task").agg(F.count("*").alias("rows"), F.count_if(~F.col("v").eqNullSafe(F.col("w"))).alias("different"))


def resumed(rows: DataFrame, done: DataFrame, by: str, build) -> DataFrame:
    """Blocks of an earlier run and those that ``build`` makes of the rows whose block is not done, with which is which."""
    fresh = build(rows.join(done.select(by), by, "left_anti"))
    return done.withColumn("resumed", F.lit(True)).unionByName(fresh.withColumn("resumed", F.lit(False)))


def block_contraction(df: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """(by, dot): the products' exact sum, rounded once: the same bits for every order, block and partitioning."""
    return exact_dots(df, [by], dot=(F.col(a), F.col(b)))


def rayleigh_parts(forms: DataFrame, vector: DataFrame, by: str) -> DataFrame:
    """(form, quotient) of x^T A_k x / x^T x for forms (form, i, j, v)."""
    left, right = vector.select("i", F.col("v").alias("x")), vector.select(F.col("i").alias("j"), F.col("v").alias("y"))
    size = vector.agg(F.sum(F.col("v") * F.col("v")).alias("size"))
    top = forms.join(left, "i").join(right, "j").groupBy(by).agg(F.sum(F.col("x") * F.col("v") * F.col("y")).alias("top"))
    return top.crossJoin(F.broadcast(size)).select(by, (F.col("top") / F.col("size")).alias("quotient"))  # one row
