"""Ladders of leading blocks of stored symmetric matrices of any size: pivots and inverse moments by a table of panels.

A matrix (family, i, j, value) is cut into panels of ``PANEL`` rows and each panel into square blocks, a row of a table each. A round takes the next panel of
all families at once: its blocks meet the inverse factor's finished panels in joins, what is left of its own block is factored in one task, and
its row of the inverse factor is written and read back. With the inverse factor W of the Cholesky factor, the leading block of dimension n has the same
moments as the first n rows of G = W W', so the traces of the inverse, its square and its cube grow by what row n of G adds.

Products are summed inside their task before they are shuffled, and no task holds more than the blocks of one panel.
A folder makes a run resumable: finished rounds found there are read, if they belong to the same matrices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.work import fresh, written

#: Rows of a panel; a block is 128 KB.
PANEL = 128
#: Dimensions at most: a panel of so many columns is 128 MB. Larger matrices are refused.
MOST = 131_072
#: Sums that a task keeps before it passes them on (8 MB).
KEPT = 64

BLOCK = "family string, i long, j long, b binary"
FACTOR = "family string, i long, b binary, pivots array<double>, failed double"


def _block(b: bytes, width: int) -> np.ndarray:
    return np.frombuffer(b, np.float64).reshape(width, width)


def _summed(df: DataFrame, product: Callable, width: int) -> DataFrame:
    """Sums of ``product(row)`` by the family, i and j of the rows: inside the tasks first."""

    def inside(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}

        def out() -> pd.DataFrame:
            return pd.DataFrame([(*k, v.tobytes()) for k, v in sums.items()], columns=["family", "i", "j", "b"])

        for pdf in frames:
            for r in pdf.itertuples():
                key = (r.family, int(r.i), int(r.j))
                sums[key] = sums[key] + product(r) if key in sums else product(r)
                if len(sums) > KEPT:
                    yield out()
                    sums = {}
        yield out()

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([_block(b, width) for b in pdf["b"]], axis=0)
        return pdf[["family", "i", "j"]].iloc[:1].assign(b=[total.tobytes()])

    return df.mapInPandas(inside, BLOCK).groupBy("family", "i", "j").applyInPandas(across, BLOCK)


def factored(a: np.ndarray, margin: float, scale: np.ndarray) -> tuple[np.ndarray, list[float], float | None]:
    """The inverse Cholesky factor of ``a``, its pivots, and the pivot that failed: one that is not over ``margin`` times its row's ``scale``.

    Rows from the failed one on are 0 in the factor.
    """
    a, n = a.copy(), len(a)
    lower, pivots, failed = np.zeros((n, n)), [], None
    for k in range(n):
        p = float(a[k, k])
        if not p > margin * scale[k]:
            failed = p
            break
        pivots.append(p)
        lower[k:, k] = a[k:, k] / np.sqrt(p)
        a[k:, k:] -= np.outer(lower[k:, k], lower[k:, k])
    m, inverse = len(pivots), np.zeros((n, n))
    for k in range(m):
        inverse[k, k] = 1.0
        inverse[k, :k] = -lower[k, :k] @ inverse[:k, :k]
        inverse[k] /= lower[k, k]
    return inverse, pivots, failed


def _entries(entries: DataFrame, by: list[str]) -> DataFrame:
    """Entries of one place summed; refused unless whole, finite and symmetric."""
    family = F.to_json(F.struct(*[F.col(c) for c in by]), {"ignoreNullFields": "false"})
    kept = entries.select(family.alias("family"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("value").cast("double").alias("value"))
    sums = written(kept.groupBy("family", "i", "j").agg(F.sum(F.coalesce("value", F.lit(float("nan")))).alias("value")), "panel-entries")
    good = F.coalesce((F.col("i") >= 0) & (F.col("j") >= 0) & (F.col("i") < MOST) & (F.col("j") < MOST) & (F.abs("value") < float("inf")), F.lit(False))
    if not sums.filter(~good).isEmpty():
        raise ValueError(f"entries must be finite, in rows and columns from 0 to {MOST - 1}")
    pairs = sums.filter("i <> j").groupBy("family", F.greatest("i", "j").alias("i"), F.least("i", "j").alias("j"))
    odd = pairs.agg(F.count("*").alias("n"), F.min("value").alias("a"), F.max("value").alias("b")).filter("a <> b OR n = 1 AND a <> 0")
    if not odd.isEmpty():
        raise ValueError("a matrix must be symmetric exactly, with both of its triangles")
    return sums


def _round(spark, path: str, mark: str, make: Callable[[], None]) -> None:
    """Run ``make`` unless a marker says that it is done; the marker is written last."""
    try:
        found = spark.read.schema("mark string").parquet(f"{path}-done").first()
    except AnalysisException:
        found = None
    if found is not None and found[0] != mark:
        raise ValueError("the folder holds rounds of other matrices, panels or margins")
    if found is None:
        make()
        spark.range(1).select(F.lit(mark).alias("mark")).coalesce(1).write.mode("overwrite").parquet(f"{path}-done")


def ladder(entries: DataFrame, by: list[str], *, margin: float = 1e-12, third: bool = True, panel: int | None = None, folder: str | None = None) -> DataFrame:
    """A row for each leading block of each family: ``dimension``, ``pivot``, ``mass`` (squared length of the innovation), ``trace``, ``square_trace`` and, if ``third``, ``cube_trace`` of its inverse.

    ``entries`` has the columns ``by``, i, j (from 0) and value; both triangles, equal exactly; entries of one place are added; a matrix is as large as its largest index. A ladder stops at a pivot that is
    not over ``margin`` times the diagonal entry's size: the rows before stay, one more row has ``stopped`` true, the pivot, and nulls. Null families are families like others.
    Entries that are null or not finite, and matrices that are not symmetric or larger than ``MOST``, are refused. An empty table gives an empty result.
    """
    spark, width = entries.sparkSession, panel or PANEL
    sums = _entries(entries, by)
    sizes = written(sums.groupBy("family").agg((F.max(F.greatest("i", "j")) + 1).alias("n")), "panel-sizes")
    most = sizes.agg(F.max("n")).first()[0] or 0
    whole = sums.agg(F.count("*"), F.sum(F.xxhash64("family", "i", "j", "value").cast("decimal(38,0)"))).first()
    mark, folder = f"{width} {margin!r} {whole[0]} {whole[1]}", folder or fresh(spark, "panels")

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        a, first = np.zeros((width, width)), pdf.iloc[0]
        np.add.at(a, (pdf["i"].to_numpy() % width, pdf["j"].to_numpy() % width), pdf["value"].to_numpy())
        row, column = int(first["i"]) // width, int(first["j"]) // width
        if row == column:  # rows beyond the matrix are those of the unit matrix
            past = np.arange(width) + row * width >= first["n"]
            a[past, past] = 1.0
        return pd.DataFrame([(first["family"], row, column, a.tobytes())], columns=["family", "i", "j", "b"])

    corner = sizes.select("family", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(width).cast("long"))).alias("i"))
    full = sums.unionByName(corner.select("family", "i", F.col("i").alias("j"), F.lit(0.0).alias("value"))).join(sizes, "family")
    lower = full.filter(F.floor(F.col("i") / width) >= F.floor(F.col("j") / width))
    a = written(lower.groupBy("family", F.floor(F.col("i") / width).alias("bi"), F.floor(F.col("j") / width).alias("bj")).applyInPandas(cut, BLOCK), "panel-blocks")

    def times_transposed(r) -> np.ndarray:
        return _block(r.b, width) @ _block(r.c, width).T

    def times(r) -> np.ndarray:
        return _block(r.b, width) @ _block(r.c, width)

    def remaining(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                own = _block(r.b, width)
                left = own - _block(r.c, width) if r.c is not None else own
                inverse, pivots, failed = factored(left, margin, np.abs(np.diag(own)))
                real = pivots[: int(r.n) - int(r.i) * width]
                out.append((r.family, r.i, inverse.tobytes(), real, failed))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FACTOR.split(", ")])

    def turned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf[["family", "i", "j"]].assign(b=[(-_block(f, width) @ _block(b, width)).tobytes() for f, b in zip(pdf["f"], pdf["b"], strict=True)])

    panels = -(-most // width)
    inverse = factors = None
    for k in range(panels):
        path = f"{folder}/{k}"

        def make(k: int = k, path: str = path, inverse=inverse, factors=factors) -> None:
            row = a.filter(F.col("i") == k)
            if k:
                stopped = factors.filter("failed IS NOT NULL").select("family")
                row = row.join(stopped, "family", "left_anti")
                done = inverse.select("family", F.col("i").alias("wi"), F.col("j").alias("wj"), F.col("b").alias("c"))
                across = row.filter(F.col("j") < k).join(done.withColumnRenamed("wj", "j"), ["family", "j"]).select("family", "i", F.col("wi").alias("j"), "b", "c")
                c = written(_summed(across, times_transposed, width), "panel-row")
                own = _summed(c.select("family", "i", F.col("i").alias("j"), "b", F.col("b").alias("c")), times_transposed, width).select("family", F.col("b").alias("c"))
                first = row.filter(F.col("j") == k).join(own, "family", "left")
            else:
                first = row.withColumn("c", F.lit(None).cast("binary"))
            first.join(sizes, "family").select("family", "i", "n", "b", "c").mapInPandas(remaining, FACTOR).write.mode("overwrite").parquet(f"{path}-factor")
            factor = spark.read.schema(FACTOR).parquet(f"{path}-factor")
            own = factor.select("family", "i", F.col("i").alias("j"), "b")
            if k:
                meet = c.join(done.withColumnRenamed("wi", "j").withColumnRenamed("wj", "to"), ["family", "j"]).select("family", "i", F.col("to").alias("j"), "b", "c")
                left = _summed(meet, times, width).join(factor.select("family", F.col("b").alias("f")), "family")
                own = own.unionByName(left.select("family", "i", "j", "f", "b").mapInPandas(turned, BLOCK))
            own.write.mode("overwrite").parquet(f"{path}-inverse")

        _round(spark, path, mark, make)
        inverse = spark.read.schema(BLOCK).parquet(*[f"{folder}/{p}-inverse" for p in range(k + 1)])
        factors = spark.read.schema(FACTOR).parquet(*[f"{folder}/{p}-factor" for p in range(k + 1)])
    types = ", ".join(f"`{c}` {entries.schema[c].dataType.simpleString()}" for c in by)
    columns = ["dimension", "pivot", "mass", "trace", "square_trace"] + (["cube_trace"] if third else []) + ["stopped"]
    if not panels:
        return spark.createDataFrame([], f"{types}, dimension long, {', '.join(f'{c} double' for c in columns[1:-1])}, stopped boolean")
    return _moments(inverse, factors, types, width, third).select("f.*", *columns)


def _moments(inverse: DataFrame, factors: DataFrame, types: str, width: int, third: bool) -> DataFrame:
    left = inverse.select("family", "i", F.col("j").alias("p"), "b")
    right = inverse.select("family", F.col("i").alias("j"), F.col("j").alias("p"), F.col("b").alias("c"))
    pairs = left.join(right, ["family", "p"]).filter("i >= j").select("family", "i", "j", "b", "c")
    g = written(_summed(pairs, lambda r: _block(r.b, width) @ _block(r.c, width).T, width), "panel-gram")
    schema = "family string, i long, g1 array<double>, g2 array<double>, g3 array<double>"

    def rows(f: Callable) -> Callable:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                yield pd.DataFrame([(r.family, r.i, *f(r)) for r in pdf.itertuples()], columns=["family", "i", "g1", "g2", "g3"])

        return run

    zero = np.zeros(width)

    def plain(r) -> tuple:
        b = _block(r.b, width)
        if r.i > r.j:
            return zero, 2 * (b * b).sum(axis=1), zero
        d, before = np.diag(b), np.tril(b, -1)
        cube = d**3 + 3 * d * (before * before).sum(axis=1)
        for n in range(1, width):
            cube[n] += 3 * b[n, :n] @ b[:n, :n] @ b[n, :n]
        return d, d * d + 2 * (before * before).sum(axis=1), cube

    def mixed(r) -> tuple:
        """A panel's own block with Q, the products of its rows before it."""
        b, q = _block(r.b, width), _block(r.c, width)
        return zero, zero, 6 * (np.tril(b, -1) * q).sum(axis=1) + 3 * np.diag(b) * np.diag(q)

    def deep(r) -> tuple:
        twice = 2 if r.p > r.j else 1
        return zero, zero, 3 * twice * ((_block(r.b, width) @ _block(r.m, width)) * _block(r.c, width)).sum(axis=1)

    parts = [g.mapInPandas(rows(plain), schema)]
    if third:
        before = g.filter("j < i")
        q = _summed(before.select("family", "i", F.col("i").alias("j"), "b", F.col("b").alias("c")), lambda r: _block(r.b, width) @ _block(r.c, width).T, width)
        parts.append(g.filter("i = j").join(q.select("family", "i", F.col("b").alias("c")), ["family", "i"]).mapInPandas(rows(mixed), schema))
        inner = before.select("family", "i", F.col("j").alias("p"), "b").join(g.select("family", F.col("i").alias("p"), "j", F.col("b").alias("m")), ["family", "p"])
        deepest = inner.join(before.select("family", "i", "j", F.col("b").alias("c")), ["family", "i", "j"])
        parts.append(deepest.mapInPandas(rows(deep), schema))
    each = F.posexplode(F.arrays_zip("g1", "g2", "g3")).alias("k", "g")
    adds = reduce(DataFrame.unionByName, parts).select("family", "i", each).groupBy("family", (F.col("i") * width + F.col("k") + 1).alias("dimension"))
    adds = adds.agg(*[F.sum(f"g.{c}").alias(c) for c in ("g1", "g2", "g3")])
    pivots = factors.select("family", (F.col("i") * width).alias("base"), F.posexplode("pivots").alias("k", "pivot")).select("family", (F.col("base") + F.col("k") + 1).alias("dimension"), "pivot")
    ahead = W.partitionBy("family").orderBy("dimension").rowsBetween(W.unboundedPreceding, 0)  # a family has at most MOST rows here

    def running(c: str) -> Column:
        return F.sum(c).over(ahead)

    good = pivots.join(adds, ["family", "dimension"]).select(
        "family", "dimension", "pivot", (F.col("g1") * F.col("pivot")).alias("mass"), running("g1").alias("trace"), running("g2").alias("square_trace"), running("g3").alias("cube_trace"), F.lit(False).alias("stopped")
    )
    none = F.lit(None).cast("double")
    bad = factors.filter("failed IS NOT NULL").select(
        "family", (F.col("i") * width + F.size("pivots") + 1).alias("dimension"), F.col("failed").alias("pivot"), *[none.alias(c) for c in ("mass", "trace", "square_trace", "cube_trace")], F.lit(True).alias("stopped")
    )
    return good.unionByName(bad).withColumn("f", F.from_json("family", types))
