"""Bases of many columns over tables of rows: orthonormal by a tall-skinny QR tree, projectors, symmetry.

A table (i, x) of rows x with k components is a tall matrix. Every task factors its own rows; of the factors only the small triangles meet,
``FAN`` at a time, until one is left. The columns divided by it are orthonormal but for what the condition of the matrix takes away; a second
pass over them takes that back, and the loss that is left is measured and told. Only triangles of k x k pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.work import written

FAN = 16
#: Rows that a task stacks on its triangle at a time.
BLOCK = 4_096
#: Columns at most: a triangle of so many is 32 MB.
COLUMNS = 2_048


class Basis(NamedTuple):
    """(i, q) with orthonormal columns q, the triangle of the columns in them (its diagonal is positive), and max |q^T q - 1|."""

    rows: DataFrame
    triangle: np.ndarray
    loss: float


def _positive(r: np.ndarray) -> np.ndarray:
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]


def _triangle(stacked: np.ndarray, k: int) -> np.ndarray:
    r = np.linalg.qr(stacked, mode="r")
    return _positive(np.vstack([r, np.zeros((k - len(r), k))]) if len(r) < k else r)


def _numbers(column, k: int) -> np.ndarray:
    x = np.array(column.to_pylist(), np.float64).reshape(-1, k) if len(column) else np.zeros((0, k))
    if not np.isfinite(x).all():
        raise ValueError("a basis is made of finite numbers")
    return x


def triangle(rows: DataFrame, k: int) -> np.ndarray:
    """The triangle R of the rows' columns by a tree over tasks."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for b in batches:
            x = _numbers(b.column(0), k)
            for lo in range(0, len(x), BLOCK):
                own = x[lo : lo + BLOCK]
                r = _triangle(own if r is None else np.vstack([r, own]), k)
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([r.tobytes()], pa.binary())], names=["node", "r"])

    def combined(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        stacked = np.vstack([np.frombuffer(r, np.float64).reshape(k, k) for r in pdf["r"]])
        return pd.DataFrame({"node": [int(pdf["node"].iloc[0]) // FAN], "r": [_triangle(stacked, k).tobytes()]})

    level = written(rows.select("x").mapInArrow(local, "node long, r binary"), "qr")
    while level.limit(2).count() > 1:
        level = written(level.groupBy(F.floor(F.col("node") / FAN).alias("above")).applyInPandas(combined, "node long, r binary"), "qr")
    last = level.collect()
    return np.frombuffer(last[0]["r"], np.float64).reshape(k, k) if last else np.zeros((k, k))


def times(rows: DataFrame, m: np.ndarray, name: str = "x") -> DataFrame:
    """(i, name): every row times a small matrix."""
    sent = rows.sparkSession.sparkContext.broadcast(m)  # COLUMNS squared numbers at most
    kind = rows.schema["i"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = _numbers(b.column(1), sent.value.shape[0]) @ sent.value
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(y), pa.list_(pa.float64()))], names=["i", name])

    return rows.select("i", "x").mapInArrow(run, f"i {kind}, {name} array<double>")


def gram(rows: DataFrame, k: int) -> np.ndarray:
    """x^T x over all rows: a small matrix a task, added up entry by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((k, k))
        for b in batches:
            x = _numbers(b.column(0), k)
            g += x.T @ x
        at = np.arange(k * k)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(g.reshape(-1))], names=["at", "v"])

    got = rows.select("x").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()  # k squared rows
    out = np.zeros(k * k)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out.reshape(k, k)


def orthonormal(rows: DataFrame) -> Basis:
    """The orthonormal basis of the columns of (i, x); columns that depend on those before them are an error."""
    sizes = [r[0] for r in rows.select(F.size("x")).distinct().limit(2).collect()]
    if len(sizes) != 1 or not 0 < sizes[0] <= COLUMNS:
        raise ValueError(f"rows must all have the same number of components, from 1 to {COLUMNS}")
    k = sizes[0]
    rows = written(rows.select("i", F.col("x").cast("array<double>").alias("x")), "basis")
    whole = np.eye(k)
    for _ in range(2):
        r = triangle(rows, k)
        diagonal = np.abs(np.diag(r))
        if diagonal.min() <= k * np.finfo(float).eps * max(1.0, float(diagonal.max())) * 10:
            raise ValueError(f"column {int(diagonal.argmin())} depends on those before it")
        rows, whole = written(times(rows, np.linalg.inv(r)), "basis"), r @ whole
    return Basis(rows.withColumnRenamed("x", "q"), whole, float(np.abs(gram(rows.select("x"), k) - np.eye(k)).max()))


def project(basis: Basis, vector: DataFrame) -> DataFrame:
    """(i, v): the part of a vector (i, v) that lies in the basis; indices without a row in it are 0, so they are left out."""
    both = basis.rows.join(vector, "i", "left").select("i", "q", F.coalesce("v", F.lit(0.0)).alias("v"))
    weighed = both.select(F.posexplode("q").alias("k", "c"), "v").groupBy("k").agg(F.sum(F.col("c") * F.col("v")).alias("w"))
    weights = np.array([r[1] for r in weighed.orderBy("k").collect()])  # a number a column
    return times(basis.rows.withColumnRenamed("q", "x"), weights[:, None], "y").select("i", F.get("y", F.lit(0)).alias("v"))


def asymmetry(matrix: DataFrame) -> DataFrame:
    """(entries, different, largest) of a matrix (i, j, v): entries off the diagonal that differ from their mirror image, which is 0 if it is not there."""
    high, low = F.greatest("i", "j").alias("a"), F.least("i", "j").alias("b")
    signed = matrix.filter("i <> j").select(high, low, F.when(F.col("i") > F.col("j"), F.col("v")).otherwise(-F.col("v")).alias("v"))
    pairs = signed.groupBy("a", "b").agg(F.sum("v").alias("gap"), F.count("*").alias("n"))
    return pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("entries"), F.count_if(F.col("gap") != 0).alias("different"), F.coalesce(F.max(F.abs("gap")), F.lit(0.0)).alias("largest")
    )
