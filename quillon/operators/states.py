"""Profiles and states on grids: weighted norms, geometry, comparison; matrices of special functions; files of a store."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def weighted_norm(df: DataFrame, by: list[str], u: str, weight: str, f: Column, alpha: float, g: Column | None = None) -> DataFrame:
    """(by, distance): sum of |f - g| u^-alpha times the rule's weights; g = 0 gives a norm. A sample that is not 0 but whose term vanishes is an error."""
    gap = F.abs(f - g) if g is not None else F.abs(f)
    term = gap * F.pow(F.col(u), F.lit(-alpha)) * F.col(weight)
    safe = F.when((gap > 0) & (term == 0) & (F.col(weight) > 0), F.raise_error(F.lit("a term underflows"))).otherwise(term)
    return df.groupBy(*by).agg(F.sum(safe).alias("distance"))


def geometry(df: DataFrame, state: str, shell: float) -> DataFrame:
    """``df`` with measures of a state on the uniform grid from -1 to 1: mass, second and fourth moment, mass beyond a shell, least sample, negative part.

    Shares are of the squares' sum, so the state needs no scale; nothing is shuffled.
    """
    n = F.size(state)
    x = F.col(state)
    at = lambda i: -1.0 + 2.0 * i / (n - 1)
    total = lambda f: F.aggregate(F.transform(x, f), F.lit(0.0), lambda a, v: a + v)
    mass = total(lambda v, i: v.cast("double") * v)
    share = lambda f: F.try_divide(total(f), mass)
    return df.withColumns({
        "mass": mass, "second": share(lambda v, i: at(i) * at(i) * v.cast("double") * v), "fourth": share(lambda v, i: F.pow(at(i), F.lit(4.0)) * v.cast("double") * v),
        "outer": share(lambda v, i: F.when(F.abs(at(i)) > shell, v.cast("double") * v).otherwise(0.0)), "least": F.array_min(x).cast("double"),
        "negative": share(lambda v, i: F.when(v < 0, v.cast("double") * v).otherwise(0.0)),
    })


def compared_profiles(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by, scale, residual, relative): the least-squares multiple of b that meets a, and what is left over."""
    sums = df.groupBy(*by).agg(F.sum(F.col(a) * F.col(b)).alias("ab"), F.sum(F.col(b) * F.col(b)).alias("bb"), F.sum(F.col(a) * F.col(a)).alias("aa"))
    scale = F.try_divide(F.col("ab"), F.col("bb"))
    residual = F.sqrt(F.greatest(F.lit(0.0), F.col("aa") - F.coalesce(scale, F.lit(0.0)) * F.col("ab")))
    return sums.select(*by, scale.alias("scale"), residual.alias("residual"), F.try_divide(residual, F.sqrt("aa")).alias("relative"))


def prolate_matrix(df: DataFrame, key: str, c: str, size: int) -> DataFrame:
    """(key, i, j, v) of the prolate operator on even normalised Legendre polynomials of degree 2i, for c; tridiagonal, made by expressions alone."""
    k = 2.0 * F.col("i")
    c2 = F.col(c).cast("double") * F.col(c)
    rows = df.select(key, c, F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("i"))
    diagonal = k * (k + 1) + c2 * (2 * k * (k + 1) - 1) / ((2 * k + 3) * (2 * k - 1))
    beside = c2 * (k + 2) * (k + 1) / ((2 * k + 3) * F.sqrt((2 * k + 1) * (2 * k + 5)))
    own = rows.select(key, "i", F.col("i").alias("j"), diagonal.alias("v"))
    up = rows.filter(F.col("i") < size - 1).select(key, "i", (F.col("i") + 1).alias("j"), beside.alias("v"))
    return own.unionByName(up).unionByName(up.select(key, F.col("j").alias("i"), F.col("i").alias("j"), "v"))


def positivity(ordinates: DataFrame, by: str, value: str, eps: float) -> DataFrame:
    """(by, n, least, greatest, duplicates) of the matrix eps^2 / (eps^2 + (s - t)^2) of each group's ordinates; a group is one matrix."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf[value].to_numpy(float))
        w = np.linalg.eigvalsh(eps * eps / (eps * eps + (t[:, None] - t[None, :]) ** 2))
        return pd.DataFrame({by: [key[0]], "n": [len(t)], "least": [w[0]], "greatest": [w[-1]], "duplicates": [int((np.diff(t) == 0).sum())]})

    return ordinates.groupBy(by).applyInPandas(run, f"{by} {ordinates.schema[by].dataType.simpleString()}, n long, least double, greatest double, duplicates long")


def agreement(one: DataFrame, two: DataFrame, by: list[str], ordinal: str, value: str, tolerance: float) -> DataFrame:
    """(by, n, gap, verdict) of two routes' ordered values: agree, differ, or count_differs where one has more."""
    both = one.select(*by, ordinal, F.col(value).alias("__a")).join(two.select(*by, ordinal, F.col(value).alias("__b")), [*by, ordinal], "full_outer")
    lone = F.bool_or(F.col("__a").isNull() | F.col("__b").isNull())
    gap = F.max(F.abs(F.col("__a") - F.col("__b")))
    return both.groupBy(*by).agg(F.count("*").alias("n"), gap.alias("gap"), F.when(lone, "count_differs").when(gap <= tolerance, "agree").otherwise("differ").alias("verdict"))


def file_report(spark: SparkSession, path: str, glob: str = "*.json", named: str = r"([^/]+)\.[^./]+$") -> DataFrame:
    """(name, bytes, problem) of a store's files: unreadable JSON, or a name (what ``named`` finds in the path) that is not the content's digest; sound files have none."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    name = F.regexp_extract("path", named, 1)
    text = F.decode("content", "UTF-8")
    problem = F.when(F.try_parse_json(text).isNull(), "not_json").when(F.sha2("content", 256) != name, "digest_differs")
    return raw.select(name.alias("name"), F.col("length").alias("bytes"), problem.alias("problem"))


def certificate_problems(kind: Column, digest: Column, wanted: Column, records: Column, declared: Column) -> Column:
    """Reasons against a certificate bundle's structure; its mathematical claim is not replayed, and a sound one says so."""
    found = F.array_compact(F.array(
        F.when(kind.isNull(), F.lit("kind")), F.when(~digest.eqNullSafe(wanted), F.lit("digest")), F.when(records != declared, F.lit("records")),
    ))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("claim_not_replayed")))
