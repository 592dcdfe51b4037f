"""Packages, bundles and publication sinks: content-addressed parts, dependency-complete exports, tables as CSV, LaTeX and JSON."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import csv_cell, latex_cell
from ..operators import dag
from .store import parts

#: Fixed value: the time of every member of a package.
EPOCH = (1980, 1, 1, 0, 0, 0)


def zip_package(members: list[tuple[str, bytes]]) -> bytes:
    """A ZIP64-capable archive with the same bytes for the same members: sorted names, fixed times and modes, no compression."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        for name, data in sorted(members):
            info = zipfile.ZipInfo(name, EPOCH)
            info.external_attr = 0o644 << 16
            info.create_system = 3
            z.writestr(info, data)
    return out.getvalue()


def zip_store(objects: DataFrame, key: str = "key", payload: str = "payload") -> DataFrame:
    """(key, digest of the payload, package: a ZIP of one member, package_digest) for each object."""

    @F.pandas_udf("binary")
    def packed(names: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([zip_package([(f"{n}.json", bytes(b))]) for n, b in zip(names, data, strict=True)])

    data = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    out = objects.select(F.col(key).alias("key"), F.sha2(data, 256).alias("digest"), packed(F.col(key).cast("string"), data).alias("package"))
    return out.withColumn("package_digest", F.sha2("package", 256))


def zip_open(packages: DataFrame) -> DataFrame:
    """(key, payload, intact) read back out of zip_store's packages."""

    @F.pandas_udf("binary")
    def opened(data: pd.Series) -> pd.Series:
        def one(b):
            with zipfile.ZipFile(io.BytesIO(bytes(b))) as z:
                return z.read(z.namelist()[0])

        return data.map(one)

    out = packages.select("key", "digest", opened("package").alias("payload"))
    return out.select("key", "payload", (F.sha2("payload", 256) == F.col("digest")).alias("intact"))


def package(members: DataFrame, by: str, name: str, data: str) -> DataFrame:
    """(by, package, digest, members) of each group's members as one deterministic archive; a package is one group by design."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        raw = zip_package([(str(n), bytes(b) if b is not None else b"") for n, b in zip(pdf[name], pdf[data], strict=True)])
        return pd.DataFrame({by: [key[0]], "package": [raw], "members": [len(pdf)]})

    kind = members.schema[by].dataType.simpleString()
    out = members.groupBy(by).applyInPandas(run, f"{by} {kind}, package binary, members long")
    return out.withColumn("digest", F.sha2("package", 256))


def split(objects: DataFrame, key: str, data: str, size: int) -> DataFrame:
    """(key, seq, bytes of the part, part_digest, whole_digest) of binary objects cut into parts."""
    sized = objects.select(F.col(key).alias("key"), F.col(data).alias("data"), F.octet_length(data).cast("long").alias("bytes"))
    cut = parts(sized, "key", "bytes", size).join(sized.select("key", "data"), "key")
    piece = F.substring("data", (F.col("start") + 1).cast("int"), F.col("length").cast("int"))
    return cut.select("key", "seq", piece.alias("part"), F.sha2(piece, 256).alias("part_digest"), F.sha2("data", 256).alias("whole_digest"))


def reconstruct(pieces: DataFrame) -> DataFrame:
    """(key, data, problem): parts put together in order; a part or whole with another digest, or a gap, gives no data but a problem."""
    checked = pieces.withColumn("good", F.sha2("part", 256) == F.col("part_digest"))
    joined = F.array_sort(F.collect_list(F.struct("seq", "part")))
    whole = checked.groupBy("key").agg(joined.alias("p"), F.bool_and("good").alias("good"), F.max("seq").alias("last"), F.count("*").alias("n"), F.first("whole_digest").alias("want"))
    data = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["part"])), ""))
    problem = F.when(~F.col("good"), "part_digest").when(F.col("last") + 1 != F.col("n"), "part_missing").when(F.sha2(data, 256) != F.col("want"), "whole_digest")
    return whole.select("key", F.when(problem.isNull(), data).alias("data"), problem.alias("problem"))


# --- Bundles


def export_bundle(spark: SparkSession, path: str, roots: DataFrame, edges: DataFrame, artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, missing): all that the roots (column root) depend on, written as a bundle of objects and edges.

    artifacts: (node, kind, digest, payload). Nothing is written if a dependency is missing or a node has two digests.
    """
    needed = dag.closure(edges, roots).select("node").distinct()
    named = artifacts.groupBy("node").agg(F.first("kind").alias("kind"), F.min("digest").alias("digest"), F.max("digest").alias("other"), F.first("payload").alias("payload"))
    both = needed.join(named, "node", "left")
    missing = both.filter("digest IS NULL OR digest <> other").select("node", F.when(F.col("digest").isNull(), "missing").otherwise("conflict").alias("problem"))
    members = both.select("node", "kind", "digest", "payload")
    if missing.isEmpty():
        members.write.parquet(f"{path}/objects")
        edges.join(needed, "node", "left_semi").write.parquet(f"{path}/edges")
        members = spark.read.parquet(f"{path}/objects")
    return members, missing


def verify_bundle(spark: SparkSession, path: str, decode: bool = True) -> DataFrame:
    """(node, problem) of a bundle: a dependency that is not there, or (decoding) a payload of another digest."""
    objects, edges = spark.read.parquet(f"{path}/objects"), spark.read.parquet(f"{path}/edges")
    loose = edges.select(F.col("dep").alias("node")).distinct().join(objects, "node", "left_anti").select("node", F.lit("dependency_missing").alias("problem"))
    if not decode:
        return loose
    wrong = objects.filter(~F.sha2(F.coalesce(F.col("payload").cast("binary"), F.lit(b"")), 256).eqNullSafe(F.col("digest")))
    return loose.unionByName(wrong.select("node", F.lit("digest_differs").alias("problem")))


def consume(spark: SparkSession, path: str, node: str, policy: Column) -> DataFrame:
    """The artifact of a bundle that has an identity, if the policy lets it through and its payload is intact."""
    objects = spark.read.parquet(f"{path}/objects").filter(F.col("node") == node)
    return objects.filter(policy & F.sha2(F.coalesce(F.col("payload").cast("binary"), F.lit(b"")), 256).eqNullSafe(F.col("digest")))


def fetch_closure(edges: DataFrame, root: DataFrame, wanted: DataFrame, local: DataFrame) -> DataFrame:
    """(node, digest) of what a root depends on and the local store lacks; wanted: (node, digest) of every artifact."""
    needed = dag.closure(edges, root).select("node").distinct()
    return wanted.join(needed, "node", "left_semi").join(local.select("digest"), "digest", "left_anti").select("node", "digest")


# --- Publication sinks


def csv_lines(df: DataFrame) -> DataFrame:
    """(line) of each row as CSV, every value as text; null is empty."""
    cells = [F.coalesce(csv_cell(F.col(c).cast("string")), F.lit("")) for c in df.columns]
    return df.select(F.concat_ws(",", *cells).alias("line"))


def latex_rows(df: DataFrame) -> DataFrame:
    """(line) of each row of a LaTeX table body."""
    cells = [F.coalesce(latex_cell(F.col(c).cast("string")), F.lit("--")) for c in df.columns]
    return df.select(F.concat(F.concat_ws(" & ", *cells), F.lit(" \\\\")).alias("line"))


def publish(df: DataFrame, path: str, title: str) -> DataFrame:
    """Write a table as CSV, LaTeX and JSON lines, in parallel; returns the manifest (format, title, lines, checksum) read back from the files.

    The checksum adds up the lines' own digests, so that it does not depend on how files are cut.
    """
    spark = df.sparkSession
    forms = {"csv": csv_lines(df), "latex": latex_rows(df), "json": df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("line"))}
    out = None
    for name, lines in forms.items():
        lines.write.text(f"{path}/{name}")
        back = spark.read.text(f"{path}/{name}")
        row = back.agg(F.lit(name).alias("format"), F.lit(title).alias("title"), F.count("*").alias("lines"), F.sum(F.conv(F.substring(F.sha2("value", 256), 1, 8), 16, 10).cast("long")).alias("checksum"))
        out = row if out is None else out.unionByName(row)
    return out


def deposit_plan(artifacts: DataFrame, released: Column) -> DataFrame:
    """(digest, names, bytes) of what an archive takes: each released content once, with how many names it has."""
    return artifacts.filter(released).groupBy("digest").agg(F.count("*").alias("names"), F.max("bytes").alias("bytes"))


def inventory_problems(manifest: DataFrame, observed: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, problem) where an archive differs from its manifest in names or digests; nothing if it is exact."""
    a, b = manifest.select(key, F.col(digest).alias("w"), F.lit(True).alias("x")), observed.select(key, F.col(digest).alias("g"), F.lit(True).alias("y"))
    both = a.join(b, key, "full_outer")
    problem = F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "unexpected").when(~F.col("w").eqNullSafe(F.col("g")), "digest")
    return both.select(key, problem.alias("problem")).filter("problem IS NOT NULL")


def compact(df: DataFrame, keys: list[str], values: str, drop: list[str]) -> DataFrame:
    """(keys, json) of records whose map of values loses the names that begin with one of the given words."""
    kept = F.map_filter(values, lambda k, _: ~F.exists(F.array(*map(F.lit, drop)), lambda p: F.startswith(k, p)))
    return df.select(*keys, F.to_json(kept).alias("json"))
