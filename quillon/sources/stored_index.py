"""A stored index of measurements: files along a space-filling curve, with what each may hold, so that a query opens few.

Building deals the rows out along a Morton curve over (C, N, P): each column's place among ``MARKS`` quantiles gives ``BITS`` bits, which
are interleaved. A range of the curve is a file, so files cover small boxes in all three columns at once. A second pass notes for each
file the least and greatest value of the columns and, for each column, a Bloom filter in two slices of ``SLICE`` bits. The build
writes ``complete`` last; an index without it does not open.

A query of equalities first asks this table of files, then opens the files that may hold a match, and filters them.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import index_query

ORDER = ["C", "N", "P", "ordinal", "observable"]
KINDS = {"C": "string", "N": "bigint", "P": "bigint", "ordinal": "bigint", "kind": "string", "observable": "string", "outcome": "string"}
BITS = 6
MARKS = (1 << BITS) - 1
#: Bits of a slice: the size of Spark's bitmap aggregates.
SLICE = 32_768
#: Rows of a file, unless fewer files than shuffle partitions come out: what a task sorts does not grow with the index.
ROWS = 1_000_000
#: Paths of at most so many files are handed to a scan; beyond, all files are scanned and filtered.
PATHS_MOST = 20_000


class Skipped(NamedTuple):
    """Files of an index, those ruled out by their ranges, those by their filters besides, and those opened."""

    files: int
    by_range: int
    by_filter: int
    opened: int


def _numeric(name: str) -> Column:
    """A number whose order stands for a column's on the curve: C is decimal text; other text goes by its hash."""
    c = F.col(name)
    return F.coalesce(c.try_cast("double"), F.xxhash64(c).cast("double")) if KINDS[name] == "string" else c.cast("double")


def curve(df: DataFrame, columns: tuple[str, ...] = ("C", "N", "P")) -> Column:
    """The place of a row on the Morton curve; nulls come first. Draws the quantiles (MARKS numbers a column) first."""
    shares = [(k + 1) / (MARKS + 1) for k in range(MARKS)]
    marks = df.agg(*[F.percentile_approx(_numeric(c), shares, 10_000).alias(c) for c in columns]).first()
    out = F.lit(0).cast("long")
    for k, name in enumerate(columns):
        own = F.array(*map(F.lit, marks[name])) if marks[name] else F.array().cast("array<double>")
        here = _numeric(name)
        place = F.size(F.filter(own, lambda m: m <= here))  # noqa: B023
        for bit in range(BITS):
            one = F.shiftright(F.coalesce(place, F.lit(0)), bit).bitwiseAND(1).cast("long")
            out = out.bitwiseOR(F.shiftleft(one, bit * len(columns) + k))
    return out


def _bit(c: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(SLICE))


def build(measured: DataFrame, inventory: DataFrame, path: str, files: int | None = None) -> int:
    """Write an index into a folder that is not there yet; returns the number of measurements."""
    spark = measured.sparkSession
    inventory.write.mode("errorifexists").parquet(f"{path}/inventory")
    measured.write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/unsorted")
    rows = spark.read.schema(measured.schema).parquet(f"{path}/unsorted")
    files = files or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS))
    laid = rows.withColumn("__at", curve(rows)).repartitionByRange(files, "__at", *ORDER).sortWithinPartitions("__at", *ORDER).drop("__at")
    laid.write.option("compression", "zstd").parquet(f"{path}/rows")
    stored = spark.read.schema(measured.schema).parquet(f"{path}/rows").withColumn("file", F.col("_metadata.file_path"))
    notes = []
    for name in KINDS:
        notes += [F.min(name).alias(f"least_{name}"), F.max(name).alias(f"most_{name}")]
        notes += [F.expr(f"bitmap_construct_agg(CASE WHEN {name} IS NOT NULL THEN pmod(xxhash64({name}, {seed}), {SLICE}L) END)").alias(f"bits{seed}_{name}") for seed in (1, 2)]
    stored.groupBy("file").agg(F.count("*").alias("rows"), *notes).write.parquet(f"{path}/files")
    total = spark.read.parquet(f"{path}/files").agg(F.sum("rows")).first()[0] or 0
    spark.createDataFrame([(total,)], "measurements long").write.parquet(f"{path}/complete")
    return total


def _complete(spark: SparkSession, path: str) -> None:
    from pyspark.errors import AnalysisException

    try:
        spark.read.parquet(f"{path}/complete")
    except AnalysisException:
        raise ValueError("the index was not completed") from None


def query(spark: SparkSession, path: str, limit: int = 200, **equal) -> tuple[DataFrame, Skipped]:
    """(the first ``limit`` records that equal every given column, in the index's order; what the scan skipped)."""
    if limit <= 0:
        raise ValueError("the limit must be positive")
    if unknown := set(equal) - set(KINDS):
        raise ValueError(f"unknown columns {sorted(unknown)}")
    _complete(spark, path)
    equal = {k: v for k, v in equal.items() if v is not None}
    rows = spark.read.parquet(f"{path}/rows")
    inside = has = F.lit(True)
    for name, value in equal.items():
        v = F.lit(value).cast(KINDS[name])
        inside &= F.coalesce(v.between(F.col(f"least_{name}"), F.col(f"most_{name}")), F.lit(False))
        for seed in (1, 2):
            byte = F.conv(F.hex(F.substring(F.col(f"bits{seed}_{name}"), (F.floor(_bit(v, seed) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            has &= F.getbit(byte, (_bit(v, seed) % 8).cast("int")) == 1
    told = spark.read.parquet(f"{path}/files").select("file", inside.alias("inside"), has.alias("has"))
    files, ranged, both = told.agg(F.count("*"), F.count_if("inside"), F.count_if(F.col("inside") & F.col("has"))).first()
    skipped = Skipped(files, files - ranged, ranged - both, both)
    if both <= PATHS_MOST:
        paths = [r[0] for r in told.filter("inside AND has").select("file").collect()]
        rows = spark.read.schema(rows.schema).parquet(*paths) if paths else spark.createDataFrame([], rows.schema)
    return index_query(rows, limit, **{k: F.lit(v).cast(KINDS[k]) for k, v in equal.items()}), skipped


def inventory(spark: SparkSession, path: str, limit: int = 200) -> DataFrame:
    """The scanned files in order, with those that gave nothing and why."""
    _complete(spark, path)
    return spark.read.parquet(f"{path}/inventory").orderBy("path").limit(limit)
