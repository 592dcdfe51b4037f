"""Content-addressed store of payloads as tables: write-once by digest, manifests, verification, splitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import written

#: Fixed value: bytes of a part that an object is split into.
PART_BYTES = 94_371_840


def put(spark: SparkSession, root: str, objects: DataFrame, key: str, payload: str) -> DataFrame:
    """Write payloads that the store does not have yet; returns (key, digest, bytes, fresh) for each row."""
    data = objects.select(F.col(key).alias("key"), F.col(payload).cast("binary").alias("payload"))
    named = data.select("key", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("bytes"), "payload")
    have = _objects(spark, root).select("digest", F.lit(True).alias("have"))
    marked = named.join(have, "digest", "left")
    out = written(marked.select("key", "digest", "bytes", F.col("have").isNull().alias("fresh")), "store-put")  # before the store changes
    marked.filter("have IS NULL").dropDuplicates(["digest"]).select("digest", "bytes", "payload", F.substring("digest", 1, 2).alias("prefix")).write.mode("append").partitionBy("prefix").parquet(f"{root}/objects")
    return out


def _objects(spark: SparkSession, root: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    schema = "digest string, bytes long, payload binary, prefix string"
    try:
        return spark.read.schema(schema).parquet(f"{root}/objects")
    except AnalysisException:
        return spark.createDataFrame([], schema)


def fetch(spark: SparkSession, root: str, digests: DataFrame, digest: str = "digest") -> DataFrame:
    """(digest, payload, intact) of the asked digests; prefixes prune the folders that are read."""
    asked = digests.select(F.col(digest).alias("digest"), F.substring(digest, 1, 2).alias("prefix")).distinct()
    return _objects(spark, root).join(asked, ["prefix", "digest"]).select("digest", "payload", (F.sha2("payload", 256) == F.col("digest")).alias("intact"))


def missing(digests: DataFrame, local: DataFrame) -> DataFrame:
    """Digests that have to be downloaded."""
    return digests.join(local.select("digest"), "digest", "left_anti")


def parts(objects: DataFrame, digest: str = "digest", size: str = "bytes", part: int = PART_BYTES) -> DataFrame:
    """(digest, seq, start, length) of the parts that an object is split into."""
    n = F.greatest(F.lit(1), F.ceil(F.col(size) / part)).cast("int")
    cut = objects.select(digest, size, F.explode(F.sequence(F.lit(0), n - 1)).alias("seq"))
    start = F.col("seq").cast("long") * part
    return cut.select(digest, "seq", start.alias("start"), F.least(F.lit(part), F.col(size) - start).cast("long").alias("length"))


def verify(expected: DataFrame, observed: DataFrame, path: str = "path") -> DataFrame:
    """(path, problem) of a package: missing, unexpected, or different in size or digest. Sound packages give no row."""
    a = expected.select(path, F.col("bytes").alias("eb"), F.col("digest").alias("ed"), F.lit(True).alias("e"))
    b = observed.select(path, F.col("bytes").alias("ob"), F.col("digest").alias("od"), F.lit(True).alias("o"))
    problem = (
        F.when(F.col("o").isNull(), "missing").when(F.col("e").isNull(), "unexpected")
        .when(~F.col("eb").eqNullSafe(F.col("ob")), "size").when(~F.col("ed").eqNullSafe(F.col("od")), "digest")
    )
    return a.join(b, path, "full_outer").select(path, problem.alias("problem")).filter("problem IS NOT NULL")


def merge_insert(partition: DataFrame, records: DataFrame, key: list[str], value: str) -> DataFrame:
    """Insert-only merge: records that are there already change nothing, a different value for a key is a conflict."""
    both = partition.select(*key, value).unionByName(records.select(*key, value)).distinct()
    merged = both.groupBy(*key).agg(F.min(value).alias(value), F.count("*").alias("__n"))
    checked = F.when(F.col("__n") > 1, F.raise_error(F.lit("a record rewrites another"))).otherwise(F.col(value))
    return merged.select(*key, checked.alias(value))
