"""Compute or reuse: results kept in a table under the digest of what they depend on."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MODES = ("disabled", "prefer_reuse", "require_reuse", "refresh", "verify")


def key_digest(*parts: Column) -> Column:
    """Digest of a canonical text of the parts; nulls differ from all values."""
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{k:03d}") for k, p in enumerate(parts)]), {"ignoreNullFields": "false"}), 256)


class ReuseTable:
    """Rows (digest, value, run) in one Parquet folder. Only keys that are not there are computed; run names the call that did."""

    def __init__(self, spark: SparkSession, path: str, value_type: str) -> None:
        self.spark, self.path, self.schema = spark, path, f"digest string, value {value_type}, run string"

    def stored(self) -> DataFrame:
        """The last result of each digest."""
        try:
            rows = self.spark.read.schema(self.schema).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], self.schema)
        return rows.groupBy("digest").agg(F.max_by("value", "run").alias("value"), F.max("run").alias("run"))

    def resolve(self, requests: DataFrame, compute: Callable[[DataFrame], DataFrame], mode: str = "prefer_reuse") -> DataFrame:
        """(digest, value, disposition: reused, computed, verified or mismatch) for requests with a digest column.

        ``compute`` maps requests to (digest, value). Refreshing appends later results, so a failed run loses nothing.
        """
        if mode not in MODES:
            raise ValueError(mode)
        asked = requests.dropDuplicates(["digest"])
        if mode == "disabled":
            return compute(asked).withColumn("disposition", F.lit("computed"))
        old = self.stored().join(asked.select("digest"), "digest", "left_semi")
        if mode == "verify":
            new = compute(asked.join(old, "digest", "left_semi")).withColumnRenamed("value", "again")
            same = F.when(F.col("value").eqNullSafe(F.col("again")), "verified").otherwise("mismatch")
            return old.join(new, "digest").select("digest", "value", same.alias("disposition"))
        absent = asked if mode == "refresh" else asked.join(old, "digest", "left_anti")
        if mode == "require_reuse":
            if not absent.isEmpty():
                raise LookupError("a result that must be reused is not stored")
            return old.select("digest", "value", F.lit("reused").alias("disposition"))
        run = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        compute(absent).select("digest", "value", F.lit(run).alias("run")).write.mode("append").parquet(self.path)
        now = self.stored().join(asked.select("digest"), "digest", "left_semi")
        return now.select("digest", "value", F.when(F.col("run") == run, "computed").otherwise("reused").alias("disposition"))
