"""Work tables in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; in local mode without one (tests), a fresh one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    base = f"file://{tempfile.mkdtemp(prefix='quillon-')}"
    spark.sparkContext.setCheckpointDir(base)
    return base


def fresh(spark: SparkSession, label: str) -> str:
    """A path in the work folder that nothing has."""
    return f"{folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the work folder: computed once, its lineage cut."""
    path = fresh(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(df: DataFrame, path: str, key: str, *by: str) -> None:
    """Write ``df``, one text besides ``key`` and ``by``, as a file for each row, dealt out by ``key`` over the shuffle's partitions whatever their bytes, in folders ``by``.

    Tasks move their own files to their places; else the driver would move one after the other.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(n, key) if key in by else df.repartition(n, key).drop(key)
    dealt.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(*by).text(path)
