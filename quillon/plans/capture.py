"""Runs of several diagnostics that fail by themselves, shared results of a run, saved runs that are replayed."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.work import fresh, written

RECEIPT = "diagnostic string, outcome string, rows long, path string, reason string"


def capture(spark: SparkSession, diagnostics: dict[str, Callable[[], DataFrame]], root: str | None = None, *, keys: dict[str, str] | None = None, side_by_side: int = 4) -> DataFrame:
    """A receipt (diagnostic, outcome, rows, path, reason) of each diagnostic: its table is written, or its failure noted; none stops the others.

    Tables go under ``root`` (private to the run), or into the work folder. Up to ``side_by_side`` diagnostics run at a time, each in a pool of its own name. With ``keys``, digests of
    all that a diagnostic depends on, ``root`` is a folder that runs share: a table that an earlier run finished under the same key is ``reused``; one
    that a run left unfinished is written anew. A diagnostic without a key is always computed.
    """
    if keys is not None and root is None:
        raise ValueError("tables are reused from a folder that runs share")

    def one(name: str) -> tuple:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        key = (keys or {}).get(name)
        path = fresh(spark, f"capture-{name}") if not root else f"{root}/{name}-{key}" if key else f"{root}/{name}" if keys is None else f"{root}/{name}-{uuid.uuid4().hex}"
        try:
            if key and (rows := _finished(spark, path)) is not None:
                return name, "reused", rows, path, None
            make = diagnostics[name]()
            (make.write.mode("overwrite") if key else make.write).parquet(path)
            rows = spark.read.schema(make.schema).parquet(path).count()
            if key:  # written last, so that it stands for a whole table
                spark.range(1).select(F.lit(rows).cast("long").alias("rows")).coalesce(1).write.mode("overwrite").parquet(f"{path}-finished")
            return name, "captured", rows, path, None
        except Exception as e:  # noqa: BLE001 - whatever a diagnostic raises is its outcome
            return name, "failed", None, None, type(e).__name__
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max_workers=max(1, side_by_side)) as pool:
        rows = list(pool.map(inheritable_thread_target(spark)(one), diagnostics))
    return spark.createDataFrame(rows, RECEIPT)


def _finished(spark: SparkSession, path: str) -> int | None:
    try:
        found = spark.read.schema("rows long").parquet(f"{path}-finished").first()
    except AnalysisException:
        return None
    return None if found is None else found[0]


class Memo:
    """Results of a run, by key and type: each is computed once, validated, and shared by all that ask; a failed one is not kept."""

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._done: dict = {}

    def get(self, key: str, kind: type, compute: Callable[[], object], validate: Callable[[object], bool] = lambda _: True) -> object:
        with self._lock:
            if (key, kind) not in self._done:
                value = compute()
                if not isinstance(value, kind):
                    raise TypeError(f"{key} is no {kind.__name__}")
                if not validate(value):
                    raise ValueError(f"{key} is not valid")
                self._done[key, kind] = value
            return self._done[key, kind]


def saved(df: DataFrame) -> DataFrame:
    """A run's table, written, to be compared with later runs."""
    return written(df, "saved-run")


def reproduced(saved_run: DataFrame, again: DataFrame) -> DataFrame:
    """(saved, again, lost, gained): rows of either run and those that the other lacks, bit by bit."""
    columns = sorted(saved_run.columns)
    a, b = saved_run.select(*columns), again.select(*columns)
    both = a.withColumn("s", F.lit(1)).withColumn("g", F.lit(0)).unionByName(b.withColumn("s", F.lit(0)).withColumn("g", F.lit(1)))
    per = both.groupBy(*columns).agg(F.sum("s").alias("s"), F.sum("g").alias("g"))
    return per.agg(
        F.coalesce(F.sum("s"), F.lit(0)).alias("saved"), F.coalesce(F.sum("g"), F.lit(0)).alias("again"),
        F.coalesce(F.sum(F.greatest(F.col("s") - F.col("g"), F.lit(0))), F.lit(0)).alias("lost"), F.coalesce(F.sum(F.greatest(F.col("g") - F.col("s"), F.lit(0))), F.lit(0)).alias("gained"),
    )
