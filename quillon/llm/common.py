"""Shared plumbing of the training-data operators: work folders, written tables, byte-wise text chunks."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables

__all__ = ["drop_table", "release", "table", "work_dir", "written", "WORD_DELIMS", "words_of", "lower_az"]

#: Rows and bytes of whole texts that a Python worker gets at a time; the default of 10,000 rows would hold very long texts many times over.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20

#: What a worker remembers between tasks, by the operator that uses it: how to forget it.
KEPT: dict[str, list[Callable[[], None]]] = {}


def kept_by(owner: str, forget: Callable[[], None]) -> None:
    """Let ``forget`` be called where a worker that served ``owner`` begins a task of another operator."""
    KEPT.setdefault(owner, []).append(forget)


def trim() -> None:
    """Give memory that nothing uses back to the system, as an idle worker would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # where there is no such call
        ctypes.CDLL(None).malloc_trim(0)


def tasks(owner: str, run: Callable) -> Callable:
    """``run`` for mapInArrow, in workers that hold no other operator's memos meanwhile and no free memory afterwards."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for other, forgets in KEPT.items():
            if other != owner:
                for forget in forgets:
                    forget()
        yield from run(batches)
        trim()

    return task


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's rows and bytes a batch, unless it asks for fewer already."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(name).removesuffix("b")
        if now.lstrip("-").isdigit() and not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A table of the input, with batches bounded."""
    bounded_batches(spark)
    return tables.table(spark, base, name)


#: Characters that separate words in every contract of this subpackage: the blank and U+0009 to U+000D.
WORD_DELIMS = " \t\n\x0b\x0c\r"


def work_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; where none is named in local mode (tests), one of our own is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = f"file://{tempfile.mkdtemp(prefix='quillon-')}"
        spark.sparkContext.setCheckpointDir(base)
    return base


def written(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it again.

    The folder's name ends in a fresh id, so that tables of two runs never meet.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.quillon_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete the files behind a DataFrame that ``written`` returned and that nothing reads any more."""
    path = getattr(df, "quillon_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nobody holds any more, instead of at some later collection."""
    gc.collect()
    spark._jvm.System.gc()


def lower_az(col):
    """Lower-case A to Z only, whatever the locale and other letters."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(col):
    """Native array of the words ``[^\\x20\\x09-\\x0D]+`` of a text column; null text has none."""
    return F.array_remove(F.split(F.coalesce(col, F.lit("")), "[ \\t-\\r]+"), "")
