"""Phase events and publication journals as streams: windowed phase totals, and an append-only journal with one state a transaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.transactions import next_phase

EVENT = "schema_version int, tx string, seq long, phase string, elapsed_seconds double, at timestamp, details map<string,string>"

def read_events(spark: SparkSession, path: str, files_per_trigger: int = 100) -> tuple[DataFrame, DataFrame]:
    """(events, lines that are no valid event) of a folder of JSON lines, as streams; bad lines are kept, not fatal."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    parsed = lines.select("value", F.from_json("value", EVENT).alias("e"))
    valid = (F.col("e.schema_version") == 1) & F.col("e.phase").isNotNull() & (F.col("e.elapsed_seconds") >= 0)
    good = F.coalesce(valid, F.lit(False))
    return parsed.filter(good).select("e.*"), parsed.filter(~good).select("value")


def phase_windows(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Calls and seconds for each phase and window; events later than the watermark are dropped by it."""
    return events.withWatermark("at", late).groupBy(F.window("at", width), "phase").agg(F.count("*").alias("calls"), F.sum("elapsed_seconds").alias("seconds"))


def journal(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each (tx, seq) once. A batch that is written again after a failure replaces its own folder, so it counts once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.select("tx", "seq", "phase", "at").dropDuplicates(["tx", "seq"]).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def states(spark: SparkSession, path: str) -> DataFrame:
    """(tx, phase, next_phase, checkpoints): the latest checkpoint of each transaction wins."""
    rows = spark.read.schema("tx string, seq long, phase string, at timestamp, batch long").parquet(path).dropDuplicates(["tx", "seq"])
    last = rows.groupBy("tx").agg(F.max_by("phase", "seq").alias("phase"), F.count("*").alias("checkpoints"))
    return last.select("tx", "phase", next_phase(F.col("phase")).alias("next_phase"), "checkpoints")
