"""A JSON array of texts of any size, read by many tasks.

The files of a folder, in the order of their names, are one array. Spark's reader cuts them at every quotation mark, so a task
gets the fragments of its split, but not whether they lie inside a text. Each split therefore says how many marks it has and how many
texts begin in it if it starts outside a text, and how many if it starts inside. A running sum over the splits, one row each, picks
the true one and numbers the texts; the fragments follow by their split.

Defined cases: an escaped mark ends no text, so a text may come in several fragments; escapes are undone, other texts are as they
stand; a file ends outside a text, behind its last mark; an array without texts has no rows; anything but one array of texts is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ranks import dense_position
from .work import written

FRAGMENTS = "file string, block long, nth long, text string, marks long, starts0 long, starts1 long, open boolean"


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """Fragments with the true marks before them in their split, the texts begun by then from outside or inside, and if the mark behind is escaped."""
    read = spark.read.option("lineSep", '"').text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nth, marks, begun, was_open = None, 0, 0, [0, 0], False
        for b in batches:
            rows = []
            for file, block, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (file, block) != at:
                    at, nth, marks, begun, was_open = (file, block), 0, 0, [0, 0], False
                elif not was_open:
                    marks += 1
                    begun[(marks + 1) % 2] += 1  # after so many marks, a split that began outside is inside if they are odd
                was_open = (len(text) - len(text.rstrip("\\"))) % 2 == 1
                rows.append((file, block, nth, text, marks, begun[0], begun[1], was_open))
                nth += 1
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            columns = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in FRAGMENTS.split(", ")])

    return written(read.mapInArrow(run, FRAGMENTS), "ordinates")


def ordinates(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """(ordinal from 1, text) of an array's texts, or of the first so many; fewer are an error."""
    parts = _fragments(spark, path)
    last = F.max_by(F.struct("marks", "starts0", "starts1", "open"), "nth").alias("last")
    splits = parts.groupBy("file", "block").agg(last).select("file", "block", "last.*")
    inside_file = W.partitionBy("file").orderBy("block")
    # The mark behind a split's last fragment opens or closes too, unless it is escaped.
    turned = F.coalesce(F.sum(F.col("marks") + (~F.col("open")).cast("int")).over(inside_file.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) % 2
    splits = splits.withColumns({"inside": turned, "continued": F.coalesce(F.lag("open").over(inside_file), F.lit(False))})
    begins = F.when(F.col("inside") == 1, F.col("starts1") + (~F.col("continued")).cast("int")).otherwise(F.col("starts0"))
    before = W.orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1)  # over splits, not rows
    splits = splits.withColumn("texts", begins).withColumn("offset", F.coalesce(F.sum("texts").over(before), F.lit(0)))
    splits = written(splits.select("file", "block", "inside", "continued", "texts", "offset"), "ordinate-splits")
    total = splits.agg(F.sum("texts")).first()[0] or 0

    told = parts.join(splits, ["file", "block"])
    within = (F.col("marks") + F.col("inside")) % 2 == 1
    between = told.filter(~within).groupBy(F.regexp_replace("text", "[ \\t\\r\\n]", "").alias("t")).agg(F.count("*").alias("n"))
    between = {r["t"]: r["n"] for r in between.filter(F.length("t") > 0).limit(5).collect()}
    good = {"[]": 1} if not total else {"[": 1, "]": 1} | ({",": total - 1} if total > 1 else {})
    if between != good:
        raise ValueError(f"{path} is not one JSON array of texts")
    if first is not None and total < first:
        raise ValueError(f"fewer than {first} ordinates")
    own = F.when(F.col("inside") == 1, F.col("starts1") + (~F.col("continued")).cast("int")).otherwise(F.col("starts0"))
    rows = told.filter(within).select((F.col("offset") + own).alias("ordinal"), "block", "nth", "text", "open")
    if first is not None:
        rows = rows.filter(F.col("ordinal") <= first)
    if not rows.filter("open").isEmpty():
        pieces = F.transform(F.array_sort(F.collect_list(F.struct("block", "nth", "text"))), lambda p: p["text"])
        rows = rows.groupBy("ordinal").agg(F.array_join(pieces, '"').alias("text"))
    plain = F.get(F.from_json(F.concat(F.lit('["'), "text", F.lit('"]')), "array<string>"), F.lit(0))
    return rows.select("ordinal", F.when(F.contains("text", F.lit("\\")), plain).otherwise(F.col("text")).alias("text"))


def write_ordinates(df: DataFrame, path: str, order: str, text: str) -> str:
    """A column in order as one JSON array over the files of a folder, each task writing its range."""
    placed = dense_position(df.select(F.col(order).alias("__order"), F.to_json(F.array(F.col(text))).alias("__text")), "__order")
    total = placed.count()
    body = F.expr("substring(__text, 2, length(__text) - 2)")
    lines = placed.select("position", F.concat(F.when(F.col("position") == 0, "[").otherwise(","), body, F.when(F.col("position") == total - 1, "]").otherwise("")).alias("value"))
    if not total:
        lines = df.sparkSession.createDataFrame([(0, "[]")], "position long, value string")
    lines.repartitionByRange("position").sortWithinPartitions("position").select("value").write.mode("error").text(path)
    return path


def identity(numbers: DataFrame, name: str, fan: int = 4_096) -> DataFrame:
    """One row that binds a table's name to its content: (id, sha256, count, least digits).

    Rows are digested in blocks of ``fan`` by ordinal, blocks in groups of as many, and so on up to one digest: no row ever holds more.
    """
    digits = F.length("text") - F.length(F.translate("text", "0123456789", ""))
    level = numbers.select((F.col("ordinal")).alias("at"), F.concat_ws("\n", F.col("ordinal").cast("string"), "text").alias("h"), F.lit(1).cast("long").alias("n"), digits.alias("digits"))
    glue = "\n"
    while True:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda x: x["h"]), glue)
        level = level.groupBy(F.floor(F.col("at") / fan).alias("at")).agg(F.sha2(joined, 256).alias("h"), F.sum("n").alias("n"), F.min("digits").alias("digits"))
        level = written(level, "identity")
        if glue == "" and level.limit(2).count() < 2:
            return level.select(F.lit(name).alias("id"), F.col("h").alias("sha256"), F.col("n").alias("count"), "digits")
        glue = ""
