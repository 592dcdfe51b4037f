"""JSONL chunks with manifests: written from a table, read back only if length, digest and row count hold."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranks import dense_position

#: Bytes of a row, at most.
ROW_MOST = 1 << 20
MANIFEST = "relative_path string, sha256 string, bytes long, rows long"


def write(df: DataFrame, path: str, order: list[str], rows: int) -> DataFrame:
    """Write ``df`` in order as chunk files of so many JSON lines; returns their manifest (relative_path, sha256, bytes, rows).

    A chunk is one text file that any tool can read, in a folder that bears its name; a task streams its lines in order.
    """
    body = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    placed = dense_position(df, *order).withColumn("chunk", F.floor(F.col("position") / rows)).select("chunk", "position", body.alias("line"))
    lines = placed.withColumn("relative_path", F.format_string("chunk-%06d.jsonl", "chunk")).repartition("relative_path").sortWithinPartitions("relative_path", "position")
    lines.select("line", "relative_path").write.option("lineSep", "\n").partitionBy("relative_path").text(f"{path}/chunks")
    files = _files(df.sparkSession, path)
    return files.select("relative_path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), (F.size(F.split(F.col("content").cast("string"), "\n")) - 1).cast("long").alias("rows"))


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(relative_path, length, content) of the chunk files under a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary, relative_path string"
    return spark.read.format("binaryFile").schema(schema).option("pathGlobFilter", "part-*").load(f"{path}/chunks")


def read(spark: SparkSession, path: str, manifest: DataFrame, schema: T.StructType | str, most_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with relative_path and ordinal, refusals (relative_path, reason)) of the chunks that a manifest names.

    Refused, whole: a path that leaves the folder, a chunk that is missing, longer than allowed, of another length or digest than the
    manifest says, with a row over ROW_MOST or of other than the schema's form, or with another number of rows.
    """
    named = manifest.select("relative_path", *[F.col(c).alias(f"want_{c}") for c in ("sha256", "bytes", "rows")])
    stored = _files(spark, path).select("relative_path", F.col("content").cast("string").alias("value"))
    both = named.join(stored, "relative_path", "left")
    schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    lines = F.slice(F.split("value", "\n"), 1, F.size(F.split("value", "\n")) - 1)
    parsed = F.transform(lines, lambda line: F.from_json(line, schema, {"mode": "PERMISSIVE"}))
    required = lambda r: F.forall(F.array(*[r[f.name].isNotNull() for f in schema if not f.nullable] or [F.lit(True)]), lambda x: x)
    reason = (
        F.when(F.col("relative_path").rlike(r"(^/|^[A-Za-z]:|\\|(^|/)\.\.(/|$))"), "path_escapes").when(F.col("value").isNull(), "missing")
        .when(F.lit(most_bytes is not None) & (F.octet_length("value") > (most_bytes or 0)), "too_large")
        .when(F.octet_length("value") != F.col("want_bytes"), "length_differs").when(F.sha2("value", 256) != F.col("want_sha256"), "digest_differs")
        .when(F.exists(lines, lambda x: F.octet_length(x) > ROW_MOST), "row_too_long")
        .when(F.exists(parsed, lambda r: r.isNull() | ~required(r)), "row_not_valid").when(F.size(lines) != F.col("want_rows"), "row_count_differs")
    )
    judged = both.withColumns({"reason": reason, "parsed": parsed})
    rows = judged.filter("reason IS NULL").select("relative_path", F.posexplode("parsed").alias("ordinal", "row")).select("relative_path", "ordinal", "row.*")
    return rows, judged.filter("reason IS NOT NULL").select("relative_path", "reason")


def expand(inline: DataFrame | None, chunked: DataFrame | None) -> DataFrame:
    """The rows of a table that is given inline or by chunks, never both or neither."""
    if (inline is None) == (chunked is None):
        raise ValueError("a table is given inline or by chunks")
    return inline if inline is not None else chunked


# --- Ordinates, as ordinates.py reads them


def as_doubles(numbers: DataFrame) -> DataFrame:
    """(ordinal, value); text that is no finite number is an error."""
    v = F.col("text").try_cast("double")
    good = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return numbers.select("ordinal", F.when(good, v).otherwise(F.raise_error(F.concat(F.lit("not a finite ordinate: "), F.col("text")))).alias("value"))


def at_digits(numbers: DataFrame, digits: int) -> DataFrame:
    """(ordinal, text) rounded to so many significant digits, as decimal text."""
    from ..functions.shown import round_to

    return numbers.select("ordinal", round_to("text", F.lit(digits), F.lit("nearest_even")).alias("text"))


def bounded_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches as they come, refusing a line beyond ROW_MOST."""
    for b in batches:
        if any(len(x.as_buffer() or b"") > ROW_MOST for x in b.column(0) if x.is_valid):
            raise ValueError("a line is too long")
        yield b
