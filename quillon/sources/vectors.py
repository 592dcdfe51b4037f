"""Stored vectors: chunks of doubles in a folder, written in two phases and read by range of indices.

A chunk holds ``CHUNK`` consecutive indices as little-endian doubles. Writing tasks each put whole chunks into files of names of their own
and tell the driver first index, length and SHA-256; only when all have, and the chunks are found to cover 0 to n - 1 once, does the driver
publish the manifest, by renaming it into place. A failed write leaves no manifest, and takes its files away. Readers plan a partition a
chunk from the manifest, leave out those that a range or a filter on the index rules out, and check length and digest of what they open.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

CHUNK = 65_536
FORMAT = "quillon_vector"
MANIFEST = "manifest.json"


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _manifest(path: str) -> dict:
    files, base = _files(path)
    try:
        with files.open_input_stream(f"{base}/{MANIFEST}") as f:
            return json.loads(f.read())
    except FileNotFoundError:
        raise ValueError("the vector was not completed") from None


@dataclass
class Written(WriterCommitMessage):
    chunks: list  # (first index, length, sha256, file)


@dataclass
class Chunk(InputPartition):
    first: int
    length: int
    sha256: str
    file: str


class Source(DataSource):
    """Options: path; from and to (the index after the last) for a range."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "i long, v double"

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options)


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.low, self.high = int(options.get("from", 0)), int(options.get("to", 1 << 62))

    def pushFilters(self, filters: list) -> Iterator:
        """Filters on the index narrow the range; Spark still applies all of them."""
        for f in filters:
            kind, at = type(f).__name__, getattr(f, "attribute", None)
            if at == ("i",) and isinstance(value := getattr(f, "value", None), int):
                low = {"EqualTo": value, "GreaterThan": value + 1, "GreaterThanOrEqual": value}.get(kind)
                high = {"EqualTo": value + 1, "LessThan": value, "LessThanOrEqual": value + 1}.get(kind)
                self.low = self.low if low is None else max(self.low, low)
                self.high = self.high if high is None else min(self.high, high)
            yield f

    def partitions(self) -> list[Chunk]:
        told = _manifest(self.path)
        return [Chunk(*c) for c in told["chunks"] if c[0] < self.high and c[0] + c[1] > self.low]

    def read(self, partition: Chunk | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no chunk holds any of it
            return
        files, base = _files(self.path)
        with files.open_input_stream(f"{base}/{partition.file}") as f:
            raw = f.read()
        if len(raw) != 8 * partition.length or hashlib.sha256(raw).hexdigest() != partition.sha256:
            raise ValueError(f"chunk {partition.file} is not what the manifest says")
        low, high = max(self.low, partition.first), min(self.high, partition.first + partition.length)
        values = np.frombuffer(raw, "<f8")[low - partition.first : high - partition.first]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(low, high)), pa.array(values)], names=["i", "v"])


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.files, self.length = f"chunks-{uuid.uuid4().hex}", int(options.get("chunk", CHUNK))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, base = _files(self.path)
        files.create_dir(f"{base}/{self.files}", recursive=True)
        done, first, held = [], None, []

        def put() -> None:
            raw = np.concatenate(held).astype("<f8").tobytes()
            name = f"{self.files}/{first // self.length:09d}-{uuid.uuid4().hex}.f64"  # a task that runs twice meets no file of its own
            with files.open_output_stream(f"{base}/{name}") as f:
                f.write(raw)
            done.append((first, len(raw) // 8, hashlib.sha256(raw).hexdigest(), name))

        for b in iterator:
            i, v = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            for lo, hi in _runs(i // self.length):
                at = int(i[lo])
                if first is None or at != first + sum(map(len, held)) or at % self.length == 0:
                    if held:
                        put()
                    first, held = at, []
                if (np.diff(i[lo:hi]) != 1).any():
                    raise ValueError("indices must follow each other inside a chunk")
                held.append(v[lo:hi])
        if held:
            put()
        return Written(done)

    def commit(self, messages: list[Written]) -> None:
        chunks = sorted(c for m in messages if m for c in m.chunks)
        n = 0
        for first, length, _, _ in chunks:
            if first != n or first % self.length:
                self.abort(messages)
                raise ValueError(f"the indices do not cover 0 to n - 1 once: {n} is followed by {first}")
            n += length
        files, base = _files(self.path)
        files.create_dir(base, recursive=True)
        with files.open_output_stream(f"{base}/{MANIFEST}.{self.files}") as f:
            f.write(json.dumps({"length": n, "chunk": self.length, "chunks": chunks}).encode())
        files.move(f"{base}/{MANIFEST}.{self.files}", f"{base}/{MANIFEST}")

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        files, base = _files(self.path)
        if files.get_file_info(f"{base}/{self.files}").type == fs.FileType.Directory:
            files.delete_dir(f"{base}/{self.files}")


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else np.zeros(1, int)
    yield from zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)


def write(df: DataFrame, path: str, index: str = "i", value: str = "v", chunk: int = CHUNK) -> str:
    """Store a vector of indices 0 to n - 1; every chunk is one task's, and a null or a gap refuses the whole."""
    df.sparkSession.dataSource.register(Source)
    rows = df.select(F.col(index).cast("long").alias("i"), F.col(value).cast("double").alias("v"))
    value_or_error = F.when(F.col("v").isNull(), F.raise_error(F.lit("a vector has no nulls"))).otherwise(F.col("v"))
    dealt = rows.select("i", value_or_error.alias("v")).repartition(F.floor(F.col("i") / chunk)).sortWithinPartitions("i")
    dealt.write.format(FORMAT).mode("append").option("path", path).option("chunk", chunk).save()
    return path


def read(spark: SparkSession, path: str, start: int = 0, stop: int | None = None) -> DataFrame:
    """(i, v) of the indices from ``start`` up to ``stop``, from the chunks that hold them and no others.

    Filters on i narrow the chunks too, for which Spark must be let: the session's switch for filters of Python sources is turned on.
    """
    spark.dataSource.register(Source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    out = spark.read.format(FORMAT).option("path", path).option("from", start)
    return (out if stop is None else out.option("to", stop)).load()
