"""Token counts through a digest cache.

A text's normal form (null becomes empty, else the text itself, as the tokenizer tells all other texts apart) has a
SHA-256; so has a tokenizer: its file, its library and that library's version. Stored counts are joined by both digests. Only
the distinct texts that no stored count answers are encoded, and their counts are appended to the cache. The cache is a
folder of Parquet tables, one a tokenizer version: an append becomes visible as a whole or not at all, and counts
that two runs append twice are equal, so the reader keeps either.

No digest is dealt to one task: texts are counted by digest before they move (copies meet in the map side), and those
that more than a ``HOT_SHARE``-th of all rows hold, of which there are fewer than ``HOT_SHARE``, are joined by broadcast.

Texts are counted run by run: a white-space character between two others begins a new piece of the byte-level
pattern, so what lies between such places is encoded by the library once and remembered in a bounded memo. Texts that hold
an added token's string or U+001C to U+001F, and all texts of files with another way of splitting, go through whole.

Defined cases: null and empty texts have 0 bytes and 0 tokens; special strings inside texts count as the library's
default has them; texts of any length are counted whole; repeated rows and null ids each keep a row; an empty table
gives an empty result and leaves the cache as it was; columns other than the key and the text are not passed on, so no
names can clash.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from importlib.metadata import version

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, kept_by, tasks, work_dir, written

#: A digest is hot if more than one in so many rows has it; the others' rows are less than that share of any task's.
HOT_SHARE = 10_000
#: Rows that a digest may have in any case without being hot.
HOT_LEAST = 1_000
#: Misses of at most so many digests (32 bytes each) are sent to where the texts are; beyond, distinct texts are shuffled.
BROADCAST_MISSES = 100_000
#: Runs whose counts a worker remembers before it starts anew.
MEMO = 400_000

CACHE = "digest binary, n_tokens long"

_COUNTERS: dict[str, Counter] = {}
kept_by("token_counts", _COUNTERS.clear)

#: Runs that no piece of the byte-level pattern crosses; Python's white space holds all of the library's, and U+001C to U+001F.
_RUNS = re.compile(r"\s\S+|\S+|\s+(?=\s\S)|\s+").findall
_ODD = re.compile("[\x1c-\x1f]").search


def tokenizer_version(path: str) -> str:
    """SHA-256 of all that decides the counts: the file, the library and its version."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    digest = hashlib.sha256(f"{library} {version(library)}\n".encode())
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


class Counter:
    """Counts of one tokenizer file in one worker."""

    def __init__(self, path: str) -> None:
        self.memo: dict[str, int] = {}
        self.by_runs, self.added = False, None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()
        self.whole = lambda texts: [len(made) for made in model.encode_batch_fast(texts, add_special_tokens=False)]
        split = told["pre_tokenizer"] or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
        self.by_runs = plain and told["normalizer"] is None
        if names := [t["content"] for t in told["added_tokens"]]:
            self.added = re.compile("|".join(map(re.escape, names))).search

    def count(self, texts: list[str]) -> list[int]:
        if not self.by_runs:
            return self.whole(texts)
        runs = [None if _ODD(t) or self.added and self.added(t) else _RUNS(t) for t in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        if new := list(set().union(*(r for r in runs if r)).difference(self.memo)):
            self.memo.update(zip(new, self.whole(new), strict=True))
        known = self.memo.__getitem__
        return [sum(map(known, r)) if r is not None else self.whole([t])[0] for r, t in zip(runs, texts, strict=True)]


def _counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def counted(texts: DataFrame, path: str) -> DataFrame:
    """(digest, n_tokens) of rows (digest, content), each encoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counter.count(b.column(1).to_pylist()), pa.int64())], names=["digest", "n_tokens"])

    return texts.select("digest", "content").mapInArrow(tasks("token_counts", run), CACHE)


def stored(spark: SparkSession, cache: str, name: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer version in a cache; a version the cache does not know gets an empty table."""
    where = f"{cache}/version={name}"
    spark.createDataFrame([], CACHE).write.mode("append").parquet(where)
    return spark.read.schema(CACHE).parquet(where).dropDuplicates(["digest"])


def count_tokens(docs: DataFrame, path: str, cache: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens) for each row.

    ``cache`` is a folder that all machines share; it is made if it is not there. Without one, a run has a cache of its own in
    the work folder, so that each distinct text is encoded once.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    name = tokenizer_version(path)
    cache = cache or f"{work_dir(spark)}/token-counts-{os.urandom(8).hex()}"
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    texts = docs.select(F.col(key), content.alias("content"), F.unhex(F.sha2(content.cast("binary"), 256)).alias("digest"))
    rows = written(texts.select(key, "digest", F.octet_length("content").cast("long").alias("n_bytes")), "token-rows")
    census = written(rows.groupBy("digest").agg(F.count("*").alias("copies")), "token-census")
    total = census.agg(F.sum("copies")).first()[0] or 0

    missing = written(census.select("digest").join(stored(spark, cache, name), "digest", "left_anti"), "token-misses")
    if n := missing.count():
        if n <= BROADCAST_MISSES:
            todo = texts.select("digest", "content").join(F.broadcast(missing), "digest", "left_semi").dropDuplicates(["digest"])
        else:
            todo = texts.select("digest", "content").dropDuplicates(["digest"]).join(missing, "digest", "left_semi")
        counted(todo, path).write.mode("append").option("compression", "zstd").parquet(f"{cache}/version={name}")

    counts = stored(spark, cache, name)
    hot = census.filter(F.col("copies") > max(HOT_LEAST, total // HOT_SHARE)).select("digest")  # fewer than HOT_SHARE
    hot = written(counts.join(F.broadcast(hot), "digest", "left_semi"), "token-hot").withColumnRenamed("n_tokens", "hot_tokens")
    split = rows.select(F.struct(key).alias("row"), "digest", "n_bytes").join(F.broadcast(hot), "digest", "left")
    done = split.filter("hot_tokens IS NOT NULL").select("row", "n_bytes", F.col("hot_tokens").alias("n_tokens"))
    rest = split.filter("hot_tokens IS NULL").join(counts, "digest").select("row", "n_bytes", "n_tokens")
    return done.unionAll(rest).select("row.*", "n_bytes", "n_tokens")
