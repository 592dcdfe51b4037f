"""Product quantisation of vectors by delta-maintained Lloyd rounds.

Components become integers, a vector is cut into ``PARTS`` equal consecutive parts, and each part position has a codebook
of at most ``ENTRIES`` entries, at first that part of the vectors of smallest ids. A round assigns every part to its nearest
entry (squared Euclidean distance, the lower index among equals) and replaces each entry by the floored mean of its parts. Two
tables outlive a round: every row's present codes beside its integers, and for each entry the running integer sums of its
parts with their number. The next round reads the codes back; only parts whose code changed give minus to the entry
they left and plus to the one they joined, summed in each task before anything is shuffled, so a round moves at most
``ENTRIES`` rows a component and task, and next to nothing once the codes have settled. Unused entries stay.

Codebooks are ``ENTRIES`` x length integers, whatever the number of vectors; only they pass through the driver.

Defined cases: rows whose vector is null or holds null or non-finite components go; an empty vector is kept, with an error
of 0; vectors of different length have codebooks of their own, and a length that ``PARTS`` does not divide is filled up with
zeros at the end; with fewer than ``ENTRIES`` vectors there are fewer entries; ids may repeat or be null (null ids are
larger than all others, equal ids follow by their components); integers beyond ``LARGEST`` either way are cut to it, so
that distances stay whole, and sums of errors end at the largest long; an empty table gives an empty result; columns other than the key, the vector and the label are not
passed on, so no names can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, tasks, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integers are cut to this, so that squared distances of some thousand components fit in 64 bits.
LARGEST = 1 << 24
#: Labels whose sums (16 bytes each) are sent to all tasks; beyond, they are joined by shuffle, where adaptive execution splits a label of many rows.
BROADCAST_LABELS = 100_000

OFFSET = 1 << 31
SUMS = "length int, part int, entry int, place int, total long"


def _padded(length: int) -> int:
    return -(-length // PARTS) * PARTS


def integers(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, label, length, x): kept rows; x holds 32-bit integers, filled up to a multiple of PARTS, as big-endian numbers
    above -2**31, so that the bytes are ordered as the components are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, out, keep = [], [], []
            for v in b.column(2).to_pylist():
                x = None if v is None else np.array([np.nan if c is None else c for c in v], np.float64)
                keep.append(x is not None and bool(np.isfinite(x).all()))
                if not keep[-1]:
                    continue
                whole = np.zeros(_padded(len(x)), np.int64)
                whole[: len(x)] = np.clip(np.floor(SCALE * np.clip(x, -LARGEST, LARGEST)), -LARGEST, LARGEST)
                lengths.append(len(x)), out.append((whole + OFFSET).astype(">u4").tobytes())
            kept = b.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays(
                [kept.column(0), kept.column(1), pa.array(lengths, pa.int32()), pa.array(out, pa.binary())], names=["id", "label", "length", "x"]
            )

    kinds = [df.schema[c].dataType.simpleString() for c in (key, label)]
    rows = df.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInArrow(tasks("vector_codes", run), f"id {kinds[0]}, label {kinds[1]}, length int, x binary")


def _matrix(column: list[bytes]) -> np.ndarray:
    """Rows x parts x places."""
    length = len(column[0]) // 4 if column else 0
    return np.frombuffer(b"".join(column), ">u4").reshape(len(column), PARTS, length // PARTS).astype(np.int64) - OFFSET


def _groups(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, which, matrix) of a batch's rows of each length; columns are named."""
    lengths = b.column("length").to_numpy()
    data = b.column("x").to_pylist()
    for d in np.unique(lengths).tolist():
        which = np.flatnonzero(lengths == d)
        yield d, which, _matrix([data[i] for i in which])


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances), rows x parts, of x (rows x parts x places) in a book (parts x entries x places); exact."""
    codes, error = np.zeros(x.shape[:2], np.int64), np.zeros(x.shape[:2], np.int64)
    peak = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    # Below 2**53 products and sums of doubles are exact, and the fast product may be used.
    kind = np.float64 if x.shape[2] * (2 * peak) ** 2 < 1 << 53 else np.int64
    for p in range(x.shape[1]):
        own, entries = x[:, p].astype(kind), book[p].astype(kind)
        if kind is np.float64:
            far = (entries**2).sum(1) - 2 * (own @ entries.T)
            codes[:, p] = far.argmin(1)
            error[:, p] = far.min(1) + (own**2).sum(1)
        else:
            for k in range(0, len(own), 256):
                far = ((own[k : k + 256, None] - entries) ** 2).sum(2)
                codes[k : k + 256, p], error[k : k + 256, p] = far.argmin(1), far.min(1)
    return codes, error


def first_books(rows: DataFrame) -> dict[int, np.ndarray]:
    """For each length: parts x entries x places of the ENTRIES rows of smallest ids."""
    out = {}
    for (d,) in rows.select("length").distinct().orderBy("length").collect():  # a row a length
        small = rows.filter(F.col("length") == d).orderBy(F.asc_nulls_last("id"), "x").limit(ENTRIES).select("x").toArrow()
        out[d] = _matrix(small.column(0).to_pylist()).transpose(1, 0, 2)
    return out


def assigned(state: DataFrame, books: dict[int, np.ndarray]) -> DataFrame:
    """The state with fresh codes and errors; ``was`` holds the codes before (empty: none) and ``moved`` if they differ."""
    sent = state.sparkSession.sparkContext.broadcast(books)  # ENTRIES x length integers a length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            was = b.column("codes").to_pylist()
            codes: list[bytes] = [b""] * len(was)
            error = np.zeros(len(was), np.int64)
            for d, which, x in _groups(b):
                got, far = nearest(x, sent.value[d])
                error[which] = far.sum(1)
                for i, row in zip(which.tolist(), got.astype(np.uint8), strict=True):
                    codes[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("id", "label", "length", "x")), pa.array(was, pa.binary()), pa.array(codes, pa.binary()),
                 pa.array([a != b for a, b in zip(was, codes, strict=True)], pa.bool_()), pa.array(error)],
                names=["id", "label", "length", "x", "was", "codes", "moved", "error"],
            )

    own = ", ".join(f"{c} {state.schema[c].dataType.simpleString()}" for c in ("id", "label"))
    return state.select("id", "label", "length", "x", "codes").mapInArrow(
        tasks("vector_codes", run), f"{own}, length int, x binary, was binary, codes binary, moved boolean, error long"
    )


def changes(state: DataFrame) -> DataFrame:
    """Plus and minus of the parts whose code changed, as SUMS, summed over each task; place -1 holds numbers of parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}  # parts x entries x (1 + places)
        for b in batches:
            was, now = b.column("was").to_pylist(), b.column("codes").to_pylist()
            for d, which, x in _groups(b):
                sums = held.setdefault(d, np.zeros((1 + x.shape[2], PARTS * ENTRIES), np.int64))
                new = np.frombuffer(b"".join(now[i] for i in which), np.uint8).reshape(len(which), PARTS).astype(np.int64)
                old = np.full(new.shape, -1)
                for k, i in enumerate(which.tolist()):
                    if was[i]:
                        old[k] = np.frombuffer(was[i], np.uint8)
                for sign, codes in ((1, new), (-1, old)):
                    row, part = np.nonzero((new != old) & (codes >= 0))
                    at, own = part * ENTRIES + codes[row, part], x[row, part]
                    for place, weights in enumerate((None, *own.T)):  # a batch's sums are whole in doubles
                        sums[place] += sign * np.bincount(at, weights, PARTS * ENTRIES).astype(np.int64)
        for d, sums in held.items():
            place, at = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), d, np.int32)), *(pa.array(a.astype(np.int32)) for a in (at // ENTRIES, at % ENTRIES, place - 1)), pa.array(sums[place, at])],
                names=["length", "part", "entry", "place", "total"],
            )

    return state.filter("moved").select("length", "x", "was", "codes").mapInArrow(tasks("vector_codes", run), SUMS)


def updated(books: dict[int, np.ndarray], sums: DataFrame) -> dict[int, np.ndarray]:
    """Books whose used entries are the floored means of the running sums."""
    got = sums.toArrow()  # at most ENTRIES x (length + PARTS) rows a length
    length, part, entry, place, total = (got.column(k).to_numpy() for k in range(5))
    out = {}
    for d, book in books.items():
        own = length == d
        held = np.zeros((*book.shape[:2], 1 + book.shape[2]), np.int64)
        held[part[own], entry[own], place[own] + 1] = total[own]
        number = held[:, :, :1]
        out[d] = np.where(number > 0, held[:, :, 1:] // np.maximum(number, 1), book)
    return out


def digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.reshape(-1).tolist())).encode()).hexdigest()


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) for each kept row."""
    spark = df.sparkSession
    bounded_batches(spark)
    rows = written(integers(df, key, vector, label), "codes-rows")
    books = first_books(rows)
    state = rows.withColumn("codes", F.lit(b""))
    sums = spark.createDataFrame([], SUMS)
    for k in range(rounds):
        state = written(assigned(state, books), f"codes-state-{k}")
        sums = sums.unionAll(changes(state)).groupBy("length", "part", "entry", "place").agg(F.sum("total").alias("total"))
        sums = written(sums.select("length", "part", "entry", "place", "total"), f"codes-sums-{k}")
        books = updated(books, sums)
    final = written(assigned(state, books).select("id", "label", "length", "codes", "error"), "codes-final")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
    by_label = final.groupBy("label").agg(total.alias("label_error")).select(F.struct("label").alias("own"), "label_error")
    if by_label.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        by_label = F.broadcast(by_label)
    hashes = F.create_map(*[F.lit(v) for d, book in sorted(books.items()) for v in (d, digest(book))]) if books else F.lit(None).cast("map<int,string>")
    return final.join(by_label, F.struct("label") == F.col("own")).select(
        F.struct(F.col("id").alias(key)).alias("row"), F.lower(F.hex("codes")).alias("code"), "error", "label_error", hashes[F.col("length")].alias("codebooks_sha256")
    ).select("row.*", "code", "error", "label_error", "codebooks_sha256")
