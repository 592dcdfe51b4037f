"""Best-fit packing of tokenised documents by linear grouping.

A document's ids are cut into pieces of at most ``capacity``; only how many pieces there are of each
length matters for packing, so the driver plans on a histogram of at most ``capacity`` rows, whatever
the corpus: large lengths are rounded up to their group's largest, in groups of equal cardinality; a
linear program over configurations of these few lengths is solved by column generation and
rounded down; actual lengths then take the rounded ones' places, and what is left and all small pieces go,
longest first, where they leave the least room. The plan is a table of rank ranges, and each piece
finds its place by its rank among pieces of equal length.

Defined cases: a null or empty text is the end id alone; long texts are tokenised whole and cut into
full pieces and one rest; equal lengths are told apart by task and order in it; repeated rows
and null ids are packed each; an empty table gives no pieces; columns other than the key and the text are not
passed on, so no names can clash.
"""

from __future__ import annotations

import gc
import json
import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import kept_by, tasks, written

CAPACITY = 2048
#: Lengths up to this share of the capacity are small.
SMALL = 1 / 16
#: Groups of equal cardinality that large lengths are rounded in.
GROUPS = 64
#: The program ends at its optimum, or where a bound (Farley's) proves that less than this share of its sequences, or than one, could be saved.
GAP = 1e-5
#: Rows of a plan (40 bytes each) that are broadcast at a time.
PLAN_ROWS = 250_000
#: Runs of text that a tokenizer's memo holds before it starts anew.
MEMO = 400_000

# --- Tokens ---------------------------------------------------------------------------------------

_TOKENIZERS: dict[str, WordTokenizer] = {}
kept_by("packing", _TOKENIZERS.clear)

#: White space that str.split() knows beyond the ASCII blanks, or that its notion and the library's differ in.
_ODD = re.compile("[\x1c-\x1f\x85\xa0  -     　]").search
_RUN = re.compile("[^ \t-\r]+").findall
_LATIN = re.compile("[\0-ſ]*").fullmatch
_LETTER, _NUMBER, _SPACE = "a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ", "0-9\xb2\xb3\xb9\xbc-\xbe", " \t-\r\x85\xa0"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+").findall


#: How the tokenizer files that _PIECES stands for declare what they do before the merges.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}


def byte_characters() -> list[str]:
    """The printable stand-ins of bytes in byte-level vocabularies: themselves if visible, else from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in visible else next(spare)) for b in range(256)]


class WordTokenizer:
    """Ids of the library's word tokenizer (lower case, white space dropped), run by run between blanks.

    No token spans a blank, so each run is tokenised once and remembered. Runs below U+0180 are cut by
    the tokenizer file's own pattern and given to the library's model; all others go through its full pipeline.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        if (told["normalizer"], told["pre_tokenizer"]) != (NORMALIZER, SPLIT):
            raise ValueError(f"{path} splits texts in another way than words in lower case")
        self.full = Tokenizer.from_file(path)
        self.model = self.full.model
        self.shown = byte_characters()
        self.words: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}

    def word(self, piece: str) -> bytes:
        ids = self.words.get(piece)
        if ids is None:
            if len(self.words) >= MEMO:
                self.words.clear()
            shown = "".join([self.shown[b] for b in piece.encode()])
            ids = self.words[piece] = np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()
        return ids

    def learn(self, runs) -> None:
        odd = []
        for run in runs:
            if _LATIN(run) and "<|" not in run:
                self.runs[run] = b"".join(map(self.word, _PIECES(run.lower())))
            else:
                odd.append(run)
        for run, made in zip(odd, self.full.encode_batch_fast(odd, add_special_tokens=False) if odd else (), strict=True):
            self.runs[run] = np.array(made.ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        runs = _RUN(text) if _ODD(text) else text.split()
        if unknown := set(runs).difference(self.runs):
            if len(self.runs) > MEMO:
                self.runs.clear()
                unknown = set(runs)
            self.learn(unknown)
        return b"".join(map(self.runs.__getitem__, runs))


def tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
        gc.freeze()
    return _TOKENIZERS[path]


def pieces(
    df: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False
) -> DataFrame:
    """(key, piece, start, length, ids_crc32, part, nth[, ids]): nth counts a task's pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part = tokenizer(path), TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            keys, rows, ids = [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                all_ids = tok.encode(t.as_py() or "") + end
                for n, at in enumerate(range(0, len(all_ids), 4 * capacity)):
                    own = all_ids[at : at + 4 * capacity]
                    length = len(own) // 4
                    keys.append(k)
                    rows.append((n, at // 4, length, zlib.crc32(own), part, seen[length]))
                    seen[length] += 1
                    if with_ids:
                        ids.append(own)
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int32(), *[pa.int64()] * 5), strict=True)] if rows else [
                pa.array([], kind) for kind in (pa.int32(), *[pa.int64()] * 5)
            ]
            names = [key, "piece", "start", "length", "ids_crc32", "part", "nth"]
            out = [pa.array(keys, b.column(0).type), *columns]
            if with_ids:
                out, names = [*out, pa.array(ids, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, part long, nth long" + ", ids binary" * with_ids
    return df.select(key, text).mapInArrow(tasks("packing", run), schema)


# --- Plan -----------------------------------------------------------------------------------------


def configurations(sizes: list[int], counts: list[int], capacity: int) -> tuple[list[tuple[list[int], int]], float]:
    """([(how many of each size, how often)] from the fractional optimum rounded down, proven gap in sequences); sizes are few and distinct.

    Columns are generated for as long as one improves the program. With z its value and v the worth of the best column, no solution
    is below z / v, so the gap is z - z / v: 0 at the optimum.
    """
    m = len(sizes)
    need = np.array(counts, float)
    eased = need * (1 + 1e-9 * np.arange(1, m + 1))  # no two ratios are equal, so no step leaves the value as it was
    basis = np.diag([float(capacity // s) for s in sizes])
    inverse = np.diag(1 / np.diag(basis))
    step = 0
    while True:
        step += 1
        if step % 100 == 0:
            inverse = np.linalg.inv(basis)  # against rounding
        worth = inverse.sum(0)
        column = _best_column(sizes, worth, capacity)
        best, value = float(column @ worth), float(worth @ eased)
        gap = max(0.0, value - value / best) if best > 1 else 0.0
        if best <= 1 + 1e-9 or gap < max(1.0, GAP * value):
            break
        x, move = inverse @ eased, inverse @ column
        ratio = np.where(move > 1e-9, np.maximum(x, 0) / np.where(move > 1e-9, move, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = column
        pivot = inverse[out] / move[out]
        inverse = inverse - np.outer(move, pivot)
        inverse[out] = pivot
    x = np.linalg.solve(basis, need)
    return [([int(a) for a in basis[:, k]], int(v + 1e-6)) for k, v in enumerate(x) if v >= 1 - 1e-6], gap


def _best_column(sizes: list[int], worth: np.ndarray, capacity: int) -> np.ndarray:
    """Unbounded knapsack: how many of each size fit together at the greatest worth."""
    order = [k for k in np.argsort(sizes) if worth[k] > 1e-12]
    out = np.zeros(len(sizes), int)
    if not order:
        return out
    own, value = np.array([sizes[k] for k in order]), worth[order]
    best = np.zeros(capacity + 1)
    chosen = np.full(capacity + 1, -1)
    for room in range(int(own[0]), capacity + 1):
        fits = int(np.searchsorted(own, room, "right"))
        got = best[room - own[:fits]] + value[:fits]
        k = int(got.argmax())
        if got[k] > best[room - 1] + 1e-15:
            best[room], chosen[room] = got[k], k
        else:
            best[room], chosen[room] = best[room - 1], -1
    room = capacity
    while room > 0:
        if chosen[room] < 0:
            room -= 1
        else:
            out[order[chosen[room]]] += 1
            room -= int(own[chosen[room]])
    return out


class Plan:
    """Rows (length, from rank, to rank, first sequence, offset) that place every piece of a histogram.

    ``gap`` is how many sequences the linear program may lie above its optimum.
    """

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY, small: float = SMALL, groups: int = GROUPS) -> None:
        self.capacity = capacity
        self.left = {s: n for s, n in histogram.items() if n}
        self.rank: dict[int, int] = defaultdict(int)
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        self.gap = 0.0
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> [(first sequence, how many)]
        self.rooms: list[int] = []
        self._grouped(small * capacity, groups)
        self._best_fit()

    def _put(self, size: int, n: int, first: int, offset: int) -> None:
        self.rows.append((size, self.rank[size], self.rank[size] + n, first, offset))
        self.rank[size] += n
        self.left[size] -= n

    def _keep(self, room: int, first: int, n: int) -> None:
        if room and n:
            if not self.open[room]:
                insort(self.rooms, room)
            self.open[room].append((first, n))

    def _grouped(self, small: float, groups: int) -> None:
        large = sorted((s for s in self.left if small < s < self.capacity), reverse=True)
        total = sum(self.left[s] for s in large)
        if not total:
            return
        members: list[list[list[int]]] = [[] for _ in range(groups)]  # of each group: [size, how many], longest first
        at = 0
        for s in large:
            n = self.left[s]
            while n:
                g = at * groups // total
                took = min(n, -(-(g + 1) * total // groups) - at)
                members[g].append([s, took])
                at, n = at + took, n - took
        merged: dict[int, list[list[int]]] = {}  # groups of one rounded size are one
        for g in filter(None, members):
            merged.setdefault(g[0][0], []).extend(g)
        sizes = list(merged)
        found, self.gap = configurations(sizes, [sum(n for _, n in merged[s]) for s in sizes], self.capacity)
        for column, often in found:
            spans = [(self.sequences, often, 0)]  # (first sequence, how many, used)
            self.sequences += often
            slots = [s for s, n in zip(sizes, column, strict=True) for _ in range(n)]
            for s in slots[:-1]:
                spans = self._substitute(spans, merged[s])
            spans = self._fill(spans)  # the shortest slot, with what rounding up has left free
            for first, n, used in spans:
                self._keep(self.capacity - used, first, n)

    def _substitute(self, spans: list[tuple[int, int, int]], group: list[list[int]]) -> list[tuple[int, int, int]]:
        """One slot of each sequence gets the group's next actual piece."""
        out = []
        for first, n, used in spans:
            while n and group:
                size, have = group[0]
                took = min(n, have, self.left[size])
                if took:
                    self._put(size, took, first, used)
                    out.append((first, took, used + size))
                    first, n = first + took, n - took
                group[0][1] -= took
                if not group[0][1] or not self.left[size]:
                    group.pop(0)
            if n:
                out.append((first, n, used))
        return out

    def _fill(self, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Each sequence gets the longest piece left that fits."""
        out, sizes = [], sorted(s for s, n in self.left.items() if n)
        for first, n, used in spans:
            while n:
                k = bisect_left(sizes, self.capacity - used + 1) - 1
                if k < 0:
                    break
                took = min(n, self.left[sizes[k]])
                self._put(sizes[k], took, first, used)
                out.append((first, took, used + sizes[k]))
                first, n = first + took, n - took
                if not self.left[sizes[k]]:
                    sizes.pop(k)
            if n:
                out.append((first, n, used))
        return out

    def _best_fit(self) -> None:
        for size in sorted(self.left, reverse=True):
            while n := self.left[size]:
                k = bisect_left(self.rooms, size)
                if k == len(self.rooms):
                    each = self.capacity // size
                    first, have, room = self.sequences, -(-n // each), self.capacity
                    self.sequences += have
                else:
                    room = self.rooms[k]
                    first, have = self.open[room].pop()
                    if not self.open[room]:
                        self.rooms.pop(k)
                    each = room // size
                full = min(have, n // each)
                for j in range(each if full else 0):
                    self._put(size, full, first, self.capacity - room + j * size)
                self._keep(room - each * size, first, full)
                first, have = first + full, have - full
                if have and (rest := self.left[size]) and rest < each:
                    for j in range(rest):
                        self._put(size, 1, first, self.capacity - room + j * size)
                    self._keep(room - rest * size, first, 1)
                    first, have = first + 1, have - 1
                self._keep(room, first, have)


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``items`` (from pieces(), written) with sequence_id and offset.

    The plan's rows depend on lengths alone, fewer than capacity squared whatever the corpus. They are broadcast in blocks of
    PLAN_ROWS, each to the pieces whose length and rank lie in it.
    """
    spark = items.sparkSession
    by_part = written(items.groupBy("part", "length").count(), "pack-counts")
    plan = Plan({r[0]: r[1] for r in by_part.groupBy("length").agg(F.sum("count")).collect()}, capacity)
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = by_part.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    table = np.array(sorted(plan.rows), np.int64).reshape(-1, 5)
    kept = [c for c in items.columns if c not in ("part", "nth")]

    def placer(block: np.ndarray):
        sent = spark.sparkContext.broadcast(block)  # at most PLAN_ROWS rows

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = sent.value
            keys = t[:, 0] << 40 | t[:, 1]
            for b in batches:
                length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
                at = np.searchsorted(keys, length << 40 | rank, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(b.schema.get_field_index(c)) for c in kept), pa.array(t[at, 3] + rank - t[at, 1]), pa.array(t[at, 4])],
                    names=[*kept, "sequence_id", "offset"],
                )

        return tasks("packing", place)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema if f.name in kept) + ", sequence_id long, offset long"
    ranked = items.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth")).select(*kept, "rank")
    if len(table) <= PLAN_ROWS:
        return ranked.mapInArrow(placer(table), schema)
    ranked, blocks = written(ranked, "pack-ranked"), [table[k : k + PLAN_ROWS] for k in range(0, len(table), PLAN_ROWS)]
    place_of, own = F.struct("length", "rank"), []
    bound = lambda row: F.struct(F.lit(int(row[0])).cast("long").alias("length"), F.lit(int(row[1])).cast("long").alias("rank"))
    for k, block in enumerate(blocks):
        inside = place_of >= bound(block[0]) if k else F.lit(True)
        if k + 1 < len(blocks):
            inside &= place_of < bound(blocks[k + 1][0])
        own.append(ranked.filter(inside).mapInArrow(placer(block), schema))
    return reduce(DataFrame.unionAll, own)


def pack_documents(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack whole documents."""
    return pack(written(pieces(df, path, key, text, capacity, with_ids=with_ids), "pack-pieces"), capacity)
