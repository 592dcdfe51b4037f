"""Byte-level BPE by a two-tier lookup.

Tier 1: a minimal perfect hash over the vocabulary resolves a pre-token that is itself in the
vocabulary. Tier 2: every other pre-token is merged by a heap over a linked list of bytes, lowest
rank first and leftmost among equals, as the public library does. A bounded memo remembers
results of either tier; it only saves repeating them.

Defined cases: null and empty texts encode to no ids (digests of the empty string); texts of any
length are encoded whole; repeated rows and null ids each keep a row; an empty table gives an empty
result; input columns other than the key and the text are not passed on, so no names can clash.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Entries a memo holds before it starts anew.
MEMO = 700_000

_CODECS: dict[tuple[str, str], Codec] = {}


class PerfectHash:
    """Minimal perfect hash of a fixed set of byte strings: cascaded bit arrays with ranks.

    A key takes the first level whose slot it has alone; its index is the number of taken slots
    before that one. Strings outside the set get some index or none, so callers compare keys.
    """

    def __init__(self, keys: list[bytes], gamma: float = 2.0) -> None:
        from xxhash import xxh3_64_intdigest

        self._hash = xxh3_64_intdigest
        self.levels: list[tuple[int, bytes, list[int]]] = []
        base, rest = 0, keys
        while rest:
            if len(self.levels) > 64:
                raise ValueError("keys are not distinct")
            size = max(64, int(gamma * len(rest)))
            seed = len(self.levels)
            slots = np.array([self._hash(k, seed) % size for k in rest])
            taken = np.bincount(slots, minlength=size) == 1
            ranks = base + np.cumsum(taken) - taken
            self.levels.append((size, taken.astype(np.uint8).tobytes(), ranks.tolist()))
            base += int(taken.sum())
            rest = [k for k, s in zip(rest, slots, strict=True) if not taken[s]]
        self.size = base

    def index(self, key: bytes) -> int:
        for seed, (size, taken, ranks) in enumerate(self.levels):
            slot = self._hash(key, seed) % size
            if taken[slot]:
                return ranks[slot]
        return -1


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        top = max(self.ranks.values()) + 1
        self.vocabulary = [b""] * top
        for k, i in self.ranks.items():
            self.vocabulary[i] = k
        self.decimal = [str(i) for i in range(top)]
        keys = list(self.ranks)
        self.perfect = PerfectHash(keys)
        self.keys: list[bytes] = [b""] * self.perfect.size
        self.ids = [0] * self.perfect.size
        for k in keys:
            at = self.perfect.index(k)
            self.keys[at], self.ids[at] = k, self.ranks[k]
        self.byte = [self.ranks[bytes([i])] for i in range(256)]
        #: (left id << 32 | right id) -> id of the two joined, for every way to cut a vocabulary entry in two.
        self.pair = {
            self.ranks[k[:i]] << 32 | self.ranks[k[i:]]: r
            for k, r in self.ranks.items() for i in range(1, len(k)) if k[:i] in self.ranks and k[i:] in self.ranks
        }
        self.split, self.split_latin = splitters(pattern)
        self.memo: dict[str, tuple[int, ...]] = {}  # of pre-tokens
        self.runs: dict[str, tuple[int, ...]] = {}  # of what stands between two blanks

    def whole(self, piece: bytes) -> int:
        """The id of a piece in the vocabulary, or -1."""
        at = self.perfect.index(piece)
        return self.ids[at] if at >= 0 and self.keys[at] == piece else -1

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of a piece by merging the pair of lowest rank, leftmost first, until none is left.

        The parts are a linked list over the bytes; the heap holds rank << 32 | place. An entry whose
        pair has changed since is passed over.
        """
        n = len(piece)
        part = [self.byte[x] for x in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = self.pair.get
        heap = []
        for i in range(n - 1):
            if (r := pair(part[i] << 32 | part[i + 1])) is not None:
                heap.append(r << 32 | i)
        heapq.heapify(heap)
        push, pop = heapq.heappush, heapq.heappop
        while heap:
            top = pop(heap)
            i, r = top & 0xFFFFFFFF, top >> 32
            j = after[i]
            if part[i] < 0 or j >= n or pair(part[i] << 32 | part[j]) != r:
                continue
            part[i], part[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (x := pair(r << 32 | part[k])) is not None:
                    push(heap, x << 32 | i)
            if (h := before[i]) >= 0 and (x := pair(part[h] << 32 | r)) is not None:
                push(heap, x << 32 | h)
        return tuple([x for x in part if x >= 0])

    def piece(self, p: str) -> tuple[int, ...]:
        ids = self.memo.get(p)
        if ids is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            raw = p.encode()
            one = self.whole(raw)
            ids = self.memo[p] = (one,) if one >= 0 else self.merge(raw)
        return ids

    def learn(self, runs) -> None:
        for run in runs:
            pieces = self.split_latin(run) if LATIN(run) else self.split(run)
            self.runs[run] = self.piece(run) if len(pieces) == 1 else tuple(chain.from_iterable(map(self.piece, pieces)))

    def encode(self, text: str) -> list[int]:
        """A blank joins what follows it, so runs between single blanks are independent of each other."""
        if not text:
            return []
        if UNEVEN(text):
            return list(chain.from_iterable(map(self.piece, self.split(text))))
        runs = (" " + text.replace(" ", "\0 ")).split("\0") if "\0" not in text else None
        if runs is None:
            return list(chain.from_iterable(map(self.piece, self.split(text))))
        runs[0] = runs[0][1:]
        if unknown := set(runs).difference(self.runs):
            if len(self.runs) > MEMO:
                self.runs.clear()
                unknown = set(runs)
            self.learn(unknown)
        return list(chain.from_iterable(map(self.runs.__getitem__, runs)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of ids, digest of the ids as decimals joined by commas, digest of what they decode to)."""
        ids = self.encode(text)
        joined = ",".join(map(self.decimal.__getitem__, ids))
        return len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()


#: A blank beside other white space, or white space at an end: such texts are split as a whole.
UNEVEN = re.compile(r" \s|\s |\A\s|\s\Z").search
#: Texts below U+0180, whose classes the faster splitter spells out.
LATIN = re.compile("[\0-\u017f]*").fullmatch


def splitters(pattern: str):
    """findall of the pattern for any text, and for texts below U+0180."""
    import regex

    # The library's white space is the Unicode property, without U+001C to U+001F.
    space = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

    def of(space: str, letter: str, number: str) -> str:
        parts = {"[^\\s\\p{L}\\p{N}]": f"[^{space}{letter}{number}]", "\\S": f"[^{space}]", "\\s": f"[{space}]", "\\p{L}": f"[{letter}]", "\\p{N}": f"[{number}]"}
        return re.sub("|".join(map(re.escape, parts)), lambda m: parts[m[0]], pattern)

    latin = of("\\t-\\r \\x85\\xa0", "a-zA-Z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u017f", "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe")
    return regex.compile(of(space, "\\p{L}", "\\p{N}")).findall, re.compile(latin).findall


def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process. Its memos hold no cycles, so the collector need not scan them."""
    gc.freeze()
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def encode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            ids = [c.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, bytes binary) for each row of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            out = [c.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=[key, "bytes"])

    return df.select(key, ids).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, bytes binary")


def digests(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) for each row: encoded whole, then decoded from the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            n, x, y = [], [], []
            for t in b.column(1):
                row = c.digest(t.as_py() or "")
                n.append(row[0]), x.append(row[1]), y.append(row[2])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(x, pa.string()), pa.array(y, pa.string())],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
