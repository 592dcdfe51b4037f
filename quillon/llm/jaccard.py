"""Exact similarity self-join on word shingles by set-relation skipping.

1. Every text becomes a set of 64-bit shingle hashes. Equal sets are one node, named by their digest.
2. Shingle frequencies are counted over all texts. The order of shingles, rarest first, puts shared passages
   last; frequencies below ``FREQUENT`` count as equal and are ordered by hash.
3. Answers of similar sets come first: nodes that share a pair of least hashes are compared with a
   leader among them (several in large groups), exactly. Links found make first components, and each node that
   links with a leader keeps the one it shares most with, and how many of its own shingles that one lacks.
4. The index: each node enters the lists of its prefix, long enough that two sets which link share a prefix
   shingle. A list is cut into blocks of one set size and one position; two blocks whose sizes differ too much, or whose
   positions leave too few shingles, are skipped whole, before any pair is made. Pairs whose answer follows from step 3, as
   both lie in one component, are skipped too. Long lists first learn their nodes'
   components and then give only pairs across them: first a few for each set, and, once these have been
   compared and components joined, all that are left. Very long ones are salted: a task holds two parts of a list.
5. Answers of the pairs that are left are derived: leaders are compared first, exactly; two sets share at most
   what their leaders share and what either has beyond its leader, and where that is too little they are not
   compared. All others are compared exactly, and the links of 3 and 5 give the components.

So every link between different texts is either found or lies inside a component that is already
joined; nothing is capped or sampled.

Defined cases: a null, empty or blank text has an empty set and links with nothing, not even its like;
a text with fewer words than the width is one shingle; repeated rows link with each other if they have a word; rows without
id join components but never name them unless all members lack one; an empty table gives an
empty result; columns other than the key and the text are not passed on, so no names can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, release, tasks, written
from .components import components
from .shingles import mix, shingle_sets

WIDTH = 5
#: Two sets link if DEN * intersection >= NUM * union.
NUM, DEN = 80, 100
#: Shingles in so many texts or more are ordered by their frequency.
FREQUENT = 8
#: The most frequent shingles that are broadcast (8 bytes each for hash, 4 for order). Others keep the order by hash, which is as correct.
FREQUENT_MOST = 1_000_000
#: Lists of more nodes learn components before they give pairs.
LONG_LIST = 24
#: Pairs of least hashes for each set.
BANDS = 6
#: Sets of a band that lead it: one, or so many if it has more than MANY. With several leaders next to no set of a
#: large group of near copies is left alone, as each pair of a lone set and the group must be compared later.
LEADERS, MANY = 4, 16
#: Shingles that a task gathers before it writes them out.
FLUSH = 2_000_000
#: Rounds in which each set outside a long list's largest component meets so many others first.
ROUNDS, TRIES = 2, 24
#: Nodes whose sets are asked for by broadcast, 8 bytes each; more are joined by shuffle.
ASKED_MOST = 2_000_000
#: Members that are compared with one copy of their hub.
BLOCK = 256
#: Entries of a block of a list, at most, and of a salted part of a list, about.
RUN, PART = 1_000, 2_048
#: Components whose least ids are broadcast, 16 bytes each.
CLASSES_MOST = 500_000

_SEEDS = mix(np.arange(1, 2 * BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _sets(b: pa.RecordBatch, column: int) -> Iterator[np.ndarray]:
    return shingle_sets([(t.as_py() or "").encode() for t in b.column(column)], WIDTH)


def _digest(s: np.ndarray) -> int:
    from xxhash import xxh3_64_intdigest

    n = xxh3_64_intdigest(s.tobytes())
    return n - (1 << 64) if n >> 63 else n


def prefix_length(n: np.ndarray | int):
    """Sets of n shingles that link share one of so many first shingles of either, in any common order."""
    return n - (NUM * n + DEN - 1) // DEN + 1


def nodes_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, node, n, bands) for each row; node and bands are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, n, bands = [], [], []
            for s in _sets(b, 1):
                n.append(len(s))
                if not len(s):
                    node.append(None), bands.append(None)
                    continue
                node.append(_digest(s))
                least = np.array([(s * seed).min() for seed in _SEEDS])  # hashes are mixed already
                bands.append(mix(least[::2] * np.uint64(31) + least[1::2] + np.arange(BANDS, dtype=np.uint64)).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=[key, "node", "n", "bands"]
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(tasks("jaccard", run), f"`{key}` {kind}, node long, n long, bands array<long>")


def _bits(docs: DataFrame, entries: int = 0) -> int:
    """Buckets are the hash's first bits: several for each shuffle partition, and one for each million entries."""
    return max(8, (4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))).bit_length(), (entries >> 20).bit_length())


def _packed(columns: list[np.ndarray]) -> bytes:
    """Columns as byte planes, compressed."""
    return zstandard.compress(b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns), 1)


def _unpacked(data: bytes, kinds: list[str]) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    widths = [np.dtype(k).itemsize for k in kinds]
    n, out, at = len(raw) // sum(widths), [], 0
    for kind, w in zip(kinds, widths, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * w].reshape(w, n).T).reshape(-1).view(kind))
        at += n * w
    return out


BLOBS = "bucket long, blob binary"


def _blobs(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "blob"])


def frequent_shingles(docs: DataFrame, text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash prefixes, sorted; how many texts) of the shingles of FREQUENT texts or more, counted over all rows."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            short, n = np.unique(np.concatenate(held) >> np.uint64(32 - bits), return_counts=True)
            cut = np.searchsorted(short, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(32))
            low = (short & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            rows = []
            for k in range(1 << bits):
                lo, hi = cut[k], cut[k + 1]
                if hi > lo:
                    rows.append((k, _packed([np.diff(low[lo:hi], prepend=np.uint32(0)), np.minimum(n[lo:hi], 255).astype(np.uint8)])))
            return _blobs(rows)

        for b in batches:
            for s in _sets(b, 0):
                held.append(s)
                size += len(s)
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def count(key, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpacked(x, ["u4", "u1"]) for x in pdf["blob"]]
        low, n = np.concatenate([np.cumsum(p[0], dtype=np.uint32) for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(low, kind="stable")
        low = low[order]
        new = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        total = np.add.reduceat(n[order].astype(np.int64), new)
        hot = total >= FREQUENT
        return pd.DataFrame({"short": (np.int64(key[0]) << 32) + low[new][hot].astype(np.int64), "df": total[hot]})

    hot = docs.select(text).mapInArrow(tasks("jaccard", gather), BLOBS).groupBy("bucket").applyInPandas(count, "short long, df long")
    hot = written(hot, "jaccard-frequent")
    release(docs.sparkSession)
    rows = hot.orderBy(F.desc("df"), "short").limit(FREQUENT_MOST).toArrow()
    short, df = rows.column(0).to_numpy(), rows.column(1).to_numpy()
    order = np.argsort(short)
    drop_table(hot)
    return short[order], df[order]


def prefix_lists(docs: DataFrame, text: str, frequent: tuple[np.ndarray, np.ndarray], bits: int) -> DataFrame:
    """(bucket, blob) of the prefix entries (shingle, node, set size, position) of all sets."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)  # at most FREQUENT_MOST entries

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short, df = sent.value
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            token, node, n, place = (np.concatenate([h[k] for h in held]) for k in range(4))
            order = np.lexsort((node, token))
            token, node, n, place = token[order], node[order], n[order], place[order]
            keep = np.r_[True, (token[1:] != token[:-1]) | (node[1:] != node[:-1])]  # copies in one task
            token, node, n, place = token[keep], node[keep], n[keep], place[keep]
            cut = np.searchsorted(token, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist() + [len(token)]
            return _blobs([(k, _packed([token[a:b], node[a:b], n[a:b], place[a:b]])) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a])

        for b in batches:
            for s in _sets(b, 0):
                if not len(s):
                    continue
                n, p = len(s), int(prefix_length(len(s)))
                rank = np.zeros(n, np.int64)
                if len(short):
                    own = (s >> np.uint64(32 - bits)).astype(np.int64)
                    at = np.minimum(np.searchsorted(short, own), len(short) - 1)
                    rank = np.where(short[at] == own, df[at], 0)
                first = np.argsort(rank, kind="stable")[:p] if rank.any() else np.arange(p)
                held.append((s[first], np.full(p, _digest(s), np.int64), np.full(p, n, np.uint32), np.arange(p, dtype=np.uint32)))
                size += p
                if size >= FLUSH // 4:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return docs.select(text).mapInArrow(tasks("jaccard", gather), BLOBS)


def _may_link(n, place, i, j) -> np.ndarray:
    """Whether the positions of a common shingle leave enough shingles for two sets to link."""
    least = (NUM * (n[i].astype(np.int64) + n[j]) + DEN + NUM - 1) // (DEN + NUM)
    return np.minimum(n[i].astype(np.int64) - place[i], n[j].astype(np.int64) - place[j]) >= least


def _list_pairs(list_of, node, n, place, apart=None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of entries of one list that may link, from entries sorted by (list, n, place).

    Entries of one list, size and position are a block (RUN at most). A block meets the blocks before it
    back to the first whose sets are not too small; of these, blocks whose positions leave too few
    shingles are skipped whole, and so are two blocks that lie in one part.
    """
    m = len(node)
    if not m:
        return np.zeros(0, int), np.zeros(0, int)
    new = np.r_[True, (list_of[1:] != list_of[:-1]) | (n[1:] != n[:-1]) | (place[1:] != place[:-1])]
    start = np.flatnonzero(new)
    within = np.arange(m) - np.repeat(start, np.diff(np.append(start, m)))
    start = np.flatnonzero(new | (within % RUN == 0))
    size = np.diff(np.append(start, m))
    of, sets, at = list_of[start], n[start].astype(np.int64), place[start]
    width = np.int64(1) << 33
    low = np.searchsorted(of * width + sets, of * width + (NUM * sets + DEN - 1) // DEN)  # never before its own list
    if apart is not None:
        lo, hi = np.minimum.reduceat(apart, start), np.maximum.reduceat(apart, start)
    out_a, out_b = [], []
    count = np.arange(len(start)) - low + 1
    for x, y in _cut(count, 1_000_000):
        c = count[x:y]
        j = np.repeat(np.arange(x, y), c)
        i = np.arange(len(j)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(low[x:y], c)
        ok = _may_link(sets, at, i, j)
        if apart is not None:
            ok &= (lo[i] != hi[i]) | (lo[j] != hi[j]) | (lo[i] != lo[j])
        i, j = i[ok], j[ok]
        pairs = size[i] * size[j]
        for u, v in _cut(pairs, 1_000_000):
            c = pairs[u:v]
            of_pair = np.repeat(np.arange(u, v), c)
            k = np.arange(len(of_pair)) - np.repeat(np.cumsum(c) - c, c)
            a, b = start[i[of_pair]] + k // size[j[of_pair]], start[j[of_pair]] + k % size[j[of_pair]]
            ok = (a < b) & (node[a] != node[b])
            if apart is not None:
                ok &= apart[a] != apart[b]
            out_a.append(a[ok]), out_b.append(b[ok])
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (np.zeros(0, int), np.zeros(0, int))


def _cut(count: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of entries whose counts add up to about so many."""
    total, lo = np.cumsum(count), 0
    while lo < len(count):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


INDEXED = "list long, a long, b long, n long, m long, place long"


def _index(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: pairs from short lists (a, b, sizes n and m), and the entries of long lists (list, a, n, place)."""
    parts = [_unpacked(x, ["u8", "i8", "u4", "u4"]) for x in pdf["blob"]]
    token, node, n, place = (np.concatenate([p[k] for p in parts]) for k in range(4))
    order = np.lexsort((node, place, n, token))
    token, node, n, place = token[order], node[order], n[order], place[order]
    keep = np.r_[True, (token[1:] != token[:-1]) | (node[1:] != node[:-1])]
    token, node, n, place = token[keep], node[keep], n[keep], place[keep]
    new = np.r_[True, token[1:] != token[:-1]]
    which = np.cumsum(new) - 1
    size = np.bincount(which)[which]
    short, long = (size > 1) & (size <= LONG_LIST), size > LONG_LIST
    i, j = _list_pairs(which[short], node[short], n[short], place[short])
    a, b, n_a, n_b = _distinct(node[short], n[short], i, j)
    k, m = len(a), int(long.sum())
    return pd.DataFrame({
        "list": pd.array([pd.NA] * k + token[long].view(np.int64).tolist(), "Int64"),
        "a": np.concatenate([a, node[long]]),
        "b": pd.array(b.tolist() + [pd.NA] * m, "Int64"),
        "n": np.concatenate([n_a, n[long].astype(np.int64)]),
        "m": np.concatenate([n_b, np.zeros(m, np.int64)]),
        "place": np.concatenate([np.zeros(k, np.int64), place[long].astype(np.int64)]),
    })


def _distinct(node, n, i, j) -> tuple[np.ndarray, ...]:
    """(lesser node, greater node, their sizes) of the pairs of entries, each once."""
    swap = node[i] > node[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    order = np.lexsort((node[j], node[i]))
    i, j = i[order], j[order]
    keep = np.r_[True, (node[i[1:]] != node[i[:-1]]) | (node[j[1:]] != node[j[:-1]])] if len(i) else np.zeros(0, bool)
    i, j = i[keep], j[keep]
    return node[i], node[j], n[i].astype(np.int64), n[j].astype(np.int64)


PAIRS = "a long, b long, n long, m long"


def _across(tries: int | None, seed: int):
    """Pairs of a long list's entries (or those of two of its parts) that lie in different components: all, or so many for
    each entry outside the part's largest component, drawn by hash among the sets of fitting size.
    """

    def pairs_of(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "place", "a"])
        node, n, place, comp, part = (pdf[c].to_numpy() for c in ("a", "n", "place", "component", "part"))
        if tries is None:
            i, j = _list_pairs(np.zeros(len(node), np.int64), node, n, place, comp)
            if key[1] != key[2]:  # pairs within a part are found where it is alone
                ok = part[i] != part[j]
                i, j = i[ok], j[ok]
        else:
            names, size = np.unique(comp, return_counts=True)
            alone = np.flatnonzero(comp != names[size.argmax()])
            lo = np.searchsorted(n, (NUM * n[alone] + DEN - 1) // DEN)
            hi = np.searchsorted(n, DEN * n[alone] // NUM, "right")
            draw = mix(node[alone].view(np.uint64)[:, None] + np.arange(1, tries + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15 * (2 * seed + 1) % (1 << 64)))
            other = lo[:, None] + (draw % (hi - lo).astype(np.uint64)[:, None]).astype(np.int64)
            i, j = np.repeat(alone, tries), other.reshape(-1)
            i, j = np.minimum(i, j), np.maximum(i, j)
            ok = (comp[i] != comp[j]) & _may_link(n, place, i, j)
            i, j = i[ok], j[ok]
        return pd.DataFrame(dict(zip(("a", "b", "n", "m"), _distinct(node, n, i, j), strict=True)))

    return pairs_of


def _salted(long: DataFrame, all_parts: bool) -> DataFrame:
    """Entries with the two parts of their list that a task holds; short lists have one part. Without ``all_parts`` each part is alone."""
    parts = long.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).filter("parts > 1")
    dealt = long.join(parts, "list", "left").withColumn("part", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int"))
    others = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1) if all_parts else F.array("part")
    dealt = dealt.withColumn("other", F.explode(others))
    return dealt.select("list", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"), "part", "a", "n", "place", "component")


COMPARED = "a long, b long, n long, m long, common long, links boolean"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members against their hub, exactly, from rows sorted by (hub, block, whether a member): only the hub is held."""
    now, hub = None, np.zeros(0, np.uint64)
    names = [c.split(" ")[0] for c in COMPARED.split(", ")]
    for batch in batches:
        rows = []
        for a, block, member, node, data in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4), strict=True):
            s = np.frombuffer(data.as_buffer(), np.uint64)
            if not member:
                now, hub = (a, block), s.copy()
                continue
            if now != (a, block):
                raise ValueError("a block has no hub")
            at = np.minimum(np.searchsorted(hub, s), len(hub) - 1)
            common = int((hub[at] == s).sum())
            rows.append((a, node, len(hub), len(s), common, DEN * common >= NUM * (len(hub) + len(s) - common)))
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if k == 5 else pa.int64()) for k, c in enumerate(columns)], names=names)


def sets_of(docs: DataFrame, text: str, pairs: DataFrame) -> DataFrame:
    """(node, shingles) of the nodes in pairs (a, b), written."""
    spark = docs.sparkSession
    asked = written(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "jaccard-asked")
    few = asked.count() <= ASKED_MOST
    sent = spark.sparkContext.broadcast(np.sort(asked.toArrow().column(0).to_numpy())) if few else None

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want = None if sent is None else sent.value
        done: set[int] = set()
        for b in batches:
            nodes, blobs = [], []
            for s in _sets(b, 0):
                if not len(s):
                    continue
                node = _digest(s)
                if want is not None:
                    at = int(np.searchsorted(want, node))
                    if at == len(want) or want[at] != node or node in done:
                        continue
                    done.add(node)
                nodes.append(node), blobs.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(blobs, pa.binary())], names=["node", "shingles"])

    sets = docs.select(text).mapInArrow(tasks("jaccard", fetch), "node long, shingles binary")
    if not few:
        sets = sets.join(asked, "node", "left_semi")
    sets = written(sets.groupBy("node").agg(F.first("shingles").alias("shingles")), "jaccard-sets")
    drop_table(asked)
    release(spark)
    return sets


def compared(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, their sizes, how many shingles they share, whether they link) of pairs (a, b), by their whole sets. Large hubs are split into blocks."""
    hubs = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = pairs.join(hubs, "a").select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"), F.lit(True).alias("member"), F.col("b").alias("node"))
    selves = hubs.select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("member"), F.col("a").alias("node"))
    rows = members.unionByName(selves).join(sets, "node").select("a", "block", "member", "node", "shingles")
    rows = rows.repartition("a", "block").sortWithinPartitions("a", "block", "member")
    out = written(rows.mapInArrow(tasks("jaccard", _compare), COMPARED), "jaccard-compared")
    release(sets.sparkSession)
    return out


def leaders_of(stars: DataFrame) -> DataFrame:
    """(node, leader, beyond) from compared stars: the linked leader that a node shares most with, and how many of its own shingles that one lacks."""
    best = stars.filter("links").groupBy(F.col("b").alias("node")).agg(F.max(F.struct("common", "a", "m")).alias("x"))
    return best.select("node", F.col("x.a").alias("leader"), (F.col("x.m") - F.col("x.common")).alias("beyond"))


def answers(sets: DataFrame, pairs: DataFrame, leaders: DataFrame) -> DataFrame:
    """Links (a, b) of pairs (a, b, n, m: sizes) and of their leaders.

    |a and b| is at most |their leaders' common shingles| and what a and b have beyond their leaders, so pairs for which that
    is too little are never compared.
    """
    led = pairs
    for side in ("a", "b"):
        own = leaders.select(F.col("node").alias(side), F.col("leader").alias(f"l{side}"), F.col("beyond").alias(f"x{side}"))
        led = led.join(own, side, "left").withColumns({f"l{side}": F.coalesce(f"l{side}", side), f"x{side}": F.coalesce(f"x{side}", F.lit(0))})
    led = led.select("a", "b", "n", "m", F.least("la", "lb").alias("u"), F.greatest("la", "lb").alias("v"), (F.col("xa") + F.col("xb")).alias("beyond"))
    led = written(led, "jaccard-led")
    first = compared(sets, led.filter("u <> v").select(F.col("u").alias("a"), F.col("v").alias("b")).distinct())
    known = first.select(F.col("a").alias("u"), F.col("b").alias("v"), "common")
    rest = led.join(known, ["u", "v"], "left").filter("a <> u OR b <> v").filter(
        F.col("common").isNull() | ((DEN + NUM) * (F.col("common") + F.col("beyond")) >= NUM * (F.col("n") + F.col("m")))
    )
    second = compared(sets, rest.select("a", "b").distinct())
    drop_table(led)
    return first.unionByName(second).filter("links").select("a", "b")


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) for each row; component_id is the least key reachable by links."""
    nodes = written(nodes_of(docs, key, text), "jaccard-nodes")
    bits = _bits(docs, nodes.agg(F.sum("n")).first()[0] or 0)
    banded = nodes.filter("node IS NOT NULL").select("node", F.explode("bands").alias("band")).distinct()
    drawn = [F.min_by("node", F.xxhash64(F.col("node"), F.lit(k))) for k in range(LEADERS)]
    heads = banded.groupBy("band").agg(F.array(*drawn).alias("leaders"), F.count("*").alias("m")).filter("m > 1")
    heads = heads.select("band", F.explode(F.array_distinct(F.when(F.col("m") > MANY, F.col("leaders")).otherwise(F.slice("leaders", 1, 1)))).alias("a"))
    stars = written(banded.join(heads, "band").filter("node <> a").select("a", F.col("node").alias("b")).distinct(), "jaccard-stars")
    sets = sets_of(docs, text, stars)
    stars = compared(sets, stars)
    drop_table(sets)
    leaders = written(leaders_of(stars), "jaccard-leaders")
    found = stars.filter("links").select("a", "b")

    frequent = frequent_shingles(docs, text, bits)
    lists = prefix_lists(docs, text, frequent, bits).groupBy("bucket").applyInPandas(_index, INDEXED)
    lists = written(lists, "jaccard-lists")
    release(docs.sparkSession)
    sets = None
    for seed in range(ROUNDS + 1):
        # Components grow, so lists of one component give nothing any more; the last round leaves no pair out.
        parts = components(found)
        part = parts.select(F.col("id").alias("a"), "component")
        long = lists.filter("list IS NOT NULL").join(part, "a", "left").withColumn("component", F.coalesce("component", "a"))
        mixed = long.groupBy("list").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("list")
        mixed = written(long.join(mixed, "list", "left_semi"), "jaccard-mixed")
        pairs = _salted(mixed, seed == ROUNDS).groupBy("list", "one", "two").applyInPandas(_across(TRIES if seed < ROUNDS else None, seed), PAIRS)
        if seed == 0:
            other = part.select(F.col("a").alias("b"), F.col("component").alias("other"))
            short = lists.filter("list IS NULL").select("a", "b", "n", "m").distinct().join(part, "a", "left").join(other, "b", "left")
            pairs = pairs.unionByName(short.filter(F.coalesce("component", "a") != F.coalesce("other", "b")).select("a", "b", "n", "m"))
        pairs = written(pairs.distinct(), "jaccard-pairs")
        if sets is None:
            # Whatever long lists may ask for later, too: each entry of a mixed list; and all their leaders.
            asked = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).unionByName(mixed.select("a")).distinct()
            asked = asked.join(leaders, F.col("a") == F.col("node"), "left").select("a", F.coalesce("leader", "a").alias("b"))
            sets = sets_of(docs, text, asked)
        if not pairs.isEmpty():
            found = written(found.unionByName(answers(sets, pairs, leaders)).distinct(), "jaccard-found")
        drop_table(mixed)
        drop_table(pairs)
    drop_table(sets)
    drop_table(lists)
    whole = components(found)

    named = nodes.join(whole.withColumnRenamed("id", "node"), "node", "left").select(key, "n", "node", "component")
    named = written(named, "jaccard-named")
    # Rows that share a class with no other row name themselves, so only classes of several are looked up.
    several = named.filter("node IS NOT NULL").groupBy(F.coalesce("component", "node").alias("class")).agg(F.min(key).alias("component_id"), F.count("*").alias("rows"))
    several = written(several.filter("rows > 1").drop("rows"), "jaccard-classes")
    least = F.broadcast(several) if several.count() <= CLASSES_MOST else several
    out = named.join(least, F.coalesce("component", "node") == F.col("class"), "left")
    return out.select(key, F.col("n").alias("n_shingles"), F.when(F.col("class").isNull(), F.col(key)).otherwise(F.col("component_id")).alias("component_id"))
