"""Embedding near-dedup over a robust-pruned flat graph.

1. Equal vectors are one node with a weight. Nodes of each length are indexed by themselves. Pivots are drawn from a
   bounded sample (the nodes of smallest hash, at most ``SAMPLE`` a length), none within ``APART`` of another, and every
   node joins the shards of its ``OVERLAP`` nearest pivots. Shards of more than two pieces draw ``SUBPIVOTS`` of their
   own, and their nodes join the leaves of the ``SUBOVERLAP`` nearest of these; large leaves are split into pieces.
2. Each leaf's task builds a flat graph: candidates by similarity, robust pruning (a candidate goes if a chosen
   one is closer to it by the factor ``ALPHA``), a few long edges, edges both ways.
3. Adjacency lists are united over the leaves. Each node is searched for in all pieces of its nearest pivots'
   leaf, its home: a greedy beam from the piece's medoids, then expansion of the range around what it found.
   Every pair kept has its cosine computed in double precision.
4. Recall of every index is audited against brute force over all rows, in blocks: nodes of ids that ``AUDITED_IDS`` divides
   are drawn until ``ENOUGH`` of them have true links or none is left. Under ``RECALL`` the index is built again
   with more overlap and a wider beam; if the last one is under ``REQUIRED``, all pairs are compared in blocks. The recall of what
   is returned is a column of the result and part of ``Report``.

Links are counted where they are found and never written out: of the tasks where a pair can meet, one counts it, for
both its nodes, so a task gives a row or two for each node however many links there are.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing, and vectors
of different length never with each other; equal vectors link unless they are such; repeated rows and
rows without id are rows of their own, and an id names a component only if it is the least there; an index without an audited
link has a recall of 1; an empty table
gives an empty result; columns other than the key and the vector are not passed on, so no names can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written
from .components import components

THRESHOLD = 0.95
#: Rows that pivots are drawn from, at most, and pivots, for each length; the same for each shard that is refined.
SAMPLE, PIVOTS = 4_096, 1_024
SUBSAMPLE, SUBPIVOTS, SUBOVERLAP = 64, 32, 2
APART = 0.8
OVERLAP = 3
#: Nodes of a shard on average, and of a piece of a shard at most.
SHARD, PIECE = 800, 2_000
#: Pieces whose nodes one task lets ask.
ASKING = 16
CANDIDATES, DEGREE, LONG_EDGES, ALPHA = 40, 24, 4, 1.2
MEDOIDS, BEAM = 16, 24
#: The range that is expanded around finds reaches so far below the threshold.
SLACK = 0.08
RECALL, REQUIRED = 0.97, 0.9
#: An audit draws from the nodes of ids that this divides, so many at first and at a time, and wants so many with true links.
AUDITED_IDS, AUDITED, AUDITED_AT_ONCE, ENOUGH = 20, 256, 4_096, 256
#: Nodes that are compared with all others at a time where no index will do.
BLOCK = 4_096
LINKS = "a long, b long, n long, kind long"


def nodes_of(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, node, unit) for each row: node is the vector's digest, unit its direction; null if it links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for b in batches:
            nodes, units = [], []
            for v in b.column(1).to_pylist():
                x = np.array([np.nan if c is None else c for c in v or ()], np.float64)
                peak = np.abs(x).max() if len(x) else 0.0
                if not (np.isfinite(x).all() and peak > 0):
                    nodes.append(None), units.append(None)
                    continue
                x = x + 0.0  # one zero
                n = xxh3_64_intdigest(x.tobytes())
                x = x / peak
                nodes.append(n - (1 << 64) if n >> 63 else n)
                units.append((x / np.sqrt(x @ x)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes, pa.int64()), pa.array(units, pa.binary())], names=[key, "node", "unit"])

    return df.select(key, F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, node long, unit binary")


def _matrix(column) -> np.ndarray:
    data = b"".join(column)
    return np.frombuffer(data, np.float64).reshape(len(column), -1)


def _by_length(units: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, which, matrix) of the vectors of each length."""
    sizes = np.array([len(u) // 8 for u in units], np.int64)
    for d in np.unique(sizes).tolist():
        which = np.flatnonzero(sizes == d)
        yield d, which, _matrix([units[i] for i in which])


def _apart(x: np.ndarray, most: int) -> np.ndarray:
    """The first rows that are no neighbours of each other, as many as are wanted."""
    chosen: list[int] = []
    for i in range(len(x)):
        if len(chosen) == most:
            break
        if not chosen or (x[chosen] @ x[i]).max() < APART:
            chosen.append(i)
    return x[chosen]


def pivots_of(nodes: DataFrame, overlap: int) -> dict[int, np.ndarray]:
    """For each length with nodes for two shards or more: well-separated directions of its sample, as many as shards are wanted."""
    sized = nodes.select("node", "unit", (F.octet_length("unit") / 8).cast("long").alias("d"))
    many = sized.groupBy("d").agg(F.count("*").alias("n")).filter(F.col("n") * overlap >= 2 * SHARD).collect()  # a row a length
    out = {}
    for d, n in sorted(tuple(r) for r in many):
        sample = sized.filter(F.col("d") == d).orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("unit").toArrow().column(0).to_pylist()
        out[d] = _apart(_matrix(sample), min(PIVOTS, n * overlap // SHARD))
    return out


ASSIGNED = "node long, weight long, unit binary, shard long, home long, shards array<long>"


def _assign(nodes: DataFrame, pivots: dict[int, np.ndarray], overlap: int) -> DataFrame:
    """(node, weight, unit, shard, home, shards) for each of a node's shards; home is its nearest. A shard is a length and a pivot."""
    sent = nodes.sparkSession.sparkContext.broadcast(pivots)  # at most PIVOTS rows a length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, which, x in _by_length(b.column(2).to_pylist()):
                p = sent.value.get(d)
                near = np.zeros((len(x), 1), np.int64) if p is None else np.argsort(-(x @ p.T), axis=1, kind="stable")[:, : min(overlap, len(p))]
                yield _assigned(b, which, (near.astype(np.int64) << 16) + (d << 40))

    return nodes.select("node", "weight", "unit").mapInArrow(run, ASSIGNED)


def _assigned(b: pa.RecordBatch, which: np.ndarray, shards: np.ndarray) -> pa.RecordBatch:
    """Rows of a batch once for each shard, with all their shards; the first is their home."""
    fresh = np.stack([(shards[:, :c] != shards[:, c : c + 1]).all(1) for c in range(shards.shape[1])], axis=1)
    row, _ = np.nonzero(fresh)
    take, k = pa.array(which[row]), shards.shape[1]
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(row) * k + 1, k, dtype=np.int32)), pa.array(shards[row].reshape(-1)))
    return pa.RecordBatch.from_arrays(
        [*(b.column(c).take(take) for c in range(3)), pa.array(shards[fresh]), pa.array(shards[row, 0]), lists],
        names=["node", "weight", "unit", "shard", "home", "shards"],
    )


def _refined(nodes: DataFrame, shards: DataFrame, pivots: dict[int, np.ndarray], overlap: int) -> DataFrame:
    """Shards of more than two pieces become leaves of pivots of their own, drawn from a sample of each."""
    large = shards.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * PIECE)
    if large.isEmpty():
        return shards
    # At most SUBSAMPLE rows for each shard, of which there are PIVOTS a length at most.
    drawn = shards.join(F.broadcast(large), "shard").withColumn("nth", F.row_number().over(W.partitionBy("shard").orderBy(F.xxhash64("node"), "node")))
    rows = drawn.filter(F.col("nth") <= SUBSAMPLE).orderBy("shard", "nth").select("shard", "n", "unit").toArrow()
    shard, size, units = rows.column(0).to_numpy(), rows.column(1).to_numpy(), rows.column(2).to_pylist()
    own = {int(k): _apart(_matrix([units[i] for i in np.flatnonzero(shard == k)]), min(SUBPIVOTS, int(size[shard == k][0]) // SHARD)) for k in np.unique(shard)}
    sent = nodes.sparkSession.sparkContext.broadcast((pivots, own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, own = sent.value
        for b in batches:
            for d, which, x in _by_length(b.column(2).to_pylist()):
                p = pivots.get(d)
                near = np.zeros((len(x), 1), np.int64) if p is None else np.argsort(-(x @ p.T), axis=1, kind="stable")[:, : min(overlap, len(p))].astype(np.int64)
                shards = (near << 16) + (d << 40)
                leaves = np.repeat(shards, SUBOVERLAP, axis=1)  # a shard without pivots of its own is one leaf, named twice
                for k in np.unique(shards):
                    if (sub := own.get(int(k))) is not None:
                        i, j = np.nonzero(shards == k)
                        inner = np.argsort(-(x[i] @ sub.T), axis=1, kind="stable")[:, :SUBOVERLAP]
                        for c in range(SUBOVERLAP):
                            leaves[i, SUBOVERLAP * j + c] += 1 + inner[:, min(c, inner.shape[1] - 1)]
                yield _assigned(b, which, leaves)

    return nodes.select("node", "weight", "unit").mapInArrow(run, ASSIGNED)


def robust_pruned(x: np.ndarray) -> np.ndarray:
    """Edges (from, to) of a flat graph over unit vectors."""
    m = len(x)
    if m < 2:
        return np.zeros((0, 2), np.int64)
    rng = np.random.default_rng(m)
    edges = []
    k = min(CANDIDATES, m - 1)
    for lo in range(0, m, 256):
        rows = np.arange(lo, min(m, lo + 256))
        s = x[rows] @ x.T
        s[np.arange(len(rows)), rows] = -2
        near = np.argpartition(-s, k - 1, axis=1)[:, :k]
        order = np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable")
        near = np.take_along_axis(near, order, 1)
        far = 2 - 2 * np.take_along_axis(s, near, 1)
        own = x[near]
        between = 2 - 2 * np.einsum("bik,bjk->bij", own, own)
        alive = np.ones(near.shape, bool)
        for _ in range(min(DEGREE, k)):
            going = alive.any(1)
            if not going.any():
                break
            pick = alive.argmax(1)
            edges.append(np.stack([rows[going], near[going, pick[going]]], 1))
            alive[np.arange(len(rows)), pick] = False
            alive &= ALPHA**2 * between[np.arange(len(rows)), pick] > far
        long = rng.integers(0, m, (len(rows), LONG_EDGES))
        edges.append(np.stack([np.repeat(rows, LONG_EDGES), long.reshape(-1)], 1))
    out = np.concatenate(edges)
    out = out[out[:, 0] != out[:, 1]]
    return np.unique(np.concatenate([out, out[:, ::-1]]), axis=0)


def _build(key, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("node")
    node, e = pdf["node"].to_numpy(), robust_pruned(_matrix(pdf["unit"].tolist()))
    cut = np.searchsorted(e[:, 0], np.arange(len(node) + 1))
    return pd.DataFrame({"node": node, "near": [node[e[a:b, 1]] for a, b in zip(cut[:-1], cut[1:], strict=True)]})


def medoids_of(x: np.ndarray) -> np.ndarray:
    """The vector nearest to the mean, then those farthest from all chosen so far."""
    chosen = [int((x @ x.mean(0)).argmax())]
    best = x @ x[chosen[0]]
    while len(chosen) < min(MEDOIDS, len(x)):
        chosen.append(int(best.argmin()))
        best = np.maximum(best, x @ x[chosen[-1]])
    return np.array(chosen)


def range_search(x: np.ndarray, first: np.ndarray, to: np.ndarray, medoids: np.ndarray, q: np.ndarray, beam: int, seen: np.ndarray, mark: int) -> np.ndarray:
    """Indices whose cosine with q reaches the threshold, as the graph leads to them.

    ``first`` and ``to`` are the adjacency lists; ``seen`` holds the mark of the last search that met a node.
    """

    def neighbours(of: np.ndarray) -> np.ndarray:
        out = np.unique(np.concatenate([to[first[i] : first[i + 1]] for i in of]))
        out = out[seen[out] != mark]
        seen[out] = mark
        return out

    known, sims = medoids, x[medoids] @ q
    seen[known] = mark
    spread: set[int] = set()
    while True:  # greedy: spread the nearest known until the beam has been
        top = [i for i in known[np.argsort(-sims, kind="stable")[:beam]].tolist() if i not in spread][:4]
        if not top:
            break
        spread.update(top)
        new = neighbours(np.array(top))
        if len(new):
            known, sims = np.concatenate([known, new]), np.concatenate([sims, x[new] @ q])
            if len(known) > 8 * beam:  # only what may still matter
                keep = np.argsort(-sims, kind="stable")[: 4 * beam]
                keep = np.union1d(keep, np.flatnonzero(sims >= THRESHOLD - SLACK))
                known, sims = known[keep], sims[keep]
    inside = sims >= THRESHOLD - SLACK
    found, front = [known[sims >= THRESHOLD]], np.array([i for i in known[inside].tolist() if i not in spread], np.int64)
    while len(front):  # range expansion
        new = neighbours(front)
        s = x[new] @ q
        found.append(new[s >= THRESHOLD])
        front = new[s >= THRESHOLD - SLACK]
    return np.concatenate(found)


def _searcher(beam: int):
    def search(key, pdf: pd.DataFrame) -> pd.DataFrame:
        """Of a piece and some that ask there: (a, b, n, kind); kind 0: n more linked weight of a, 1: edge of a component.

        Where a pair could meet in two tasks, one counts it for both its nodes. Of different homes the lesser counts,
        if the other can be found there; of two pieces of a home, the nodes' own numbers choose who asks.
        """
        pdf = pdf.sort_values(["asks", "node"])
        members, asking = pdf[~pdf["asks"]], pdf[pdf["asks"]]
        empty = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("a", "b", "n", "kind")})
        if not len(members) or not len(asking):
            return empty
        node, weight, home = (members[c].to_numpy() for c in ("node", "weight", "home"))
        x, q = _matrix(members["unit"].tolist()), _matrix(asking["unit"].tolist())
        lists = [np.asarray(v, np.int64) for v in members["near"]]
        flat = np.concatenate(lists)
        at = np.minimum(np.searchsorted(node, flat), len(node) - 1)
        ok = node[at] == flat  # neighbours of the united lists that lie here
        kept = np.concatenate(([0], np.cumsum(ok)))
        first = kept[np.cumsum([0, *map(len, lists)])]
        to, medoids, seen = at[ok], medoids_of(x), np.zeros(len(node), np.int64)
        own = {n: i for i, n in enumerate(node.tolist())}
        root, linked = np.arange(len(node)), np.zeros(len(node), np.int64)
        both = np.zeros((len(node), len(node)), bool)  # who of this piece found whom
        out: list[tuple[int, int, int, int]] = []
        for mark, (a, w, shards, v) in enumerate(zip(asking["node"].tolist(), asking["weight"].tolist(), asking["near"], q, strict=True), 1):
            hit = range_search(x, first, to, medoids, v, beam, seen, mark)
            hit = hit[node[hit] != a]
            if not len(hit):
                continue
            i = own.get(a)
            near = home[hit] == key[0]
            mine = ~near & ((key[0] < home[hit]) | ~np.isin(home[hit], shards))
            if i is None:
                mine |= near & (((node[hit] ^ a) & 1 == 0) == (node[hit] > a))
                out.append((a, int(node[hit[0]]), int(weight[hit[mine]].sum()), 1))
            else:
                both[i, hit[near]] = True
                linked[i] += weight[hit[mine]].sum()
            linked[hit[mine]] += w
            group = hit if i is None else np.append(hit, i)
            roots = np.unique(_roots(root, group))  # a forest of what links here
            root[roots] = roots[0]
        linked += (both | both.T) @ weight
        top = _roots(root, np.arange(len(node)))
        some, moved = np.flatnonzero(linked), np.flatnonzero(top != np.arange(len(node)))
        rows = [(a, 0, n, 0) for a, _, n, _ in out if n] + [(a, b, 0, 1) for a, b, _, _ in out]
        return pd.concat([
            pd.DataFrame(rows, columns=["a", "b", "n", "kind"]).astype("int64"),
            pd.DataFrame({"a": node[some], "b": 0, "n": linked[some], "kind": 0}), pd.DataFrame({"a": node[moved], "b": node[top[moved]], "n": 0, "kind": 1}),
        ])

    return search


def _roots(root: np.ndarray, of: np.ndarray) -> np.ndarray:
    out = root[of]
    while (root[out] != out).any():
        out = root[out]
    root[of] = out
    return out


def _pieces(shards: DataFrame) -> DataFrame:
    """Rows with the number of pieces of their shard, and the piece they belong to."""
    sizes = shards.groupBy("shard").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))
    # As many rows as leaves.
    return shards.join(F.broadcast(sizes), "shard").withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))


def links(nodes: DataFrame, pivots: dict[int, np.ndarray], overlap: int, beam: int) -> DataFrame:
    """(a, b, n, kind), as _searcher says, over all leaves."""
    shards = written(_assign(nodes, pivots, overlap), "vector-assigned")
    shards = written(_pieces(_refined(nodes, shards, pivots, overlap)), "vector-shards")
    graph = shards.groupBy("shard", "piece").applyInPandas(_build, "node long, near array<long>")
    united = written(graph.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "vector-graph")
    # A task holds one piece and the nodes of ASKING others that ask there.
    parts = F.sequence(F.lit(0), F.floor((F.col("pieces") - 1) / ASKING).cast("int"))
    members = shards.join(united, "node").select(
        "shard", "piece", F.explode(parts).alias("part"), "node", "weight", "home", "unit", "near", F.lit(False).alias("asks")
    )
    asking = shards.filter("shard = home").select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("to"), F.floor(F.col("piece") / ASKING).cast("int").alias("part"),
        "node", "weight", "home", "unit", F.col("shards").alias("near"), F.lit(True).alias("asks"),
    ).withColumnRenamed("to", "piece")
    return members.unionByName(asking).groupBy("shard", "piece", "part").applyInPandas(_searcher(beam), LINKS)


def counted(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(node, linked: weight of the other nodes it links with) of nodes with links."""
    return found.filter("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked"))


def audit(nodes: DataFrame, linked: DataFrame) -> float:
    """Share of the true links that the index has found, for the audited nodes by hash, against all nodes in blocks.

    The lesser of the share of the linked weight and the mean share of a node, so that one group of many copies does
    not speak for all others.
    """

    def against(ids: np.ndarray, units: list[bytes]) -> list:
        sent = nodes.sparkSession.sparkContext.broadcast((ids, {d: (which, x) for d, which, x in _by_length(units)}))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, asked = sent.value
            total = np.zeros(len(ids), np.int64)
            for b in batches:
                for d, rows, x in _by_length(b.column(2).to_pylist()):
                    if d in asked:
                        which, q = asked[d]
                        near = (x @ q.T >= THRESHOLD) & (b.column(0).to_numpy()[rows][:, None] != ids[which])
                        total[which] += b.column(1).to_numpy()[rows] @ near
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(total[some])], names=["node", "true"])

        true = nodes.select("node", "weight", "unit").mapInArrow(run, "node long, true long").groupBy("node").agg(F.sum("true").alias("true"))
        return true.join(linked, "node", "left").select("true", F.least("true", F.coalesce("linked", F.lit(0)))).collect()  # one row a drawn node at most

    order, drawn, size, seen = nodes.filter("audited").orderBy(F.xxhash64("node"), "node").select("node", "unit"), 0, AUDITED, []
    while len(seen) < ENOUGH:
        rows = order.offset(drawn).limit(size).toArrow()
        if not rows.num_rows:
            break
        seen += against(rows.column(0).to_numpy(), rows.column(1).to_pylist())
        drawn, size = drawn + rows.num_rows, min(4 * size, AUDITED_AT_ONCE)
    if not seen:
        return 1.0
    true, found = np.array(seen, np.float64).T
    return float(min(found.sum() / true.sum(), (found / true).mean()))


def exact_links(nodes: DataFrame, n: int) -> DataFrame:
    """(a, b, n, kind), as _searcher says, of all pairs: blocks of nodes against all nodes."""
    spark, blocks, paths = nodes.sparkSession, -(-n // BLOCK), []
    for k in range(blocks):
        block = nodes.filter(F.pmod(F.xxhash64("node"), F.lit(blocks)) == k).select("node", "unit").toArrow()  # about BLOCK rows
        if not block.num_rows:
            continue
        sent = spark.sparkContext.broadcast((block.column(0).to_numpy(), {d: (which, x) for d, which, x in _by_length(block.column(1).to_pylist())}))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, asked = sent.value
            total = np.zeros(len(ids), np.int64)
            for b in batches:
                for d, rows, x in _by_length(b.column(2).to_pylist()):
                    if d not in asked:
                        continue
                    which, q = asked[d]
                    own = b.column(0).to_numpy()[rows]
                    near = (x @ q.T >= THRESHOLD) & (own[:, None] != ids[which])
                    total[which] += b.column(1).to_numpy()[rows] @ near
                    # A forest of what links here: rows of the batch, then those of the block.
                    name, root = np.concatenate([own, ids[which]]), np.arange(len(own) + len(which))
                    for j in np.flatnonzero(near.any(0)):
                        roots = np.unique(_roots(root, np.append(np.flatnonzero(near[:, j]), len(own) + j)))
                        root[roots] = roots[0]
                    top = _roots(root, np.arange(len(root)))
                    moved = np.flatnonzero(top != np.arange(len(root)))
                    yield _link_rows(name[moved], name[top[moved]], np.zeros(len(moved), np.int64), 1)
            some = np.flatnonzero(total)
            yield _link_rows(ids[some], np.zeros(len(some), np.int64), total[some], 0)

        paths.append(written(nodes.select("node", "weight", "unit").mapInArrow(run, LINKS), "vector-exact").quillon_path)
    return spark.read.schema(LINKS).parquet(*paths)


def _link_rows(a: np.ndarray, b: np.ndarray, n: np.ndarray, kind: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n), pa.array(np.full(len(a), kind, np.int64))], names=["a", "b", "n", "kind"])


class Report(NamedTuple):
    """What an index has come to: audited recall of the links returned, indexes built, and whether all pairs were compared in the end."""

    recall: float
    built: int
    compared_all: bool


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, n_links, component_id, kept, recall) for each row; recall, the same in all rows, is the audit's of the links counted."""
    out, report = near_duplicates_with_report(df, key, vector)
    return out.withColumn("recall", F.lit(report.recall))


def near_duplicates_with_report(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, Report]:
    """((key, n_links, component_id, kept) for each row, report)."""
    rows = written(nodes_of(df, key, vector), "vector-rows")
    number = F.xxhash64(key) if df.schema[key].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint") else F.col(key)
    audited = F.coalesce(F.bool_or(number % AUDITED_IDS == 0), F.lit(False)).alias("audited")
    nodes = rows.filter("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("weight"), F.first("unit").alias("unit"), audited)
    nodes = written(nodes, "vector-nodes")
    n, overlap, beam = nodes.count(), OVERLAP, BEAM
    for attempt in range(3):
        pivots = pivots_of(nodes, overlap)
        found = written(links(nodes, pivots, overlap, beam) if n else df.sparkSession.createDataFrame([], LINKS), "vector-links")
        linked = written(counted(nodes, found), "vector-linked")
        recall = audit(nodes, linked)
        if recall >= RECALL:
            break
        overlap, beam = 2 * overlap, 2 * beam
    report = Report(recall, attempt + 1, recall < REQUIRED)
    if report.compared_all:
        report = report._replace(recall=1.0)
        found = written(exact_links(nodes, n), "vector-links")
        linked = written(counted(nodes, found), "vector-linked")
    parts = components(found.filter("kind > 0").select("a", "b")).withColumnRenamed("id", "node")
    named = (
        rows.select(key, "node").join(parts, "node", "left").join(linked, "node", "left").join(nodes.select("node", "weight"), "node", "left")
        .select(
            key, F.coalesce("component", "node").alias("class"),
            F.when(F.col("node").isNull(), F.lit(0)).otherwise(F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        )
    )
    named = written(named, "vector-named")
    least = named.filter("class IS NOT NULL").groupBy("class").agg(F.min(key).alias("component_id"))
    own = F.when(F.col("class").isNull(), F.col(key)).otherwise(F.col("component_id"))
    out = named.join(least, "class", "left").select(key, "n_links", own.alias("component_id"), F.coalesce(F.col(key) == own, F.lit(False)).alias("kept"))
    return out, report
