"""Conversation prefix trie by polynomial rolling prefix fingerprints.

1. Turns are dealt out by ranges of (conversation, turn), so that a conversation of any length spreads over tasks. Each
   task numbers its turns and scans them, in numpy, into the fingerprints of all prefixes: f(d) = f(d-1) * base + hash(turn d)
   modulo a prime, twice. The affine steps of the recurrence are associative, so a scan by doubling does a batch,
   and what earlier tasks hold of a conversation enters as one step more.
2. A rebuilt conversation takes its first turns from a donor. The fingerprint rolls on: what the own head added is
   taken off and the donor's put in its place, without scanning again.
3. Equal (depth, fingerprint) are candidates of one node. They are dealt out by ranges of (fingerprint, conversation), and each
   member's last turn and parent are compared with those of its representative, the member of least id there; the
   representatives of a group that lies in several tasks are compared with each other. Where two differ, the group is
   split by what they say: all but the first class get a tag, the depth and the class's least member, which is part
   of the key from there on. Splitting repeats until every group is of one mind, so nodes are exact however the prime is chosen.
4. Parent rollup: a node belongs to its least member, so a conversation owns the nodes of its last turns. What a conversation
   owns (leaves, saved tokens) counts for each of the nodes above, which are prefixes of that conversation: one sum by
   key over the turns, whatever the depth.

No conversation, node or donor is one task's, nor held whole: ids of members that end at a node are joined to text piece
by piece, and the pieces are digested in order.

Defined cases: null texts and roles are empty; null turns come first, and equal turns follow by role, then text;
repeated rows are repeated turns; rows without conv_id belong to no conversation; a conversation of one turn may be rebuilt
to none and is a member of the root alone; for ids below zero the donor is c - c % 100 with Spark's remainder; an
empty table has no node, not even a root; columns other than the four are ignored, so no names can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, tasks, written

#: A prime below 2**31, so that products fit in 63 bits, and two bases.
MODULUS, BASES = (1 << 31) - 1, (1_103_515_245, 1_812_433_253)
#: Conversations of one hundred share a donor, which gives fewer than HEAD turns.
FAMILY, HEAD = 100, 6
#: A parent is hot if more than one in so many nodes is its child; there are fewer than that, and they are broadcast.
HOT_SHARE, HOT_LEAST = 10_000, 1_000
KEY = ["depth", "fp", "tag_depth", "tag_conv"]


def turns_of(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, h0, h1): rows of a conversation, with the residues of their hash."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text")}
    rows = df.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text["role"].alias("role"), text["text"].alias("text"))
    residue = lambda *c: F.pmod(F.xxhash64(*c), F.lit(MODULUS - 1)) + 1
    return rows.select("*", residue("role", "text").alias("h0"), residue("text", "role", F.lit(1)).alias("h1"))


def scan(h: np.ndarray, starts: np.ndarray, base: int, seed: int) -> np.ndarray:
    """f[i] = f[i-1] * base + h[i] modulo MODULUS; f[i-1] is 0 where a conversation starts, ``seed`` before the first row."""
    f = h.astype(np.uint64) % MODULUS
    m = np.where(starts, 0, base % MODULUS).astype(np.uint64)
    if len(f) and not starts[0]:
        f[0] = (seed * base + int(f[0])) % MODULUS
    if len(m):
        m[0] = 0
    s = 1
    while s < len(f) and m.any():
        f[s:] = (f[:-s] * m[s:] + f[s:]) % MODULUS
        m[s:] = m[:-s] * m[s:] % MODULUS
        m[:s] = 0
        s *= 2
    return f.astype(np.int64)


def numbered(turns: DataFrame) -> DataFrame:
    """Turns with pos (from 1) and the prefix fingerprints f0 and f1 of their own conversation."""
    dealt = turns.repartitionByRange("conv_id", F.asc_nulls_first("turn"), "role", F.substring("text", 1, 32))
    dealt = dealt.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text").withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, pos, seeds = None, 0, (0, 0)
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column("conv_id").to_numpy()
            starts = np.append(conv is None or ids[0] != conv, ids[1:] != ids[:-1])
            at = np.arange(1, len(ids) + 1)
            first = np.maximum.accumulate(np.where(starts, at - 1, -1))
            own = np.where(first >= 0, at - first, at + pos)
            fs = [scan(b.column(f"h{k}").to_numpy(), starts, BASES[k], seeds[k]) for k in (0, 1)]
            conv, pos, seeds = ids[-1], int(own[-1]), (int(fs[0][-1]), int(fs[1][-1]))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("conv_id", "part", "role", "text", "h0", "h1")), pa.array(own), *map(pa.array, fs)],
                names=["conv_id", "part", "role", "text", "h0", "h1", "pos", "f0", "f1"],
            )

    schema = "conv_id long, part int, role string, text string, h0 long, h1 long, pos long, f0 long, f1 long"
    local = written(dealt.drop("turn").mapInArrow(tasks("prefix_trie", run), schema), "trie-turns")
    # Conversations that lie in several tasks: two for each border between tasks at most, so the driver may hold them.
    ends = local.groupBy("conv_id", "part").agg(F.max(F.struct("pos", "f0", "f1")).alias("end"))
    split = ends.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "end"))).alias("ends")).filter(F.size("ends") > 1).collect()
    carried = []
    for conv, parts in split:
        pos, f = 0, [0, 0]
        for part, (n, *last) in parts:
            carried.append((conv, part, pos, *f))
            pos, f = pos + n, [(f[k] * pow(BASES[k], n, MODULUS) + last[k]) % MODULUS for k in (0, 1)]
    if not carried:
        return local.drop("part")
    carry = local.sparkSession.createDataFrame(carried, "conv_id long, part int, n long, c0 long, c1 long")
    return _rolled(
        local.join(F.broadcast(carry), ["conv_id", "part"], "left"),
        lambda c: {"pos": c["pos"] + c["n"], **{f"f{k}": (c[f"c{k}"] * powers(BASES[k], c["pos"]) + c[f"f{k}"]) % MODULUS for k in (0, 1)}},
        ["conv_id", "role", "text", "h0", "h1", "pos", "f0", "f1"],
    )


def powers(base: int, n: np.ndarray) -> np.ndarray:
    """base**n modulo MODULUS for each n >= 0."""
    out, square, n = np.ones(len(n), np.int64), base % MODULUS, n.copy()
    out %= MODULUS
    while n.any():
        odd = (n & 1).astype(bool)
        out[odd] = out[odd] * square % MODULUS
        square, n = square * square % MODULUS, n >> 1
    return out


def _rolled(df: DataFrame, fresh, columns: list[str]) -> DataFrame:
    """``columns`` of df after numpy expressions over its long columns (nulls count as 0) have replaced some or added new ones."""
    longs = [f.name for f in df.schema.fields if f.dataType.simpleString() == "bigint"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = fresh({c: b.column(c).fill_null(0).to_numpy() for c in longs})
            yield pa.RecordBatch.from_arrays([pa.array(new[c]) if c in new else b.column(c) for c in columns], names=columns)

    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString() if c in df.columns else 'long'}" for c in columns)
    return df.mapInArrow(tasks("prefix_trie", run), schema)


def rebuilt(turns: DataFrame, heads: Column | None = None) -> DataFrame:
    """(conv_id, depth, role, text, fp, parent_fp, last): the turns of every rebuilt conversation and a textless row of depth 0.

    ``heads`` is how many turns a conversation takes from its donor, fewer than HEAD; ``last`` marks a conversation's deepest row.
    """
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD if heads is None else heads
    # Of each conversation its length and the fingerprints of its first prefixes, fewer than HEAD.
    head = F.when(F.col("pos") < HEAD, F.struct("pos", "f0", "f1"))
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("n"), F.sort_array(F.collect_list(head)).alias("head"))
    convs = written(convs.withColumns({"h": heads.cast("long"), "donor": F.col("conv_id") - F.col("conv_id") % FAMILY}), "trie-convs")
    donors = convs.filter(F.col("conv_id") == F.col("donor")).select("donor", F.col("n").alias("dn"), F.col("head").alias("dhead"))
    k = F.least("h", F.coalesce("dn", F.lit(0)))
    at = lambda a, i, f: F.when(i > 0, F.get(a, (i - 1).cast("int"))[f]).otherwise(0)
    plan = convs.join(donors, "donor", "left").select(
        "conv_id", "donor", "h", k.alias("k"), (k + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size"),
        *[at(F.col("dhead"), k, f"f{i}").alias(f"d{i}") for i in (0, 1)], *[at(F.col("head"), F.least("h", "n"), f"f{i}").alias(f"o{i}") for i in (0, 1)],
    )
    plan = written(plan, "trie-plan")
    columns = ["conv_id", "depth", "role", "text", "fp", "parent_fp", "last"]

    def fingerprints(c: dict) -> dict:
        depth, out = c["k"] + c["pos"] - c["h"], {}
        fs = []
        for i in (0, 1):
            # The donor's prefix, then the turns since; h and k are 0 where the turn is the donor's own.
            power = powers(BASES[i], c["pos"] - c["h"])
            fs.append((c[f"d{i}"] * power + c[f"f{i}"] - c[f"o{i}"] * power % MODULUS) % MODULUS)
        back = [(fs[i] - c[f"h{i}"]) % MODULUS * pow(BASES[i], -1, MODULUS) % MODULUS for i in (0, 1)]
        out["depth"], out["fp"], out["parent_fp"] = depth, fs[0] << 31 | fs[1], back[0] << 31 | back[1]
        return out | {"last": depth == c["size"]}

    own = turns.join(plan, "conv_id").filter(F.col("pos") > F.col("h"))
    taken = turns.filter((F.col("pos") < HEAD) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "donor")
    zero = [F.lit(0).cast("long").alias(c) for c in ("h", "k", "d0", "d1", "o0", "o1")]
    given = taken.join(plan.select("donor", "conv_id", "size", F.col("k").alias("most")), "donor").filter(F.col("pos") <= F.col("most")).select("*", *zero)
    needed = ["conv_id", "role", "text", "h0", "h1", "pos", "f0", "f1", "h", "k", "size", "d0", "d1", "o0", "o1"]
    both = own.select(*needed).unionByName(given.select(*needed)).withColumn("last", F.lit(False))
    zero = F.lit(0).cast("long")
    roots = plan.select("conv_id", zero.alias("depth"), F.lit("").alias("role"), F.lit("").alias("text"), zero.alias("fp"), zero.alias("parent_fp"), (F.col("size") == 0).alias("last"))
    return written(_rolled(both, fingerprints, columns).unionByName(roots), "trie-rebuilt")


def _keyed(rows: DataFrame, splits: DataFrame | None) -> DataFrame:
    """Rows with their tags and their parent's: those of the deepest split of the conversation at their depth or above."""
    zero = F.lit(0).cast("long")
    if splits is None:
        return rows.select("*", *[zero.alias(c) for c in ("tag_depth", "tag_conv", "parent_tag_depth", "parent_tag_conv")])
    of = splits.groupBy("conv_id").agg(F.collect_list(F.struct("tag_depth", "tag_conv")).alias("tags"))  # a split a depth at most
    latest = lambda d: F.array_max(F.filter("tags", lambda t: t["tag_depth"] <= d))
    out = rows.join(of, "conv_id", "left").withColumns({"__own": latest(F.col("depth")), "__up": latest(F.col("depth") - 1)})
    fields = {f"{p}{c}": F.coalesce(F.col(s)[c], zero) for p, s in (("", "__own"), ("parent_", "__up")) for c in ("tag_depth", "tag_conv")}
    return out.withColumns(fields).drop("tags", "__own", "__up")


SAYS = ["parent_fp", "parent_tag_depth", "parent_tag_conv", "role", "text"]
GROUPS = "depth long, fp long, tag_depth long, tag_conv long, parent_fp long, parent_tag_depth long, parent_tag_conv long, role string, text string, conv_id long, n long, chars long, ends string, differs boolean"


def grouped(rows: DataFrame) -> DataFrame:
    """Of each batch and candidate group: key, what its representative says (role and text at a batch's borders only), members and ends.

    ``n`` is the number of members, ``conv_id`` the least, ``chars`` the code points of the last text, ``ends`` the ids of those that end there, ascending;
    ``differs`` if any member says other than the representative.
    """
    dealt = rows.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep_key = rep = None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(c).to_numpy() for c in KEY], axis=1)
            cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]]).tolist()
            conv, last = b.column("conv_id").to_pylist(), b.column("last").to_numpy(zero_copy_only=False)
            says = list(zip(*(b.column(c).to_pylist() for c in SAYS), strict=True))
            out = []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                key = tuple(keys[lo].tolist())
                if key != rep_key:
                    rep_key, rep = key, says[lo]
                shown = rep if lo == 0 or hi == len(keys) else (*rep[:3], None, None)
                ends = ",".join([str(c) for c, e in zip(conv[lo:hi], last[lo:hi], strict=True) if e])
                out.append((*key, *shown, conv[lo], hi - lo, len(rep[4]), ends or None, any(s != rep for s in says[lo:hi])))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    names = [part.split()[0] for part in GROUPS.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[part.split()[1]] for part in GROUPS.split(", ")]
    return dealt.select(*KEY, *SAYS, "conv_id", "last").mapInArrow(tasks("prefix_trie", run), GROUPS)


def candidates(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups of verified keys, members that must leave their group as (conv_id, tag_depth, tag_conv)) of keyed rows."""
    groups = written(grouped(rows), "trie-groups")
    spread = F.struct(*SAYS)
    doubted = groups.groupBy(*KEY).agg(F.bool_or("differs").alias("differs"), (F.min(spread) != F.max(spread)).alias("apart")).filter("differs OR apart")
    doubted = written(doubted.select(*KEY), "trie-doubted")
    if doubted.isEmpty():
        return groups, None
    inside = rows.join(doubted, KEY)
    classes = inside.groupBy(*KEY, *SAYS).agg(F.min("conv_id").alias("tag"))
    first = classes.groupBy(*KEY).agg(F.min("tag").alias("least"))
    moved = classes.join(first, KEY).filter("tag <> least").drop("least")
    leaving = inside.join(moved, [*KEY, *SAYS]).select("conv_id", F.col("depth").alias("tag_depth"), F.col("tag").alias("tag_conv"))
    return groups, written(leaving, "trie-leaving")


def nodes_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keyed rows, groups), every group verified."""
    splits = None
    while True:
        keyed = _keyed(rows, splits)
        groups, leaving = candidates(keyed)
        if leaving is None:
            return keyed, groups
        splits = leaving if splits is None else splits.unionByName(leaving)
        # A later split at a depth says all that an earlier one there did.
        splits = written(splits.groupBy("conv_id", "tag_depth").agg(F.max("tag_conv").alias("tag_conv")), "trie-splits")


def ends_digest(groups: DataFrame) -> DataFrame:
    """(key, ends_sha256) of nodes where some conversation ends."""
    pieces = groups.filter("ends IS NOT NULL").select(*KEY, "conv_id", "ends")
    several = pieces.groupBy(*KEY).agg(F.count("*").alias("k"), F.first("ends").alias("ends"))
    one = several.filter("k = 1").select(*KEY, F.sha2(F.col("ends").cast("binary"), 256).alias("ends_sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, hashlib.sha256()
        for b in batches:
            out = []
            for *key, ends in zip(*(b.column(c).to_pylist() for c in (*KEY, "ends")), strict=True):
                if key != at:
                    if at is not None:
                        out.append((*at, digest.hexdigest()))
                    at, digest = key, hashlib.sha256(ends.encode())
                else:
                    digest.update(b"," + ends.encode())
            yield batch(out)
        if at is not None:
            yield batch([(*at, digest.hexdigest())])

    def batch(out: list) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 4 + [pa.string()], strict=True)], names=[*KEY, "ends_sha256"])

    more = pieces.join(several.filter("k > 1").select(*KEY), KEY, "left_semi").repartition(*KEY).sortWithinPartitions(*KEY, "conv_id")
    return one.unionByName(more.select(*KEY, "ends").mapInArrow(tasks("prefix_trie", run), ", ".join(f"{c} long" for c in KEY) + ", ends_sha256 string"))


def running(df: DataFrame, group: str, order: Column, value: str) -> DataFrame:
    """df with ``total``, the sum of a group's long ``value`` so far in descending ``order``; groups spread over tasks."""
    dealt = df.repartitionByRange(group, order.desc()).sortWithinPartitions(group, order.desc()).withColumn("part", F.spark_partition_id())
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema.fields) + ", total long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            ids, v = b.column(group).to_numpy(), b.column(value).to_numpy()
            sums = np.cumsum(v)
            starts = np.append(True, ids[1:] != ids[:-1])
            before = np.where(starts, sums - v, 0)[np.maximum.accumulate(np.where(starts, np.arange(len(ids)), 0))]
            total = sums - before + np.where(ids == at, held, 0)
            at, held = ids[-1], int(total[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(total)], names=[*b.schema.names, "total"])

    local = written(dealt.mapInArrow(tasks("prefix_trie", run), schema), "trie-running")
    ends = local.groupBy(group, "part").agg(F.sum(value).alias("sum"))
    split = ends.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("part", "sum"))).alias("ends")).filter(F.size("ends") > 1).collect()
    carried = [(g, parts[i][0], sum(p[1] for p in parts[:i])) for g, parts in split for i in range(len(parts))]  # two a border at most
    if not carried:
        return local.drop("part")
    carry = df.sparkSession.createDataFrame(carried, f"{group} long, part int, before long")
    return local.join(F.broadcast(carry), [group, "part"], "left").withColumn("total", F.col("total") + F.coalesce("before", F.lit(0))).drop("part", "before")


def trie(conversations: DataFrame, heads: Column | None = None) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node."""
    bounded_batches(conversations.sparkSession)
    keyed, groups = nodes_of(rebuilt(numbered(written(turns_of(conversations), "trie-read")), heads))
    up = ["parent_fp", "parent_tag_depth", "parent_tag_conv"]
    nodes = written(groups.groupBy(*KEY).agg(
        *[F.first(c).alias(c) for c in up], F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.max("chars").alias("chars"),
    ), "trie-nodes")
    of_parent = [(F.col("depth") - 1).alias("depth"), *[F.col(u).alias(k) for u, k in zip(up, KEY[1:], strict=True)]]
    children = nodes.filter("depth > 0").groupBy(*of_parent).agg(F.count("*").alias("n_children"))
    none = F.lit(0).cast("long")
    sized = nodes.join(children, KEY, "left").withColumns({
        "n_children": F.coalesce("n_children", none), "weight": (F.col("n_convs") - 1) * F.col("chars"),
    })
    # A node's owner is its least member; ``own`` is what the owner owns from the node down.
    sized = written(running(sized, "conv_id", F.col("depth"), "weight").withColumnRenamed("total", "own"), "trie-sized")
    owners = sized.groupBy("conv_id").agg(
        F.min("depth").alias("from"), F.sum("weight").alias("all"), (F.max_by("n_children", "depth") == 0).cast("long").alias("leaf")
    )
    owners = written(owners, "trie-owners")
    above = keyed.select(*KEY, "conv_id").join(owners, "conv_id").filter(F.col("depth") < F.col("from"))
    above = above.groupBy(*KEY).agg(F.sum("all").alias("below"), F.sum("leaf").alias("leaves"))
    full = sized.join(owners, "conv_id").join(above, KEY, "left").join(ends_digest(groups), KEY, "left").withColumns({
        "n_leaves": F.col("leaf") + F.coalesce("leaves", none), "saved_tokens": F.col("own") + F.coalesce("below", none),
        "ends_sha256": F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())),
    })
    full = written(full.select(*KEY, *up, "from", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"), "trie-full")
    # A conversation's owned nodes hang off each other; the first of them hangs off another's node.
    number = full.count()
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inner = full.withColumn("parent_conv_id", F.when((F.col("depth") > 0) & (F.col("depth") > F.col("from")), F.col("conv_id")))
    first = full.filter((F.col("depth") == F.col("from")) & (F.col("depth") > 0)).withColumn("up_depth", F.col("depth") - 1)
    link = ["up_depth", *up]
    parents = full.filter("n_children > 0").select(*[F.col(k).alias(c) for k, c in zip(KEY, link, strict=True)], F.col("conv_id").alias("parent_conv_id"), "n_children")
    is_hot = F.col("n_children") > max(HOT_LEAST, number // HOT_SHARE)
    hot, cool = parents.filter(is_hot).drop("n_children"), parents.filter(~is_hot).drop("n_children")
    met = first.join(F.broadcast(hot), link, "left")  # fewer than HOT_SHARE rows
    under = met.filter("parent_conv_id IS NOT NULL").select(*out).unionByName(met.filter("parent_conv_id IS NULL").drop("parent_conv_id").join(cool, link).select(*out))
    return inner.filter((F.col("depth") == 0) | F.col("parent_conv_id").isNotNull()).select(*out).unionByName(under)
