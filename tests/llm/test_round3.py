"""Token counts, the prefix trie and vector codes against plain Python: edge cases, ties, collisions, skew and empty tables."""

import hashlib
import random
import zlib
from collections import defaultdict
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from quillon.llm import prefix_trie, token_counts, vector_codes

BYTE = public_tokenizers.path("byte_bpe_50k.json")


# --- token counts ---------------------------------------------------------------------------------


def texts(seed=3):
    r = random.Random(seed)
    odd = [" ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", " ", "　", "<|endoftext|>", "'s", "'LL", "é", "ß", "中", "🙂", "12", "²", "!?", "a", "Word", "..."]
    out = ["".join(r.choice(odd) for _ in range(r.randint(0, 40))) for _ in range(300)]
    out += [None, "", " ", "<|endoftext|>", "a <|endoftext|> b", "one  two", "one \n two", "x" * 5000, "ab " * 20_000, " \x1d!", "é é"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k if k % 7 else None, t, 1, "x") for k, t in enumerate(texts())]
    rows += [(5, "one two", 2, "y")] * 60
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, digest string").repartition(3).persist()


def library(path):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    return lambda t: len(model.encode(t or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("hot", [1_000, 3])
def test_token_counts_equal_the_library(docs, monkeypatch, hot):
    monkeypatch.setattr(token_counts, "HOT_LEAST", hot)
    count = library(BYTE)
    want = [(r.doc_id, len((r.text or "").encode()), count(r.text)) for r in docs.collect()]
    got = token_counts.count_tokens(docs, BYTE)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_token_counts_of_the_other_files(docs):
    word = public_tokenizers.path("word_bpe_49k.json")
    count = library(word)
    want = [(r.doc_id, count(r.text)) for r in docs.collect()]
    assert sorted(map(str, map(tuple, token_counts.count_tokens(docs, word).select("doc_id", "n_tokens").collect()))) == sorted(map(str, want))
    import sentencepiece

    piece = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=piece)
    want = [(r.doc_id, len(model.encode(r.text or ""))) for r in docs.collect()]
    assert sorted(map(str, map(tuple, token_counts.count_tokens(docs, piece).select("doc_id", "n_tokens").collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("most", [100_000, 0])
def test_only_distinct_misses_are_encoded_and_appended(spark, docs, tmp_path, monkeypatch, most):
    monkeypatch.setattr(token_counts, "BROADCAST_MISSES", most)
    cache = f"file://{tmp_path}/cache"
    some = docs.filter(F.coalesce(F.length("text"), F.lit(0)) % 2 == 0)
    token_counts.count_tokens(some, BYTE, cache).collect()
    name = token_counts.tokenizer_version(BYTE)
    lines = lambda: spark.read.parquet(f"{cache}/version={name}")
    first = lines().count()
    assert first == len({r.text or "" for r in some.collect()})
    # A stored count is believed; what is new is appended once; another tokenizer shares nothing.
    spark.createDataFrame([(hashlib.sha256(b"never encoded").digest(), 77)], token_counts.CACHE).write.mode("append").parquet(f"{cache}/version={name}")
    more = docs.unionByName(spark.createDataFrame([(9, "never encoded", 0, "")], docs.schema))
    got = {r.n_tokens for r in token_counts.count_tokens(more, BYTE, cache).filter("n_bytes = 13").collect()}
    assert 77 in got
    assert lines().count() == 1 + len({r.text or "" for r in docs.collect()})
    token_counts.count_tokens(more, BYTE, cache).collect()
    assert lines().count() == 1 + len({r.text or "" for r in docs.collect()})
    other = public_tokenizers.path("word_bpe_49k.json")
    assert token_counts.tokenizer_version(other) != name
    assert token_counts.stored(spark, cache, token_counts.tokenizer_version(other)).count() == 0


def test_token_counts_of_nothing(spark, docs):
    assert token_counts.count_tokens(docs.limit(0), BYTE).collect() == []


# --- prefix trie ----------------------------------------------------------------------------------

TALK = "conv_id long, turn long, role string, text string, depth long, part int, h0 long"


def talks(seed=5):
    """Many shared beginnings, copies, ties, nulls, a long conversation and ids of several families."""
    r = random.Random(seed)
    lines = ["hi", "", None, "näh 🙂", "x" * 300, "yes", "no"]
    rows = []
    ids = [0, 1, 2, 3, 99, 100, 101, 150, 199, 205, 207, 1000, 1003, 1013, 1099, -3, -100, -150, 7, 8, 9, 10]
    for c in ids:
        for t in range(r.choice([1, 1, 2, 5, 8])):
            rows.append((c, r.choice([t, None, 1, t]), r.choice(["user", "assistant", None]), r.choice(lines[:3] if t < 3 else lines)))
    for c in range(300, 340):  # copies of two conversations
        rows += [(c, k, "user", f"same {k * (c % 2)}") for k in range(4)]
    rows += [(1013, k, "user", r.choice("ab")) for k in range(400)]
    rows += [(11, 3, "user", "twice")] * 3 + [(None, 1, "user", "lost"), (None, None, None, None)]
    return [(*x, 4, 4, 4) for x in rows]


def brute_trie(rows):
    own = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [(x[2], x[3]) for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        donor = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = own.get(donor, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = sum(saved[q] for q in children[p]) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        ends = ",".join(str(c) for c in members[p] if len(built[c]) == len(p))
        out.append((members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("prime,bases,hot", [(prefix_trie.MODULUS, prefix_trie.BASES, 1_000), (7, (3, 5), 1), (2, (1, 1), 1_000)])
def test_trie_equals_brute_force(spark, monkeypatch, prime, bases, hot):
    """Small primes make nearly all candidates collide, so that groups have to be split again and again."""
    for name, value in (("MODULUS", prime), ("BASES", bases), ("HOT_LEAST", hot)):
        monkeypatch.setattr(prefix_trie, name, value)
    rows = talks() if prime > 100 else [x for x in talks() if x[0] != 1013]
    got = prefix_trie.trie(spark.createDataFrame(rows, TALK).repartition(3))
    assert sorted(map(str, map(tuple, got.collect()))) == brute_trie(rows)


def test_trie_with_small_batches_and_of_nothing(spark, monkeypatch):
    """Conversations, groups and ends that cross batches and tasks."""
    rows = talks()
    small = {"spark.sql.execution.arrow.maxRecordsPerBatch": "3", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        turns = prefix_trie.numbered(prefix_trie.turns_of(spark.createDataFrame(rows, TALK))).filter("conv_id = 1013")
        assert [r.pos for r in turns.orderBy("pos").collect()] == list(range(1, 1 + sum(x[0] == 1013 for x in rows)))
        got = prefix_trie.trie(spark.createDataFrame(rows, TALK).repartition(3))
        assert sorted(map(str, map(tuple, got.collect()))) == brute_trie(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert prefix_trie.trie(spark.createDataFrame([], TALK)).collect() == []
    one = [(6, 0, "user", "gone", 1, 1, 1)]  # rebuilt to nothing: a member of the root alone
    assert sorted(map(str, map(tuple, prefix_trie.trie(spark.createDataFrame(one, TALK)).collect()))) == brute_trie(one)


# --- vector codes ---------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, label int, codes string, x long, was string"


def vectors(n=260, d=32, seed=9):
    r = random.Random(seed)
    rows = [(k * 3 % 257, [r.gauss(0, 0.2) for _ in range(d)], r.choice([1, 2, None])) for k in range(n)]
    rows += [(1, None, 1), (2, [None] * d, 1), (3, [float("nan")] * d, 2), (4, [float("inf")] + [0.0] * (d - 1), None), (None, [0.5] * d, 1), (None, [0.25] * d, 1)]
    rows += [(5, [0.0] * d, 3), (5, [0.0] * d, 3), (6, [], 3), (7, [1.0, -1.0, 0.004], 4), (8, [2.0, -1.0, 0.004], 4), (9, [1e30] + [-70_000.0] * (d - 1), 5)]
    return [(*x, "a", 1, "b") for x in rows]


def brute_codes(rows, rounds=2):
    kept = defaultdict(list)
    for k, v, label, *_ in rows:
        if v is None or any(c is None or not np.isfinite(c) for c in v):
            continue
        x = [max(-(1 << 24), min(1 << 24, floor(256 * c) if abs(c) < 1e20 else int(c))) for c in v]
        kept[len(v)].append((k, label, x + [0] * (-len(x) % 16)))
    out, sums = [], defaultdict(int)
    for own in kept.values():
        own.sort(key=lambda t: (t[0] is None, t[0] or 0, t[2]))
        w = len(own[0][2]) // 16
        part = lambda x, p: x[p * w : p * w + w]  # noqa: B023, E731
        books = [[part(x, p) for _, _, x in own[:64]] for p in range(16)]

        def code(x, p):
            return min((sum((a - b) ** 2 for a, b in zip(part(x, p), e)), i) for i, e in enumerate(books[p]))  # noqa: B023

        for _ in range(rounds):
            for p in range(16):
                got = defaultdict(list)
                for _, _, x in own:
                    got[code(x, p)[1]].append(part(x, p))
                for i, parts in got.items():
                    books[p][i] = [sum(c) // len(parts) for c in zip(*parts)]
        sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
        for k, label, x in own:
            codes = [code(x, p) for p in range(16)]
            error = sum(c[0] for c in codes)
            sums[label] += error
            out.append([k, "".join(f"{c[1]:02x}" for c in codes), error, label, sha])
    return sorted(str((k, c, e, sums[label], sha)) for k, c, e, label, sha in out)


@pytest.mark.parametrize("rounds,labels", [(2, 100_000), (4, 1), (0, 100_000)])
def test_codes_equal_brute_force(spark, monkeypatch, rounds, labels):
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", labels)
    df = spark.createDataFrame(vectors(), VECTORS).repartition(3)
    got = vector_codes.compress(df, rounds=rounds)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == brute_codes(vectors(), rounds)


def test_a_later_round_moves_only_what_changed(spark):
    df = spark.createDataFrame(vectors(), VECTORS)
    rows = vector_codes.integers(df, "vec_id", "embedding", "label").persist()
    books = vector_codes.first_books(rows)
    first = vector_codes.assigned(rows.withColumn("codes", F.lit(b"")), books).persist()
    assert first.filter("moved").count() == first.count()
    again = vector_codes.assigned(first, books)
    assert again.filter("moved").count() == 0 and vector_codes.changes(again).count() == 0


def test_few_vectors_and_none(spark):
    few = vectors()[:5]
    assert sorted(map(str, map(tuple, vector_codes.compress(spark.createDataFrame(few, VECTORS)).collect()))) == brute_codes(few)
    assert vector_codes.compress(spark.createDataFrame([], VECTORS)).collect() == []
    assert vector_codes.compress(spark.createDataFrame([(1, None, 1, "", 1, "")], VECTORS)).collect() == []


# --- registered queries over whole tables ---------------------------------------------------------


def test_registered_queries_equal_brute_force(spark):
    from quillon.llm import queries

    base = "/root/testdata/sf0.001"
    talk = [tuple(r) for r in spark.read.parquet(f"{base}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(str, map(tuple, queries.op12_prefix_trie(spark, base).collect()))) == brute_trie(talk)
    rows = [tuple(r) for r in spark.read.parquet(f"{base}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted(map(str, map(tuple, queries.op13_vector_codes(spark, base).collect()))) == brute_codes(rows)
    count = library(BYTE)
    want = [(r.doc_id, len((r.text or "").encode()), count(r.text), count(r.text) > 512) for r in spark.read.parquet(f"{base}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op11_token_counts(spark, base).collect())) == sorted(want)
