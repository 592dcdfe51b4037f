"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from quillon.llm import bpe, chat, jaccard, packing, quality, substrings, toxicity, url_filter, vectors, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, band long, kept boolean, rank long, part string"


def rows(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["th", "e", "an", "Or", "in", "é", "st"]) for _ in range(r.randint(1, 4)))
    base = [word() for _ in range(200)]
    passage = " ".join(word() for _ in range(60))
    out = [(1, ""), (2, None), (3, " \n\t "), (4, "one two"), (5, "ONE Two"), (None, "one two"), (None, None), (6, "x" * 60), (7, "x" * 61)]
    out += [(10, " ".join(base)), (10, " ".join(base)), (11, " ".join(base))]
    for k in range(12, 40):
        words = base[:]
        for _ in range(r.randint(0, 9)):
            words[r.randrange(len(words))] = word()
        out.append((k, " ".join(words)))
    for k in range(40, 60):
        out.append((k, " ".join(word() for _ in range(r.randint(1, 80))) + "\n" + passage + " " + word()))
    out.append((60, " ".join(word() for _ in range(40_000))))
    out.append((61, "ab " * 5000))
    return [(i, t, "en", "s", None if t is None else len(t), 7, 7, True, 1, "p") for i, t in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_set(text):
    table = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(table))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_jaccard_equals_brute_force(docs, none):
    data = docs.select("doc_id", "text").collect()
    sets = [shingle_set(r.text) for r in data]
    parent = list(range(len(data)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(data)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for k in range(len(data)):
        groups[find(k)].append(k)
    want = []
    for members in groups.values():
        ids = [data[k].doc_id for k in members if data[k].doc_id is not None]
        want += [(data[k].doc_id, len(sets[k]), min(ids, default=None) if sets[k] else data[k].doc_id) for k in members]
    got = [tuple(r) for r in jaccard.similar(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert jaccard.similar(none).collect() == []


def test_jaccard_on_the_other_side_of_each_switch(docs, none, monkeypatch):
    for name, value in (("LONG_LIST", 2), ("PART", 5), ("RUN", 3), ("BLOCK", 3), ("ASKED_MOST", 0), ("CLASSES_MOST", 0), ("FREQUENT", 2), ("BANDS", 1), ("MANY", 2)):
        monkeypatch.setattr(jaccard, name, value)
    test_jaccard_equals_brute_force(docs, none)


def test_blocks_of_a_list_lose_no_pair(monkeypatch):
    import numpy as np

    monkeypatch.setattr(jaccard, "RUN", 7)
    rng = np.random.default_rng(2)
    n = rng.integers(5, 60, 600)
    place = (rng.random(600) * jaccard.prefix_length(n)).astype(np.int64)
    lists, apart, node = rng.integers(0, 6, 600), rng.integers(0, 5, 600), rng.permutation(600)
    order = np.lexsort((place, n, lists))
    n, place, lists, apart, node = (x[order] for x in (n, place, lists, apart, node))
    i, j = jaccard._list_pairs(lists, node, n, place, apart)
    need = lambda a, b: -(-80 * (n[a] + n[b]) // 180)
    want = {
        (a, b) for b in range(600) for a in range(b)
        if lists[a] == lists[b] and apart[a] != apart[b] and min(n[a] - place[a], n[b] - place[b]) >= need(a, b) and 100 * n[a] >= 80 * n[b]
    }
    got = list(zip(i.tolist(), j.tolist()))
    assert len(got) == len(set(got)) and {(min(p), max(p)) for p in got} == want


def test_answers_are_derived_from_leaders(spark):
    """Two groups of near copies that share a common passage: their leaders' answer spares all other pairs."""
    r = random.Random(3)
    some = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    shared, groups = some(40), []
    for _ in range(2):
        base = some(60)
        groups += [" ".join(shared + base[:k] + some(1) + base[k + 1 :]) for k in range(0, 60, 6)]
    sets = [shingle_set(t) for t in groups]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    import numpy as np

    own = list(jaccard.shingle_sets([t.encode() for t in groups], 5))
    stored = frame([(k, s.tobytes()) for k, s in enumerate(own)], "node long, shingles binary")
    stars = jaccard.compared(stored, frame([(g, g + k) for g in (0, 10) for k in range(1, 10)], "a long, b long"))
    leaders = jaccard.leaders_of(stars)
    assert {(x.node, x.leader) for x in leaders.collect()} == {(g + k, g) for g in (0, 10) for k in range(1, 10)}
    pairs = frame([(a, b, len(sets[a]), len(sets[b])) for a in range(10) for b in range(10, 20)], "a long, b long, n long, m long")
    asked = []
    whole = jaccard.compared
    jaccard.compared, keep = (lambda s, p: (asked.append(p.count()), whole(s, p))[1]), whole
    try:
        assert jaccard.answers(stored, pairs, leaders).collect() == []
    finally:
        jaccard.compared = keep
    assert asked == [1, 0] and np.all([len(a & b) * 100 < 80 * len(a | b) for a in sets[:10] for b in sets[10:]])


def test_substrings_equal_brute_force(docs, none):
    data = docs.select("doc_id", "text").collect()
    inf = 1 << 62
    least = {}
    for r in data:
        b = (r.text or "").encode()
        i = inf if r.doc_id is None else r.doc_id
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            least[w] = min(least.get(w, inf), i)
    want = []
    for r in data:
        b, i = (r.text or "").encode(), inf if r.doc_id is None else r.doc_id
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if least[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want.append((r.doc_id, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    got = [tuple(r) for r in substrings.digests(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert substrings.digests(none).collect() == []
    cut = substrings.without_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == len(data)


def test_substrings_beyond_the_broadcast(docs, monkeypatch):
    near = sorted(str(tuple(r)) for r in substrings.digests(docs).collect())
    monkeypatch.setattr(substrings, "SENT_MOST", 0)
    test_substrings_equal_brute_force(docs, docs.limit(0))
    assert sorted(str(tuple(r)) for r in substrings.digests(docs).collect()) == near


def test_substrings_by_a_filter_move_no_text(docs, monkeypatch):
    near = sorted(str(tuple(r)) for r in substrings.digests(docs).collect())
    for name, value in (("SENT_MOST", 0), ("FILTERED_MOST", 40), ("FILTER_BITS", 1 << 5), ("HOT", 2)):  # several passes and blocks, many false hits
        monkeypatch.setattr(substrings, name, value)
    assert sorted(str(tuple(r)) for r in substrings.digests(docs).collect()) == near
    rows = docs.withColumn("digest", F.sha1(F.coalesce("text", F.lit("")).cast("binary"))).localCheckpoint()
    found = substrings.contexts(rows, "doc_id", "text", "digest", substrings.repeated_anchors(rows, "text", 8).localCheckpoint(), 8)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_substrings_of_frequent_anchors(docs, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", 2)  # all anchors are dealt out by the bytes beside them
    monkeypatch.setattr(substrings, "FLUSH_FOUND", 150)  # many lots
    test_substrings_equal_brute_force(docs, docs.limit(0))


def test_multikey_orders_groups_and_words():
    import numpy as np

    rng = np.random.default_rng(5)
    for n, values in ((0, 2), (1, 2), (50, 2), (3000, 4), (3000, 1 << 40)):
        group, words = rng.integers(0, 7, n), rng.integers(0, values, (n, 3)).astype(np.uint64)
        order = substrings.multikey(group, words)
        keys = [(int(group[i]), *words[i].tolist()) for i in order]
        assert sorted(order.tolist()) == list(range(n)) and keys == sorted(keys)


def test_stages_keep_clashing_columns(spark):
    names = ["doc_id", "text", "n_chars", "n_words", "kept", "__own", "__copy", "__row", "c0", "__text", "__all", "__id", "__component"]
    text = " ".join(f"the word {k} stays" for k in range(30))
    data = [(k, t, 7, 111, False, "o", "c", "r", "z", "x", "y", "i", "p") for k, t in ((1, text), (2, text + " more"), (None, text), (3, None), (4, ""))]
    df = spark.createDataFrame(data, "doc_id long, text string, n_chars long, n_words int, kept boolean, " + ", ".join(f"`{n}` string" for n in names[5:]))
    good = quality.keep_good(df)
    assert good.columns == names and sorted(map(str, good.collect())) == sorted(str(r) for r in df.collect() if r.text)
    cut = substrings.without_repeats(df)
    assert cut.columns == names and {(r.doc_id, r.n_chars) for r in cut.collect()} == {(1, len(text)), (2, 5), (None, 0), (3, None), (4, 0)}
    assert all(r[3:] == data[0][3:] for r in cut.collect())


def test_substrings_of_shared_and_missing_ids(spark):
    r = random.Random(8)
    some = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    p, q = some(80), some(120)
    texts = [(1, some(30) + p), (6, q + some(90)), (6, some(200) + p + some(10)), (6, some(300)), (7, some(20) + q), (None, some(15) + p + some(40) + q), (None, q + some(25)), (None, some(60)), (None, None)]
    texts += [(None, texts[4][1]), (1 << 60, some(9) + p), ((1 << 60) + 1, some(70) + q)]
    docs = spark.createDataFrame([(i, t, None if t is None else len(t)) for i, t in texts], "doc_id long, text string, n_chars long").coalesce(1)
    test_substrings_equal_brute_force(docs, docs.limit(0))


def test_deep_shallow_sorts_rows():
    import numpy as np

    rng = np.random.default_rng(3)
    strings = np.repeat(rng.integers(97, 99, (40, 50)).astype(np.uint8), 3, axis=0)
    strings[:, :30] = strings[0, :30]
    group = rng.integers(0, 2, len(strings))
    order, classes = substrings.deep_shallow(group, strings)
    keys = [(int(group[i]), strings[i].tobytes()) for i in order]
    assert keys == sorted(keys)
    assert all((keys[k] == keys[k - 1]) == (classes[k] == classes[k - 1]) for k in range(1, len(keys)))


def test_bpe_round_trip_and_library(docs, none):
    tiktoken = pytest.importorskip("tiktoken")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    codec = bpe.codec(path, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    r = random.Random(5)
    for _ in range(1500):
        s = "".join(r.choice(["a", "É", "'s", " ", "  ", "\n", "1", "٣", "!", "the", "ß", "\x1c", "\x85", "日本", "́", "_", "\U0001f600", "\0"]) for _ in range(r.randint(0, 30)))
        ids = codec.encode(s)
        assert ids == library.encode_ordinary(s), repr(s)
        assert codec.decode(ids) == s.encode()
    data = {(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()}
    got = bpe.digests(docs, path, public_tokenizers.PATTERN).collect()
    want = []
    for x in docs.select("doc_id", "text").collect():
        ids = library.encode_ordinary(x.text or "")
        want.append((x.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((x.text or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and data
    assert bpe.digests(none, path, public_tokenizers.PATTERN).collect() == []
    back = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN).collect()
    assert sorted(str((x.doc_id, bytes(x.bytes))) for x in back) == sorted(str((x.doc_id, (x.text or "").encode())) for x in docs.collect())


def test_perfect_hash_is_minimal():
    keys = [b"%d" % k for k in range(5000)]
    h = bpe.PerfectHash(keys)
    assert sorted(map(h.index, keys)) == list(range(5000))


def test_packing_places_every_piece(docs, none):
    import zlib

    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path, with_ids=True).collect()
    want = []
    for x in docs.select("doc_id", "text").collect():
        ids = [*library.encode(x.text or "", add_special_tokens=False).ids, 0]
        for n, at in enumerate(range(0, len(ids), 2048)):
            raw = b"".join(k.to_bytes(4, "little") for k in ids[at : at + 2048])
            want.append((x.doc_id, n, at, len(raw) // 4, zlib.crc32(raw)))
    assert sorted(str((g.doc_id, g.piece, g.start, g.length, g.ids_crc32)) for g in got) == sorted(map(str, want))
    by = defaultdict(list)
    for g in got:
        by[g.sequence_id].append((g.offset, g.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(none, path).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_near_the_bound(seed):
    r = random.Random(seed)
    sizes = [min(2047, int(r.expovariate(1 / 700)) + 1) for _ in range(5000)]
    histogram = {s: sizes.count(s) for s in set(sizes)}
    plan = packing.Plan(histogram)
    placed = defaultdict(int)
    for s, lo, hi, _, _ in plan.rows:
        placed[s] += hi - lo
    assert dict(placed) == histogram
    assert plan.sequences <= 1.03 * -(-sum(sizes) // 2048) + 1


def test_quality_cases(docs, none):
    got = quality.quality(docs)
    assert got.count() == docs.count() and quality.quality(none).collect() == []
    for x in got.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", x.text or "")
        win = defaultdict(list)
        for p in range(len(w) - 7):
            win[tuple(w[p : p + 8])].append(p)
        covered = {p + k for ps in win.values() if len(ps) > 1 for p in ps for k in range(8)}
        lines = [s for s in (x.text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
        assert (x.n_words, x.word_chars, x.n_repeat_words, x.n_dup_lines) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert x.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))


def test_url_cases(spark):
    urls = [None, "", "no scheme", "http://EXAMPLE.org/en/12?x#y", "https://a.b.example.org/es/", "http://example.org", "ftp://x.com/fr/", "http://com/de/x", "http://xcom/de/", "://ORG/", "http:///p", "http://é.org/#", "http://org?/"]
    df = spark.createDataFrame([(k, u, "h", "r") for k, u in enumerate(urls)] + [(None, urls[3], "h", "r")] * 2, "page_id long, url string, host string, rule string")
    got = url_filter.judge_urls(df)
    by = {r.url: (r.host, r.path, r.rule, r.verdict) for r in got.collect()}
    assert got.count() == len(urls) + 2
    assert by[None] == by[""] == by["no scheme"] == ("", "", None, "allow")
    assert by["http://EXAMPLE.org/en/12?x#y"] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert by["https://a.b.example.org/es/"][2:] == ("example.org/es/", "block")
    assert by["http://example.org"] == ("example.org", "", None, "allow")
    assert by["ftp://x.com/fr/"][2:] == ("com/fr/", "allow") and by["http://com/de/x"][2:] == ("com/de/", "block")
    assert by["http://xcom/de/"][2] is None and by["://ORG/"][2] == "org/" and by["http:///p"][:2] == ("", "/p") and by["http://org?/"][1] == ""
    assert url_filter.judge_urls(df.limit(0)).collect() == []
    assert url_filter.judge_urls(df, rules=[]).filter("verdict = 'block'").count() == 0


def test_warc_rejects_forged_records(spark):
    forged = "WARC/1.1\r\nWARC-Type: response\r\nX-Page-Id: 99\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = [
        (1, "http://a\r\nX: y", forged), (2, None, None), (3, "u", ""), (4, "u", "WARC/1.1\r\n"), (5, "u", "é" * 5000), (6, "u", "é" * 5000), (6, "u", "é" * 5000),
        (None, "u", "z"), (7, "u", "a" * 50_000 + forged * 300 + "WARC/1.1"), (8, "u", forged),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # payloads and chains cross splits
    try:
        got = warc.read_archive(spark, warc.write_archive(df)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    digest = lambda s: warc.base32_of((s or "").encode())
    keep = {1: 8, 2: 3, 5: 6}
    want = [(i, len((h or "").encode()), digest(h), "revisit" if i in keep else "response", keep.get(i)) for i, _, h in pages]
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == sorted(map(str, want))
    assert all(r.verified for r in got)
    assert warc.read_archive(spark, warc.write_archive(df.limit(0))).collect() == []


def test_warc_keeps_records_around_a_long_url(spark):
    urls = ["u", "http://a/" + "b" * 200_000, None, "http://c: d/" + "é" * 70_000, "v"]
    df = spark.createDataFrame([(k, u, f"page {k}") for k, u in enumerate(urls)], "page_id long, url string, html string").coalesce(1)
    got = warc.read_archive(spark, warc.write_archive(df)).collect()
    assert sorted((r.page_id, r.payload_bytes, r.verified) for r in got) == [(k, 6, True) for k in range(5)]


def test_warc_revisits_must_match_what_they_name(spark, tmp_path):
    a, b = warc.base32_of(b"a"), warc.base32_of(b"b")

    def record(page, declared, body, size=1, named=None):
        more = "" if named is None else f"\r\nX-Refers-To-Page: {named}"
        return (
            f"WARC/1.1\r\nWARC-Type: {'response' if named is None else 'revisit'}\r\nWARC-Payload-Digest: sha1:{declared}\r\nX-Payload-Length: {size}"
            f"\r\nX-Page-Id: {page}{more}\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n"
        )

    rows = [
        record(1, a, "a"), record(2, a, "", named=1), record(3, b, "", named=1), record(4, a, "", size=2, named=1),
        record(5, a, "", named=9), record(6, a, "b"), record(7, a, "", named=6), record(8, a, "", named=2), record(9, b, "b"), record(10, b, "", named=9),
    ]
    (tmp_path / "x.warc").write_bytes("".join(rows).encode())
    got = warc.read_archive(spark, str(tmp_path)).collect()
    assert {r.page_id: r.verified for r in got} == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False, 7: False, 8: False, 9: True, 10: True}


def test_chat_round_trip(spark):
    r = random.Random(2)
    bits = ["\\", "<", "#", "### ", "</turn>", "\n", "User: ", "### User: ", "a", " ", "\\<", "\\\\", ": "]
    for _ in range(3000):
        role, text = r.choice(["user", "assistant", "=x", "a:b\\", "", "### "]), "".join(r.choice(bits) for _ in range(r.randint(0, 12)))
        assert chat.parse(chat.render_turn(role, text) * 2) == [(role, text)] * 2
    turns = [(1, 1, "assistant", "x</turn>"), (1, 0, "user", None), (1, 0, "user", None), (None, 3, None, "q"), (2, None, "assistant", "\\"), (2, 5, "assistant", "b")]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, seq int")
    got = {x.conv_id: x for x in chat.read_back(chat.format_turns(df)).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 8 and got[1].turns_sha256 == hashlib.sha256(b"user\n\nuser\n\nassistant\nx</turn>\n").hexdigest()
    assert got[2].loss_sha256 == hashlib.sha256(b"\\b").hexdigest() and got[None].n_turns == 1
    assert chat.read_back(chat.format_turns(df.limit(0))).collect() == []


def test_vectors_equal_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 16))
    x[200:] = x[:100] + rng.normal(size=(100, 16)) * 0.05
    x[290:] = x[289]
    x[100:150] = x[100] + rng.normal(size=(50, 16)) * 0.01
    data = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    odd = [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [float("nan")] * 16, 1), (904, [None] + [1.0] * 15, 1), (905, [1.0] * 3, 1), (906, [1e308] * 16, 1), (907, [5.0] * 16, 1)]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>, node int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    parent = list(range(300))
    for a, b in zip(*np.nonzero(near)):
        m, n = a, b
        while parent[m] != m:
            m = parent[m]
        while parent[n] != n:
            n = parent[n]
        parent[max(m, n)] = min(m, n)
    found = sum(got[k][0] for k in range(300))
    assert found >= 0.97 * near.sum() and all(got[k][0] <= near[k].sum() for k in range(300))
    for k in range(300):
        m = k
        while parent[m] != m:
            m = parent[m]
        assert got[k][1] == m
    assert all(got[k] == (0, k, True) for k in range(900, 906)) and got[906][0] == got[907][0] == 1 and got[907][1] == 906
    assert vectors.near_duplicates(df.limit(0)).collect() == []


def test_vectors_without_a_working_index(spark, monkeypatch):
    monkeypatch.setattr(vectors, "links", lambda nodes, *_: nodes.sparkSession.createDataFrame([], "a long, b long, n long, kind long"))
    if hasattr(vectors, "BLOCK"):
        monkeypatch.setattr(vectors, "BLOCK", 70)  # groups cross blocks
    test_vectors_equal_brute_force(spark)


def test_an_audit_draws_until_nodes_have_links(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 16))
    x[1] = x[0] + rng.normal(size=16) * 0.01
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    nodes = vectors.nodes_of(df, "vec_id", "embedding").select("node", F.lit(1).cast("long").alias("weight"), "unit")
    monkeypatch.setattr(vectors, "AUDITED", 2)
    assert vectors.audit(nodes, spark.createDataFrame([], "node long, linked long")) == 0


@pytest.fixture()
def small_pieces(monkeypatch):
    for name, value in (("SHARD", 8), ("PIECE", 6), ("ASKING", 2), ("SUBSAMPLE", 16), ("SUBPIVOTS", 4)):
        monkeypatch.setattr(vectors, name, value)


def test_vectors_in_many_leaves_and_pieces(spark, small_pieces):
    test_vectors_equal_brute_force(spark)


def test_links_are_counted_not_written(spark, small_pieces):
    import numpy as np

    rng = np.random.default_rng(7)
    x = rng.normal(size=16) + rng.normal(size=(400, 16)) * 0.01
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    nodes = vectors.nodes_of(df, "vec_id", "embedding").select("node", F.lit(1).cast("long").alias("weight"), "unit")
    found = vectors.links(nodes, vectors.pivots_of(nodes, 3), 3, 24)
    pieces = 400 / vectors.PIECE
    assert found.count() <= 400 * 3 * (pieces / vectors.ASKING + pieces)  # each node, in each task that holds it
    got = vectors.near_duplicates(df).collect()
    assert sum(r.n_links for r in got) >= 0.97 * 400 * 399 and all(r.n_links <= 399 and r.component_id == 0 for r in got)


def test_vectors_of_one_length_are_compared(spark):
    data = [(1, [1.0] * 8), (2, [1.0] * 7 + [1.1]), (3, [1.0, 2.0]), (4, [1.0, 2.01]), (5, [1.0, -2.0]), (6, [3.0] * 8), (7, [1.0, 2.0, 0.0]), (8, [2.0, 4.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 6: (2, 1), 3: (2, 3), 4: (2, 3), 8: (2, 3), 5: (0, 5), 7: (0, 7)}


def test_toxicity_finds_misspelt_and_spares_quoted(spark, none):
    r = random.Random(9)
    plain = ["tree", "house", "water", "stone", "river", "cloud", "paper", "light", "north", "green"]
    texts, labels = [], []
    for k in range(600):
        words = [r.choice(plain) for _ in range(30)] + [f"{r.choice(plain)}{k}"]
        bad = k % 4 == 0
        if bad:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["grumblatz", "snorfblat", "wuzzlekin"]))
        texts.append((k, " ".join(words), 5))
        labels.append((k, 1, int(bad)))
    docs = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {t for t, _, _ in model.lexicon} >= {"grumblatz", "snorfblat", "wuzzlekin"}
    got = {x.doc_id: x.score for x in toxicity.score(docs, model).collect()}
    assert all((got[k] >= 0.5) == (k % 4 == 0) for k in range(600))
    scorer = toxicity.Scorer(model)
    used = scorer.features("you grumblatz and snorfblat")[0]
    assert scorer.features("you grumblotz and snrofblat")[0] > 0
    assert scorer.features('he wrote "grumblatz" and "snorfblat" today')[0] < used
    assert toxicity.Matcher([("stupid", False, 1.0)]).match("stuipd") == (1.0, 1)
    assert 0 <= scorer.score("") < 0.5
    blank = toxicity.fit(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert [x.score for x in toxicity.score(docs.limit(2), blank).collect()] == [0.0, 0.0]
    assert toxicity.score(none, model).collect() == []


def edit_distance(a, b):
    """Insertions, deletions, substitutions and swaps of neighbours, no letter touched twice."""
    rows = [list(range(len(b) + 1))]
    for i in range(1, len(a) + 1):
        rows.append([i] + [0] * len(b))
        for j in range(1, len(b) + 1):
            rows[i][j] = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                rows[i][j] = min(rows[i][j], rows[i - 2][j - 2] + 1)
    return rows[-1][-1]


def test_the_automaton_equals_plain_edit_distance():
    r = random.Random(12)
    word = lambda lo, hi: "".join(r.choice("abcd") for _ in range(r.randint(lo, hi)))
    terms = sorted({word(4, 11) for _ in range(25)})
    lexicon = [(t, False, 1.0) for t in terms]
    matcher = toxicity.Matcher(lexicon)
    stems = toxicity.Matcher([(t, True, 1.0) for t in terms if len(t) <= 8])
    hits = 0
    for k in range(1500):
        w = list(r.choice(terms) if k % 2 else word(1, 13))
        for _ in range(r.randint(0, 3)):
            p = r.randrange(len(w) + 1)
            w[p : p + r.randint(0, 2)] = r.choices("abcd", k=r.randint(0, 2))
        w = "".join(w)
        near = [e for t in terms if (e := edit_distance(w, t)) <= toxicity.errors_allowed(t, False)]
        hit = matcher.match(w)
        assert (hit[1] if hit else None) == min(near, default=None), w
        hits += bool(near)
        near = [e for t in terms if len(t) <= 8 for n in range(len(w) + 1) if (e := edit_distance(w[:n], t)) <= toxicity.errors_allowed(t, True)]
        hit = stems.match(w)
        assert (hit[1] if hit else None) == min(near, default=None), w
    assert hits > 400


def test_short_labelled_texts_are_learnt(spark):
    texts = [(k, ["grumblatz", "snorfblat you", "tree", "house here", "water", "stone"][k % 6] if k % 6 < 2 else f"{['tree', 'house', 'water', 'stone'][k % 4]} n{k}") for k in range(600)]
    docs = spark.createDataFrame(texts + [(9000, None), (9001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 6 < 2)) for k in range(600)] + [(9000, 0), (9001, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert model.weights is not None  # both labels are in the sample, however short its texts


def test_a_score_is_that_of_its_direct_features(docs):
    """Hits found by plain edit distance, then the same sums: whole texts, without the automaton or its memo."""
    import math

    model = toxicity.Model([("grumblatz", False, 3.0), ("snorf", True, 2.0)], frozenset(["grumblate"]), [-2.0, 1.0, -0.5, 0.3, 0.2], 0.1)
    scorer = toxicity.Scorer(model)
    texts = ["", "a tree", "grumblatz you snorfing", "grumblate here", "grumbltaz grumblaz", "x " * 300 + "grumblatz " * 3 + "y " * 50, "snorfle"]
    for text in texts:
        places, used, words = [], 0.0, text.split()
        for i, w in enumerate(words):
            found = [(edit_distance(w, "grumblatz"), -3.0)] if edit_distance(w, "grumblatz") <= 2 and w not in model.exceptions else []
            found += [(edit_distance(w[:n], "snorf"), -2.0) for n in range(len(w) + 1) if edit_distance(w[:n], "snorf") <= toxicity.errors_allowed("snorf", True)]
            if found:
                e, weight = min(found)
                used += -weight / (1 + 2 * e)
                places.append(i)
        cluster = max((sum(0 <= q - p < 20 for q in places) for p in places), default=0)
        want = [math.log1p(used), 0.0, math.log1p(100 * len(places) / len(words)) if places else 0.0, math.log1p(cluster)]
        assert scorer.features(text) == pytest.approx(want), text
        z = -2.0 + sum(a * b for a, b in zip(model.weights[1:], want))
        assert scorer.score(text) == pytest.approx(1 / (1 + math.exp(-z)))


def test_chat_query_equals_a_plain_reading(spark):
    """op8 over the whole small table, with its own conversation: digests made from the rows, without the template."""
    from quillon.llm import queries

    sf_dir = "/root/testdata/sf0.001"
    turns = [(x.conv_id, x.turn, x.role or "", x.text or "") for x in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    turns += [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]
    want = defaultdict(lambda: [0, "", ""])
    for conv, _, role, text in sorted(turns):
        own = want[conv]
        own[0], own[1], own[2] = own[0] + 1, own[1] + f"{role}\n{text}\n", own[2] + (text if role == "assistant" else "")
    hexed = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {(x.conv_id, x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) for x in queries.op8_chat_format(spark, sf_dir).collect()}
    assert got == {(c, n, hexed(t), len(m), hexed(m)) for c, (n, t, m) in want.items()}
