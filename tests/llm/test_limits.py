"""No caps and no clashes: short terms, shared headers, plans in blocks, recall, rule tables, hot URLs, and every stage on odd input."""

import random

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline
from quillon.llm import packing, quality, toxicity, url_filter, vectors

WORD = public_tokenizers.path("word_bpe_49k.json")


def words(r, n):
    return " ".join("".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(2, 4))) for _ in range(n))


def test_a_term_of_three_letters_and_a_shared_header(spark):
    r = random.Random(2)
    header = words(r, 60)
    data, labels = [], []
    for k in range(600):
        toxic = k % 3 == 0
        body = words(r, 25) + (" zok " if toxic else " ") + words(r, 5)
        data.append((k, header + " " + body))
        labels.append((k, int(toxic)))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    marked = spark.createDataFrame(labels, "doc_id long, toxic int")
    sample = toxicity.without_copies(docs.join(marked, "doc_id").select(F.col("doc_id").cast("string").alias("key"), "text", F.col("toxic") > 0).toDF("key", "text", "toxic"))
    assert sample.count() == 600  # a header that all share makes no copies of them
    model = toxicity.fit(docs, marked)
    assert ("zok", False) in {(t, stem) for t, stem, _ in model.lexicon}
    got = {x.doc_id: x.score >= 0.5 for x in toxicity.score(docs, model).collect()}
    assert got == {k: bool(t) for k, t in labels}


def test_near_copies_of_a_label_count_once(spark):
    r = random.Random(4)
    base = words(r, 80).split()
    near = [base[:k] + ["qqq"] + base[k + 1 :] for k in range(0, 80, 8)]
    rows = [(str(k), " ".join(w), True) for k, w in enumerate([base, base, *near])]
    rows += [("c", " ".join(base), False), ("d", words(r, 80), True), ("e", "", True), ("f", None, True), ("g", "two words", True), ("h", "two words", True), (None, None, True)]
    got = toxicity.without_copies(spark.createDataFrame(rows, "key string, text string, toxic boolean").repartition(3)).collect()
    assert sum(not x.toxic for x in got) == 1
    toxic = [x.text for x in got if x.toxic]
    assert toxic.count("two words") == 1 and sum(1 for t in toxic if not t) == 1
    assert sum(1 for t in toxic if t and len(t.split()) == 80) <= 3  # the copies' first, the other text, and rarely one that no band finds


def test_a_plan_in_blocks_is_the_plan(spark, monkeypatch):
    r = random.Random(6)
    docs = spark.createDataFrame([(k, words(r, r.randint(0, 900))) for k in range(300)], "doc_id long, text string").repartition(4)
    items = packing.written(packing.pieces(docs, WORD), "test-pieces")
    whole = sorted(map(tuple, packing.pack(items).collect()))
    monkeypatch.setattr(packing, "PLAN_ROWS", 7)
    assert sorted(map(tuple, packing.pack(items).collect())) == whole
    sequences = {}
    for *_, length, _, sequence, offset in whole:
        sequences.setdefault(sequence, []).append((offset, length))
    for placed in sequences.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= 2048


def test_the_program_ends_at_its_optimum_or_says_how_far_it_is():
    r = random.Random(8)
    for m in (1, 3, 20, 64):
        sizes = sorted(r.sample(range(130, 2048), m), reverse=True)
        counts = [r.randint(1, 40_000) for _ in sizes]
        found, gap = packing.configurations(sizes, counts, 2048)
        made = [sum(c[i] * n for c, n in found) for i in range(m)]
        assert all(a <= b for a, b in zip(made, counts, strict=True))
        assert all(sum(a * s for a, s in zip(c, sizes, strict=True)) <= 2048 for c, _ in found)
        used = sum(n for _, n in found)
        assert 0 <= gap < max(1.0, packing.GAP * (used + m) + 1)
        assert used + m >= sum(a * s for a, s in zip(counts, sizes, strict=True)) / 2048 - m


def test_another_kind_of_tokenizer_is_refused():
    with pytest.raises(ValueError, match="splits texts in another way"):
        packing.WordTokenizer(public_tokenizers.path("byte_bpe_50k.json"))


def test_recall_is_told(spark, monkeypatch):
    r = random.Random(1)
    base = [[r.gauss(0, 1) for _ in range(8)] for _ in range(40)]
    rows = [(k, [c + r.gauss(0, 0.02) for c in base[k % 40]]) for k in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out, report = vectors.near_duplicates_with_report(df)
    assert report.recall >= vectors.REQUIRED and report.built >= 1
    assert {x.recall for x in vectors.near_duplicates(df).collect()} == {report.recall}
    monkeypatch.setattr(vectors, "links", lambda nodes, *_: nodes.sparkSession.createDataFrame([], vectors.LINKS))
    out, report = vectors.near_duplicates_with_report(df)
    assert report == (1.0, 3, True) and out.filter("n_links > 0").count() == 400


URLS = "page_id long, url string, found string, row int, labels array<string>, copies int, hot boolean, host string, Verdict string, short string, `a.b` int"


def url_rows():
    urls = ["http://a.com/de/x", "http://example.org/es/1", "https://x.example.org/en/11", "http://b.net/", None, "no scheme", "http://", "http://A.COM/fr/", "http://a.com" + "/de" * 20_000]
    urls += ["http://hot.com/de/"] * 40 + ["http://cold.net/x"] * 40 + [None] * 40
    return [(k if k % 5 else None, u, "f", 1, ["l"], 2, True, "own", "own", "s", 3) for k, u in enumerate(urls)]


@pytest.mark.parametrize("broadcast,hot,as_table", [(100_000, 1_000, False), (0, 2, False), (0, 1_000, True), (100_000, 2, True)])
def test_urls_with_any_columns_rules_and_hot_keys(spark, monkeypatch, broadcast, hot, as_table):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", broadcast)
    monkeypatch.setattr(url_filter, "HOT_LEAST", hot)
    df = spark.createDataFrame(url_rows(), URLS).repartition(3)
    rules = spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string") if as_table else url_filter.RULES
    got = url_filter.judge_urls(df, rules)
    assert got.columns == ["page_id", "url", "found", "row", "labels", "copies", "hot", "short", "a.b", "host", "path", "rule", "verdict"]

    def verdict(url):
        if not url or "://" not in url:
            return "", "", None, "allow"
        rest = url.split("://", 1)[1]
        host, path = rest.partition("/")[0].lower(), "/" * ("/" in rest) + rest.partition("/")[2]
        fit = [(len(h + p), v, h + p) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(fit)[2], max(fit)[1]) if fit else (host, path, None, "allow")

    want = [(x[0], x[2], x[3], x[5], *verdict(x[1])) for x in url_rows()]
    assert sorted(map(str, (tuple(x) for x in got.select("page_id", "found", "row", "copies", "host", "path", "rule", "verdict").collect()))) == sorted(map(str, want))
    assert url_filter.judge_urls(df.limit(0), rules).collect() == []
    assert url_filter.judge_urls(df, []).filter("verdict <> 'allow' OR rule IS NOT NULL").count() == 0
    assert url_filter.judge_urls(df.select("url")).columns == ["url", "host", "path", "rule", "verdict"]


def test_quality_keeps_columns_of_any_name(spark):
    names = ["__words", "__stops", "__h1", "__all", "__text", "__n_lines", "a.b", "N_words"]
    df = spark.createDataFrame([("the cat and the dog " * 9, *range(8)), (None, *range(8))], ["text", *names])
    got = quality.quality(df)
    assert got.columns == ["text", *names[:-1], *quality.OWN]
    assert [tuple(x)[1:8] for x in got.collect()] == [tuple(range(7))] * 2
    assert quality.keep_good(df).columns == df.columns


# --- stages ---------------------------------------------------------------------------------------

STAGE = "doc_id long, text string, lang string, source string, n_chars long, `row` int, `set` int, node long, toxic int, score double, kept boolean, `__id` long, length long"


@pytest.fixture(scope="module")
def odd(spark):
    r = random.Random(11)
    clean = "the " + words(r, 40) + " and the " + words(r, 60)
    texts = [(1, clean), (1, clean), (2, clean), (None, clean), (None, None), (3, ""), (4, " \n "), (5, None), (6, "the end of it " + words(r, 30_000))]
    return [(i, t, None, None, None if t is None else len(t), 1, 1, 1, 1, 0.5, False, 1, 1) for i, t in texts]


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('stage')}"
    spark.createDataFrame([(k, 1, k % 2) for k in range(20, 60)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_each_stage_on_odd_rows_and_on_none(spark, odd, base, name, stage):
    df = spark.createDataFrame(odd, STAGE).repartition(3)
    none = stage(spark, df.limit(0), base)
    assert none.collect() == []
    got = stage(spark, df, base)
    rows = got.collect()
    if name == "best_fit_packing":
        assert sum(x.piece == 0 for x in rows) == len(odd)
        return
    assert got.columns == df.columns and none.columns == df.columns
    ids = sorted(str(x.doc_id) for x in rows)
    if name in ("toxicity", "suffix_array_dedup"):
        assert ids == sorted(str(x[0]) for x in odd)  # nothing is known of toxic words; cutting keeps the rows
    if name == "quality_rules":
        assert ids == sorted(["1", "1", "2", "None", "6"])
    if name == "jaccard_join":
        # Rows of one id, or of none, stay together: the row without text keeps the other one without id.
        assert ids == sorted(["1", "1", "3", "4", "5", "6", "None", "None"])
    by_id = {x.doc_id: x.text for x in rows}
    assert by_id[6] == odd[-1][1]
