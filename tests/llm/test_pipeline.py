"""The pipeline's stages keep the columns of documents and work on what the stage before kept."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")

from quillon.llm.common import written


def test_stages_take_effect(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n, columns = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "test")
        assert docs.columns == columns, name
        assert docs.count() <= n
        n = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}
    texts = [r.text for r in docs.collect() if r.text]
    starts = set()
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        b = (r.text or "").encode()
        assert len(r.text or "") == r.n_chars
        starts |= {b[p : p + 50] for p in range(len(b) - 49)}
    assert texts


def test_stages_equal_brute_force(spark):
    """Kept rows, texts and placements of each stage, from what the stage before really gave."""
    import re
    from collections import defaultdict

    import public_tokenizers
    from tokenizers import Tokenizer

    from quillon.llm import quality, toxicity

    sf_dir = "/root/testdata/sf0.001"
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    key = lambda df: sorted((r.doc_id, r.text or "") for r in df.collect())

    # Toxicity: the score of each text by itself, under the model of all labels.
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    scorer = toxicity.Scorer(model)
    want = [(i, t) for i, t in key(docs) if scorer.score(t) < 0.5]
    docs = written(stages["toxicity"](spark, docs, sf_dir), "test")
    assert key(docs) == want and want

    def good(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        places = defaultdict(list)
        for p in range(len(w) - 7):
            places[tuple(w[p : p + 8])].append(p)
        repeated = len({p + k for ps in places.values() if len(ps) > 1 for p in ps for k in range(8)})
        lines = [s for s in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
        return (
            len(w) >= 20 and 100 * repeated <= 30 * len(w) and 2 <= sum(map(len, w)) / len(w) <= 15
            and len(re.findall(r"[#*$%&|<>]", text)) <= 0.1 * len(w) and len(lines) - len(set(lines)) <= 0.3 * len(lines)
            and (len(w) < 100 or bool(set(w) & set(quality.STOP_WORDS)))
        )

    want = [(i, t) for i, t in want if good(t)]
    docs = written(stages["quality_rules"](spark, docs, sf_dir), "test")
    assert key(docs) == want and want

    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, t in want:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(fold))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    group = list(range(len(want)))
    for a in range(len(want)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                group = [group[b] if g == group[a] else g for g in group]
    least = {g: min(i for (i, _), h in zip(want, group) if h == g) for g in group}
    want = [(i, t) for (i, t), g in zip(want, group) if i == least[g]]
    docs = written(stages["jaccard_join"](spark, docs, sf_dir), "test")
    assert key(docs) == want and want

    seen, cut = {}, []
    for i, t in want:
        b = t.encode()
        for p in range(len(b) - 49):
            seen.setdefault(b[p : p + 50], i)  # ids ascend
    for i, t in want:
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if seen[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        cut.append((i, bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")))
    docs = written(stages["suffix_array_dedup"](spark, docs, sf_dir), "test")
    assert key(docs) == sorted(cut) and cut != want

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, sequences = [], defaultdict(list)
    for i, t in cut:
        n = len(library.encode(t, add_special_tokens=False).ids) + 1
        pieces += [(i, k, at, min(2048, n - at)) for k, at in enumerate(range(0, n, 2048))]
    packed = stages["best_fit_packing"](spark, docs, sf_dir).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length) for r in packed) == sorted(pieces)
    for r in packed:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
