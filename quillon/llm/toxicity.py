"""Toxicity: Levenshtein automata intersected with a lexicon trie, scored in context.

The lexicon is learnt: words and word beginnings that labelled toxic documents hold far more often than
labelled clean ones, by a likelihood-ratio test. Its trie is intersected with the Levenshtein automaton (with
transpositions) by determinising pairs of trie node and errors, lazily, so that a word costs one table
step a character. Each hit weighs by its term's log odds and its errors; a window of words and
quotation marks around it decides if it is quoted or reported rather than used. A logistic
model on sums of used and quoted hits, their density and their clustering gives the score.

Labels are read from a bounded sample: at most ``MAX_TOXIC`` toxic and ``MAX_CLEAN`` clean labelled rows, those
of the smallest key hashes. Of near copies in the sample, texts of one label whose sets of three-word shingles are alike by ``ALIKE``
or more, one counts, else their chance words would pass for terms; texts that merely share passages all count. Words of any
length may be terms; those under five letters match as they are written only. All documents are scored whole. Neither labels nor
any column but the text is an input of a score.

Defined cases: a null or empty text has no hits and gets the model's score of none; without labels of
both kinds every score is 0; repeated rows and null ids are scored each; an empty table gives an empty
result; columns other than the key and the text are not passed on, so no names can clash.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tasks, words_of, written

MAX_TOXIC, MAX_CLEAN = 4_000, 16_000
#: Least similarity of shingle sets of near copies in the sample, and hashes in bands that find them.
ALIKE, BANDS, BAND = 0.8, 4, 2
#: Least likelihood ratio (G squared) and log odds of a term.
LEAST_RATIO, LEAST_ODDS = 24.0, 2.5
STEMS = range(4, 9)
#: Words on each side of a hit that its context window holds.
CONTEXT = 6
QUOTED_WEIGHT = 0.25
MEMO = 200_000

#: Marks that open or close a quotation, and verbs of reporting.
QUOTES = "\"“”„«»‹›"
REPORTING = frozenset(["said", "says", "quoted", "quote", "quotes", "reported", "wrote", "cited", "word", "term", "slur", "insult"])

_STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + QUOTES + "¡¿…‘’–—"
_PARTS = re.compile(r"[^\W_]+").findall


def errors_allowed(term: str, stem: bool) -> int:
    """Short terms must match exactly; a stem one letter more than a word."""
    n = len(term) - stem
    return 0 if n < 5 else 1 if n < 8 else 2


class Matcher:
    """The product of the lexicon's trie and the Levenshtein automaton, determinised as words need it.

    A state is a set of (trie node, errors so far, letter owed by a transposition).
    """

    def __init__(self, lexicon: list[tuple[str, bool, float]]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.words: dict[int, tuple[float, int]] = {}
        self.stems: dict[int, tuple[float, int]] = {}
        self.slack = [0]
        for term, stem, weight in lexicon:
            node, allowed = 0, errors_allowed(term, stem)
            for c in term:
                self.slack[node] = max(self.slack[node], allowed)
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.slack.append(0)
                node = self.children[node][c]
            self.slack[node] = max(self.slack[node], allowed)
            (self.stems if stem else self.words)[node] = (weight, allowed)
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.ends: list[tuple[float, int] | None] = []  # the best whole word that ends here
        self.begins: list[tuple[float, int] | None] = []  # the best stem completed here
        self.dead = self._state(set())
        self.start = self._state({(0, 0, "")})

    def _state(self, pairs: set) -> int:
        todo, closed = list(pairs), set()
        while todo:  # letters missing from the word
            node, e, owed = pair = todo.pop()
            if pair in closed or e > self.slack[node]:
                continue
            closed.add(pair)
            if not owed:
                todo += [(child, e + 1, "") for child in self.children[node].values()]
        least: dict = {}
        for node, e, owed in closed:
            least[node, owed] = min(e, least.get((node, owed), 9))
        key = frozenset((node, e, owed) for (node, owed), e in least.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})

            def best(of: dict) -> tuple[float, int] | None:
                found = [(e, -of[n][0]) for n, e, owed in key if not owed and n in of and e <= of[n][1]]
                return (-min(found)[1], min(found)[0]) if found else None

            self.ends.append(best(self.words))
            self.begins.append(best(self.stems))
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, e, owed in self.sets[state]:
            if owed:
                if c == owed:
                    out.add((node, e, ""))
                continue
            out.add((node, e + 1, ""))
            for letter, child in self.children[node].items():
                out.add((child, e + (letter != c), ""))
                if c != letter and c in self.children[child]:
                    out.add((self.children[child][c], e + 1, letter))
        self.steps[state][c] = to = self._state(out)
        return to

    def match(self, word: str) -> tuple[float, int] | None:
        """(weight, errors) of the best term the word is or begins with, fewest errors first."""
        state, found, dead, steps = self.start, None, self.dead, self.steps
        for c in word:
            to = steps[state].get(c)
            state = self._step(state, c) if to is None else to
            if state == dead:
                return found
            if (hit := self.begins[state]) and (found is None or hit[1] < found[1]):
                found = hit
        hit = self.ends[state]
        return hit if hit and (found is None or hit[1] <= found[1]) else found


class Model:
    """Lexicon, exceptions (words of clean documents that resemble a term) and logistic weights."""

    def __init__(self, lexicon: list[tuple[str, bool, float]], exceptions: frozenset[str], weights: list[float] | None, prior: float) -> None:
        self.lexicon, self.exceptions, self.weights, self.prior = lexicon, exceptions, weights, prior


class Scorer:
    """Per worker: the matcher and what it has found about each run of characters."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.matcher = Matcher(model.lexicon)
        self.seen: set[str] = set()
        self.hits: dict[str, tuple[float, int]] = {}

    def look(self, run: str) -> None:
        word = run.strip(_STRIP)
        found = None
        for part in [word] if word.isalpha() else [word, *_PARTS(word)]:
            hit = self.matcher.match(part)
            if hit and not (hit[1] and part in self.model.exceptions) and (found is None or (hit[1], -hit[0]) < (found[1], -found[0])):
                found = hit
        if found:
            self.hits[run] = found

    def features(self, text: str) -> list[float]:
        """Sums of used hits (misspelt ones count less) and of quoted ones, density, and the most in a window of 20 words."""
        runs = text.lower().split()
        distinct = set(runs)
        if len(self.seen) > MEMO:
            self.seen.clear()
            self.hits.clear()
        for run in distinct - self.seen:
            self.look(run)
        self.seen |= distinct
        if self.hits.keys().isdisjoint(distinct):
            return [0.0] * 4
        used = quoted = 0.0
        places = []
        opened = np.cumsum([sum(r.count(q) for q in QUOTES) for r in runs])
        for i, run in enumerate(runs):
            if not (hit := self.hits.get(run)):
                continue
            weight = hit[0] / (1 + 2 * hit[1])
            before = int(opened[i - 1]) if i else 0
            marked = run[0] in QUOTES and run.rstrip(".,;:!?")[-1:] in QUOTES
            inside = before % 2 == 1 and int(opened[-1]) > before and before - (int(opened[i - CONTEXT - 1]) if i > CONTEXT else 0) > 0
            told = any(r.strip(_STRIP) in REPORTING for r in runs[max(0, i - CONTEXT) : i])
            if marked or inside or (told and before % 2):
                quoted += weight
                continue
            places.append(i)
            used += weight
        cluster, lo = 0, 0
        for hi, at in enumerate(places):
            while at - places[lo] >= 20:
                lo += 1
            cluster = max(cluster, hi - lo + 1)
        return [math.log1p(used), math.log1p(QUOTED_WEIGHT * quoted), math.log1p(100 * len(places) / len(runs)), math.log1p(cluster)]

    def score(self, text: str) -> float:
        w = self.model.weights
        if w is None:
            return 0.0
        z = w[0] + sum(a * b for a, b in zip(w[1:], self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def fold(key):
    """The learning fold of a key column: crc32 of its text modulo 5; fold 0 is held out."""
    return F.crc32(key.cast("string").cast("binary")) % 5


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, stem, toxic documents, clean documents) of what a task reads."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for b in batches:
        for text, toxic in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            words = {w for r in set((text.as_py() or "").lower().split()) for w in _PARTS(r)}
            stems = {"\0" + w[:n] for w in words for n in STEMS if len(w) >= n}
            counts[0 if toxic else 1].update(words | stems)
    terms = list(counts[0] | counts[1])
    yield pa.RecordBatch.from_arrays(
        [pa.array([t.lstrip("\0") for t in terms], pa.string()), pa.array([t[0] == "\0" for t in terms], pa.bool_()),
         pa.array([counts[0][t] for t in terms], pa.int64()), pa.array([counts[1][t] for t in terms], pa.int64())],
        names=["term", "stem", "pos", "neg"],
    )


def choose(rows: list[tuple[str, bool, int, int, float]]) -> list[tuple[str, bool, float]]:
    """Of terms (text, stem, toxic documents, clean documents, log odds), those that none covers as well.

    A stem is lengthened while it loses next to nothing, and becomes a word if that accounts for it; what
    a shorter stem covers goes.
    """
    stems = {r[0]: r for r in rows if r[1]}
    words = {r[0]: r for r in rows if not r[1]}
    out: dict[tuple[str, bool], float] = {}
    covered: set[str] = set()
    by_parent: dict[str, list[str]] = defaultdict(list)
    for t in stems:
        by_parent[t[:-1]].append(t)
    for t in sorted(stems, key=lambda t: (len(t), t)):
        if any(t[:n] in covered for n in range(min(STEMS), len(t))):
            continue
        covered.add(t)
        while longer := [c for c in by_parent[t] if stems[c][2] >= 0.95 * stems[t][2]]:
            t = longer[0]
        word = next((w for w in words if w.startswith(t) and words[w][2] >= 0.8 * stems[t][2]), None)
        if word:
            out[word, False] = words[word][4]
        else:
            out[t, True] = stems[t][4]
    for w in words:
        if not any(w[:n] in covered for n in STEMS):
            out[w, False] = words[w][4]
    return [(t, stem, weight) for (t, stem), weight in out.items()]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights (intercept first) by Newton's method."""
    a = np.c_[np.ones(len(x)), x]
    w = np.zeros(a.shape[1])
    penalty = np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def without_copies(sample: DataFrame) -> DataFrame:
    """(text, toxic) of a bounded sample (key, text, toxic), without near copies of a row of the same label.

    Rows that agree in the least hashes of one band meet the band's first row, and go if their sets of shingles are really alike.
    Texts of fewer than three words are alike if their words are the same.
    """
    words = "transform(__w, w -> xxhash64(w))"
    threes = (
        f"CASE WHEN size(__w) < 3 THEN array(xxhash64(array_join(__w, ' '))) ELSE array_distinct(zip_with(zip_with({words}, slice({words}, 2, size(__w)), "
        f"(a, b) -> xxhash64(a, b)), slice({words}, 3, size(__w)), (a, b) -> xxhash64(a, b))) END"
    )
    rows = sample.withColumn("__w", words_of(F.lower("text"))).withColumn("set", F.array_compact(F.expr(threes)))
    rows = written(rows.select("key", "text", "toxic", "set", F.xxhash64("key", "text").alias("row"), F.monotonically_increasing_id().alias("nth")), "toxicity-sets")
    least = lambda k: F.array_min(F.transform("set", lambda h: F.xxhash64(h, F.lit(k))))
    bands = F.array(*[F.struct(F.lit(k).alias("band"), *[least(k * BAND + j).alias(f"m{j}") for j in range(BAND)]) for k in range(BANDS)])
    banded = written(rows.select("toxic", "row", "nth", F.explode(bands).alias("at")), "toxicity-bands")
    first = banded.groupBy("toxic", "at").agg(F.min(F.struct("row", "nth")).alias("first"))
    pairs = banded.join(first, ["toxic", "at"]).filter(F.struct("row", "nth") > F.col("first")).select("nth", F.col("first.nth").alias("other")).distinct()
    sets = rows.select(F.col("nth").alias("other"), F.col("set").alias("other_set"))
    common = F.size(F.array_intersect("set", "other_set"))
    copies = pairs.join(rows.select("nth", "set"), "nth").join(sets, "other").filter(common >= ALIKE * (F.size("set") + F.size("other_set") - common))
    return rows.join(copies.select("nth").distinct(), "nth", "left_anti").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learn from the labelled rows outside the held-out fold, on the bounded sample."""
    spark = docs.sparkSession
    usable = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & (fold(F.col(key)) != 0))
    usable = usable.groupBy(key).agg((F.max(label) > 0).alias("toxic"))
    drawn = [
        usable.filter("toxic" if toxic else "NOT toxic").orderBy(F.xxhash64(key), key).limit(most)
        for toxic, most in ((True, MAX_TOXIC), (False, MAX_CLEAN))
    ]
    # At most MAX_TOXIC + MAX_CLEAN keys.
    sample = docs.select(key, text).join(F.broadcast(drawn[0].unionAll(drawn[1])), key)
    sample = without_copies(written(sample.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"), "toxic"), "toxicity-drawn"))
    sample = written(sample, "toxicity-sample")
    counts = sample.mapInArrow(tasks("toxicity", _term_counts), "term string, stem boolean, pos long, neg long")
    counts = written(counts.groupBy("term", "stem").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "toxicity-terms")
    sizes = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    n_pos, n_neg = sizes.get(True, 0), sizes.get(False, 0)
    if not n_pos or not n_neg:
        return Model([], frozenset(), None, 0.0)
    odds = F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (n_neg + 1))
    share = n_pos / (n_pos + n_neg)
    total = F.col("pos") + F.col("neg")
    ratio = 2 * (
        F.col("pos") * F.log(F.col("pos") / (total * share)) + F.when(F.col("neg") > 0, F.col("neg") * F.log(F.col("neg") / (total * (1 - share)))).otherwise(0.0)
    )
    likely = (
        counts.filter("pos > 0").withColumns({"odds": odds, "ratio": ratio})
        .filter((F.col("odds") >= LEAST_ODDS) & (F.col("ratio") >= LEAST_RATIO))
        .orderBy(F.desc("ratio"), "term", "stem")
    )
    lexicon = choose([(r["term"], r["stem"], r["pos"], r["neg"], r["odds"]) for r in likely.collect()])  # words of the sample, so bounded

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for b in batches:
            got = [w for w in b.column(0).to_pylist() if (hit := matcher.match(w)) and hit[1]]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.string())], names=["term"])

    clean = counts.filter("NOT stem AND neg > 0").filter(odds < 1).select("term")
    exceptions = frozenset(r[0] for r in clean.mapInArrow(tasks("toxicity", alike), "term string").collect())  # words of the sample, so bounded
    model = Model(lexicon, exceptions, None, n_pos / (n_pos + n_neg))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            rows = [scorer.features(t.as_py() or "") for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), b.column(1)], names=["x", "toxic"])

    # Equal rows count once with their number; most clean documents have no hit at all.
    rows = sample.mapInArrow(tasks("toxicity", featured), "x array<double>, toxic boolean").groupBy("x", "toxic").count().collect()
    x = np.repeat(np.array([r["x"] for r in rows]), [r["count"] for r in rows], axis=0)
    y = np.repeat(np.array([float(r["toxic"]) for r in rows]), [r["count"] for r in rows])
    order = np.lexsort((y, *x.T))
    model.weights = logistic(x[order], y[order]).tolist()
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row's whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # terms and exceptions of the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([scorer.score(t.as_py() or "") for t in b.column(1)], pa.float64())], names=[key, "score"])

    return docs.select(key, text).mapInArrow(tasks("toxicity", run), f"`{key}` {docs.schema[key].dataType.simpleString()}, score double")


def keep_clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under 0.5, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in batches:
            yield b.filter(pa.array([scorer.score(t.as_py() or "") < 0.5 for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(tasks("toxicity", run), docs.schema)
