"""Enclosed roots and assessments on rows that SQL does not reach."""

from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quillon.operators import enclosed_roots, reports


def test_enclosures_hold_the_roots(spark):
    poles = {"a": [(0.0, 1.0), (1.0, 1.0)], "b": [(-3.0, 2.0), (0.5, 1e-9), (0.5, 1e-9), (7.0, 1e6)], "one": [(2.0, 1.0)], "near": [(1.0, 1.0), (1.0 + 2.0**-52, 1.0)]}
    df = spark.createDataFrame([(f, p, w) for f, rows in poles.items() for p, w in rows], "family string, pole double, weight double")
    got = {(r.family, r.gap): r for r in enclosed_roots.roots(df).collect()}
    assert set(got) == {("a", 1), ("b", 1), ("b", 2), ("near", 1)}
    assert got["a", 1].lo <= 0.5 <= got["a", 1].hi and got["a", 1].hi - got["a", 1].lo < 1e-11
    for (family, _), r in got.items():
        if r.status == "enclosed":  # exact signs at both ends
            at = lambda x: sum(Fraction(w) / (Fraction(x) - Fraction(p)) if x != p else 10**30 for p, w in poles[family])  # noqa: B023, E731
            assert at(r.lo) > 0 and (r.hi in [p for p, _ in poles[family]] or at(r.hi) < 0)
    wanted = spark.createDataFrame([("a", 0.4, 0.6), ("a", 0.1, 0.2), ("a", got["a", 1].lo + (got["a", 1].hi - got["a", 1].lo) / 2, 0.9), ("one", -9.0, 9.0)], "family string, low double, high double")
    proofs = {(r.family, r.high): r.proof for r in enclosed_roots.windows(enclosed_roots.roots(df), wanted).collect()}
    assert proofs == {("a", 0.6): "holds", ("a", 0.2): "empty", ("a", 0.9): "undecided", ("one", 9.0): "empty"}
    for bad in ((0.0, -1.0), (0.0, 0.0), (float("inf"), 1.0), (None, 1.0)):
        with pytest.raises(ValueError):
            enclosed_roots.roots(spark.createDataFrame([("x", *bad)], "family string, pole double, weight double"))
    assert enclosed_roots.roots(df.limit(0)).collect() == []


def test_durability_says_first_reason_and_all_deficits(spark):
    rows = [("o", 1, "c1", "l1", "d1", False, False), ("o", 2, "c1", "l2", "d2", True, False), ("o", 3, "c2", "l1", "d2", True, False), ("o", 4, "c3", "l3", "d1", False, False), ("o", 5, "c4", "l4", "d4", True, True), ("p", 1, "c1", "l1", "d1", True, None)]
    df = spark.createDataFrame(rows, "object string, seq int, copy string, locator string, domain string, archived boolean, broken boolean")
    out, refused = reports.durability(df, [("broken", F.col("broken")), ("named", F.col("copy") == "c4")], 3, 2, archive=True)
    got = {r.object: (r.copies, r.domains, r.archived, r.deficits, r.durable) for r in out.collect()}
    assert got == {"o": (2, 1, False, ["copies", "domains", "archive"], False), "p": (0, 0, False, ["copies", "domains", "archive"], False)}
    assert sorted((r.object, r.copy, r.reason) for r in refused.collect()) == [("o", "c1", "copy_repeats"), ("o", "c2", "locator_repeats"), ("o", "c4", "broken"), ("p", "c1", "broken")]


def test_scores_exclude_what_was_not_frozen(spark):
    cases = spark.createDataFrame([("f", 1), ("f", 2), ("g", 3)], "family string, case int")
    seen = spark.createDataFrame([(1, 1, "pass"), (1, 2, "fail"), (2, 1, "pass"), (9, 1, "fail")], "case int, seq int, status string")
    verdicts, excluded = reports.scored(cases, seen)
    assert {r.family: (r.cases, r.passed, r.verdict) for r in verdicts.collect()} == {"f": (2, 2, "pass"), "g": (1, 0, "unresolved")}
    assert sorted((r.case, r.reason) for r in excluded.collect()) == [(1, "repeated"), (9, "not_frozen")]


def test_phase_events_count_whole_or_not_at_all(spark):
    rows = [("a", 1, "p", "done", 1.5, {"bytes_in": "10", "n": "3", "out_bytes": "x", "flag_bytes": "true"}), ("a", 2, "p", "failed", 0.5, None), ("a", 3, "p", "done", float("nan"), {"bytes": "9"}), ("a", 4, None, "done", 1.0, None), ("a", 5, "p", "done", -1.0, None)]
    good, bad = reports.phase_statistics(spark.createDataFrame(rows, "attempt string, line int, phase string, outcome string, seconds double, details map<string,string>"), ["attempt"])
    assert [tuple(r) for r in good.collect()] == [("a", "p", 2, 2.0, 1, 10)]
    assert sorted((r.line, r.reason) for r in bad.collect()) == [(3, "seconds_not_finite"), (4, "no_phase"), (5, "seconds_negative")]


def test_capacity_and_identity(spark):
    full = spark.createDataFrame([("s", 2**63 - 1), ("t", 5)], "shard string, used long")
    assert {r.shard: (r.projected, r.accepts) for r in reports.capacity(full, F.lit(3), F.lit(10)).collect()} == {"s": (None, False), "t": (8, True)}
    held = spark.createDataFrame([("k", 1), ("k", 2), ("l", 3)], "key string, artifact int")
    want = spark.createDataFrame([("k",), ("l",), ("m",)], "key string")
    assert {r.key: (r.artifact, r.found) for r in reports.by_identity(want, held, ["key"]).collect()} == {"k": (None, "ambiguous"), "l": (3, "found"), "m": (None, "missing")}
