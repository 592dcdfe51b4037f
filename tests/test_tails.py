"""Weighted tails against plain exact sums."""

import math
import random

import pytest

from quillon.operators import tails

SCHEMA = "family string, partition string, coordinate double, weight double"


def plain(atoms, cutoffs):
    out = {}
    for key in {a[:2] for a in atoms}:
        own = [(x, w) for f, p, x, w in atoms if (f, p) == key]
        pole, origin = any(x == 0 and w != 0 for x, w in own), all(x == 0 for x, _ in own)
        for c in cutoffs:
            inside, rest = [(x, w) for x, w in own if x <= c], [w for x, w in own if x > c]
            terms = [(w / x, w / x / x, w / x / x / x) for x, w in inside if x > 0]
            moments = [None] * 3 if pole else [math.fsum(t[k] for t in terms) for k in range(3)]
            status = "resolved" if not pole else "origin_only" if origin else "unresolved_denominator"
            out[(*key, c)] = (len(inside), math.fsum(w for _, w in inside), math.fsum(abs(w) for _, w in inside), math.fsum(rest), *moments, status)
    return out


@pytest.mark.parametrize("given", [None, [0.0, 2.5, 1e9, 2.5]])
def test_tails_are_exact(spark, given):
    r = random.Random(7)
    atoms = [(f, p, float(r.choice([1, 2, 3, 0.25, 40, 7e8])), r.choice([r.uniform(-1, 1), 1e17 * r.uniform(-1, 1), 1e-20])) for f, p, n in (("a", "x", 60), ("a", "y", 9), (None, None, 12), ("b", None, 1)) for _ in range(n)]
    atoms += [("a", "y", 0.0, 0.0), ("c", "z", 0.0, 1.5), ("c", "z", 0.0, 1.5), ("d", "z", 0.0, 2.0), ("d", "z", 3.0, -2.0), ("e", "z", 0.0, 0.0), ("late", "z", 5e9, 1.0)]
    got = tails.weighted_tail(spark.createDataFrame(r.sample(atoms, len(atoms)), SCHEMA), given).collect()
    xs = sorted({a[2] for a in atoms})
    want = plain(atoms, sorted(set(given)) if given else [x for k, x in enumerate(xs, 1) if k & (k - 1) == 0 or k == len(xs)])
    assert len(got) == len(want)
    for g in got:
        assert tuple(g)[3:] == want[tuple(g)[:3]], g


def test_refusals_and_empty_tables(spark):
    for row in (("a", "b", -1.0, 1.0), ("a", "b", None, 1.0), ("a", "b", 1.0, float("nan")), ("a", "b", float("inf"), 1.0)):
        with pytest.raises(ValueError):
            tails.weighted_tail(spark.createDataFrame([row], SCHEMA))
    one = spark.createDataFrame([("a", "b", 1.0, 1.0)], SCHEMA)
    for bad in ([-1.0], [float("nan")], [float(k) for k in range(tails.CUTOFFS + 1)]):
        with pytest.raises(ValueError):
            tails.weighted_tail(one, bad)
    assert tails.weighted_tail(one.limit(0)).count() == 0
    assert tails.weighted_tail(one, []).count() == 0
