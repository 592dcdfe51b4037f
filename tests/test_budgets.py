"""Greedy batches and budgets by composed steps, and exact sums, against plain Python."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import budget, exact_sums


def plain_batches(sizes, most, used=0):
    out, batch = [], 0
    for s in sizes:
        if used > 0 and used + s > most:
            batch, used = batch + 1, s
        else:
            used += s
        out.append(batch)
    return out, used


def test_steps_compose():
    r = random.Random(1)
    for trial in range(300):
        most = r.choice([5, 20, 100])
        parts = [[r.choice([0, 0, 1, 2, 3, r.randint(0, 12), r.randint(0, 150)]) for _ in range(r.randint(1, 12))] for _ in range(r.randint(1, 6))]
        steps = [budget.Steps.of(np.array(p), most) for p in parts]
        whole = steps[0]
        for s in steps[1:]:
            whole = whole.then(s)
        flat = [s for p in parts for s in p]
        for entry in range(0, most + 60):
            out, used = plain_batches(flat, most, entry)
            assert whole(entry) == (out[-1], used), (most, parts, entry)


@pytest.mark.parametrize("width,fan", [(3, 2), (7, 3), (8_192, 64)])
def test_batches_equal_the_greedy_order(spark, monkeypatch, width, fan):
    monkeypatch.setattr(budget, "RANGE", width)
    monkeypatch.setattr(budget, "FAN", fan)
    r = random.Random(width)
    rows = [(g, k, r.choice([0, 1, 3, r.randint(0, 30), 200])) for g, n in (("a", 150), (None, 40), ("b", 1), ("c", 9)) for k in range(n)]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "source string, id long, size int")
    got = {(x.source, x.id): x.batch for x in budget.batches(df, ["source"], ["id"], "size", 50).collect()}
    for g in ("a", None, "b", "c"):
        own = sorted((k, s) for x, k, s in rows if x == g)
        assert [got[g, k] for k, _ in own] == plain_batches([s for _, s in own], 50)[0]
    assert budget.batches(df.limit(0), ["source"], ["id"], "size", 50).collect() == []


@pytest.mark.parametrize("width", [3, 16, 8_192])
def test_budgets_equal_the_greedy_order(spark, monkeypatch, width):
    monkeypatch.setattr(budget, "RANGE", width)
    r = random.Random(width)
    rows = [(g, k, r.choice([0, r.randint(1, 20), r.randint(50, 400), None])) for g, n in (("a", 120), (None, 60), ("b", 5), ("c", 1)) for k in range(n)]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "source string, id long, cost long")
    for limit in (0, 300, 10**9):
        got = {(x.source, x.id): x.taken for x in budget.spend(df, ["source"], ["id"], "cost", limit).collect()}
        for g in ("a", None, "b", "c"):
            left = limit
            for k, c in sorted((k, c) for x, k, c in rows if x == g):
                assert got[g, k] == (c is not None and c <= left)
                left -= c if got[g, k] else 0
    with pytest.raises(TypeError):
        budget.spend(df.withColumn("cost", F.col("cost").cast("double")), [], ["source", "id"], "cost", 5)


def test_exact_sums_are_rounded_once_for_every_partitioning(spark):
    r = random.Random(3)
    groups = {
        "cancel": [1e308, 1.0, -1e308, 2.0**-1074, 1e16, 1.0, -1e16], "tiny": [5e-324] * 7 + [-5e-324], "zero": [1.5, -1.5], "minus": [-0.0, -0.0],
        "half": [2.0**53, 1.0], "half_up": [2.0**53, 1.0, 2.0**-1074], "odd_half": [2.0**53 + 2, 1.0], "neg": [-(2.0**53), -1.0, -(2.0**-300)], "subnormal": [2.0**-1022, -(2.0**-1074)],
        "wide": [r.uniform(-1, 1) * 2.0 ** r.randint(-1000, 900) for _ in range(400)], "plain": [r.gauss(0, 1) for _ in range(3000)], "cents": [0.1] * 1000,
        "big": [1.7e308, 1.7e308, -1.7e308], "one": [math.pi], "limits": [2.0**1023, 2.0**-1074, 2.0 ** (26 * 3 - 1074), 2.0 ** (26 * 40 - 1074)],
    }
    groups |= {f"r{k}": [r.choice([1, -1]) * r.random() * 2.0 ** r.randint(-60, 60) for _ in range(r.randint(1, 30))] for k in range(200)}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("null", None), ("nan", float("nan")), ("nan", 1.0), ("inf", float("inf")), ("both", float("inf")), ("both", float("-inf")), ("down", float("-inf")), ("cancel", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = {g: float(sum(map(Fraction, vs))) for g, vs in groups.items()}
    for n in (1, 3, 8):
        got = {x.g: x.total for x in exact_sums.exact_sums(df.repartition(n).sortWithinPartitions(F.rand(n)), ["g"], total=F.col("v")).collect()}
        assert {g: got[g].hex() for g in want} == {g: v.hex() if v else "0x0.0p+0" for g, v in want.items()}
        assert got["null"] is None and math.isnan(got["nan"]) and got["inf"] == math.inf and math.isnan(got["both"]) and got["down"] == -math.inf
    over = spark.createDataFrame([(1.7e308,), (1.7e308,)], "v double")
    assert exact_sums.exact_sums(over, [], total=F.col("v")).first().total == math.inf
    assert exact_sums.exact_sums(over.limit(0), [], total=F.col("v")).collect()[0].total is None


def test_exact_products(spark):
    r = random.Random(4)
    rows = [(k % 5, r.gauss(0, 1) * 10.0 ** r.randint(-12, 12), r.gauss(0, 1) * 10.0 ** r.randint(-12, 12)) for k in range(500)]
    df = spark.createDataFrame(rows, "g int, a double, b double")
    got = {x.g: x.dot for x in exact_sums.exact_dots(df, ["g"], dot=(F.col("a"), F.col("b"))).collect()}
    for g in range(5):
        assert got[g] == float(sum(Fraction(a) * Fraction(b) for k, a, b in rows if k == g))
