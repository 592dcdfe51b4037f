"""Ladders of stored matrices by panels, against numpy on every leading block."""

import numpy as np
import pytest

from quillon.operators import panels

SCHEMA = "f string, i long, j long, value double"


def coo(name, a):
    n = len(a)
    return [(name, i, j, float(a[i, j])) for i in range(n) for j in range(n) if a[i, j]]


def positive(n, seed):
    x = np.random.default_rng(seed).normal(size=(n + 5, n))
    a = x.T @ x + np.eye(n)
    return (a + a.T) / 2


def expected(a):
    out = []
    for n in range(1, len(a) + 1):
        inv = np.linalg.inv(a[:n, :n])
        pivot = 1 / inv[-1, -1]
        last = inv[-1] / inv[-1, -1]
        out.append((n, pivot, last @ last, np.trace(inv), np.trace(inv @ inv), np.trace(inv @ inv @ inv)))
    return np.array(out)


def of(rows, name):
    own = sorted((r for r in rows if r.f == name and not r.stopped), key=lambda r: r.dimension)
    return np.array([(r.dimension, r.pivot, r.mass, r.trace, r.square_trace, r.cube_trace) for r in own])


def test_ladders_of_several_sizes_and_a_stop(spark, monkeypatch):
    monkeypatch.setattr(panels, "KEPT", 2)
    bad = positive(9, 3)
    bad[6, 6] = bad[6, :6] @ np.linalg.solve(bad[:6, :6], bad[:6, 6]) - 0.5
    sparse = np.diag([4.0, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4])
    sparse[10, 0] = sparse[0, 10] = 1.0
    whole = {"a": positive(14, 1), None: positive(4, 2), "one": np.array([[2.5]]), "sparse": sparse}
    rows = [r for f, m in [*whole.items(), ("bad", bad)] for r in coo(f, m)]
    rows += [("hole", 0, 0, 1.0), ("hole", 5, 5, 1.0)]
    rows += [("one", 0, 0, 1.5)]  # entries of one place are added
    whole["one"] = np.array([[4.0]])
    got = panels.ladder(spark.createDataFrame(rows, SCHEMA), ["f"], panel=4).collect()
    for f, m in whole.items():
        assert np.allclose(of(got, f), expected(m), rtol=1e-9)
    assert np.allclose(of(got, "bad"), expected(bad[:6, :6]), rtol=1e-8)
    stops = {r.f: r for r in got if r.stopped}
    assert set(stops) == {"bad", "hole"}
    assert stops["bad"].dimension == 7 and np.isclose(stops["bad"].pivot, -0.5) and stops["bad"].trace is None
    assert stops["hole"].dimension == 2 and stops["hole"].pivot == 0.0 and len(of(got, "hole")) == 1


def test_finished_rounds_are_read(spark, tmp_path, monkeypatch):
    m = positive(7, 5)
    df = spark.createDataFrame(coo("m", m), SCHEMA)
    place = f"file://{tmp_path}/rounds"
    first = of(panels.ladder(df, ["f"], panel=3, folder=place).collect(), "m")
    monkeypatch.setattr(panels, "factored", None)  # nothing is factored again
    again = of(panels.ladder(df, ["f"], panel=3, folder=place, third=True).collect(), "m")
    assert (first == again).all()
    with pytest.raises(ValueError, match="other matrices"):
        panels.ladder(spark.createDataFrame(coo("m", m + np.eye(7)), SCHEMA), ["f"], panel=3, folder=place)


def test_what_is_refused(spark):
    for rows in ([("a", 0, 0, None)], [("a", 0, 0, float("inf"))], [("a", -1, -1, 1.0)], [("a", None, 0, 1.0)], [("a", 0, 1, 1.0), ("a", 1, 0, 2.0)], [("a", 0, 1, 1.0)], [("a", panels.MOST, panels.MOST, 1.0)]):
        with pytest.raises(ValueError):
            panels.ladder(spark.createDataFrame(rows, SCHEMA), ["f"])
    empty = panels.ladder(spark.createDataFrame([], SCHEMA), ["f"])
    assert empty.count() == 0 and empty.columns[:3] == ["f", "dimension", "pivot"]
