"""Captured diagnostics: side by side, isolated, reused by their keys."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from quillon.plans.capture import capture


def receipt(df):
    return {r.diagnostic: (r.outcome, r.rows) for r in df.collect()}


def test_failures_are_isolated_and_diagnostics_overlap(spark):
    running, most, lock = [0], [0], threading.Lock()

    def slow(n):
        def make():
            with lock:
                running[0] += 1
                most[0] = max(most[0], running[0])
            time.sleep(0.5)
            with lock:
                running[0] -= 1
            return spark.range(n)

        return make

    def raises():
        raise KeyError("no such state")

    broken = lambda: spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("late"))).cast("int").alias("x"))
    got = receipt(capture(spark, {"a": slow(3), "b": slow(5), "raises": raises, "breaks": broken, "c": slow(0), "unknown": lambda: spark.range(1).select("nothing")}))
    assert got == {"a": ("captured", 3), "b": ("captured", 5), "c": ("captured", 0), "raises": ("failed", None), "breaks": ("failed", None), "unknown": ("failed", None)}
    assert most[0] > 1


def test_tables_are_reused_by_key(spark, tmp_path):
    calls = []

    def make(name, n):
        return lambda: calls.append(name) or spark.range(n)

    def bad():
        calls.append("bad")
        return spark.range(2).select(F.when(F.col("id") == 1, F.raise_error(F.lit("late"))).cast("int").alias("x"))

    root, keys = f"file://{tmp_path}/store", {"a": "k1", "bad": "k1"}
    first = receipt(capture(spark, {"a": make("a", 4), "bad": bad, "free": make("free", 2)}, root, keys=keys))
    assert first == {"a": ("captured", 4), "bad": ("failed", None), "free": ("captured", 2)}
    again = receipt(capture(spark, {"a": make("a", 9), "bad": make("bad", 6), "free": make("free", 2)}, root, keys=keys))
    assert again == {"a": ("reused", 4), "bad": ("captured", 6), "free": ("captured", 2)}
    assert sorted(calls) == ["a", "bad", "bad", "free", "free"]
    other = receipt(capture(spark, {"a": make("a", 9)}, root, keys={"a": "k2"}))
    assert other == {"a": ("captured", 9)}
    with pytest.raises(ValueError):
        capture(spark, {"a": make("a", 1)}, keys={"a": "k"})
