"""Leases over a stream: the same decisions for every order, batching and repetition."""

import json
import random

from quillon.streaming import leases

KEY = "spark.sql.streaming.stateStore.providerClass"


def at(second):
    return f"2024-01-01T00:{second // 60:02d}:{second % 60:02d}"


REQUESTS = [
    ("r1", "a", "x", "acquire", None, 60, 1), ("r2", "a", "y", "acquire", None, 60, 10), ("r3", "a", "x", "renew", 1, 60, 30), ("r4", "a", "x", "renew", 7, 60, 31),
    ("r5", "a", "y", "acquire", None, 60, 95), ("r6", "a", "x", "release", 1, 0, 96), ("r7", "a", "y", "release", 2, 0, 97), ("r8", "a", "x", "acquire", None, 10, 98),
    ("r9", "b", "z", "acquire", None, 5, 3), ("r10", "b", "z", "renew", 1, 5, 20), ("r11", "b", "z", "steal", 1, 5, 21), ("r12", "b", "w", "acquire", None, 5, 22),
]
WANT = {
    "r1": ("granted", 1), "r2": ("denied_held", 1), "r3": ("renewed", 1), "r4": ("denied_fenced", 1), "r5": ("granted", 2), "r6": ("denied_fenced", 2), "r7": ("released", 2),
    "r8": ("granted", 3), "r9": ("granted", 1), "r10": ("denied_expired", 1), "r11": ("denied_unknown", 1), "r12": ("granted", 2),
}


def run(spark, folder, batches):
    (folder / "in").mkdir(parents=True)
    last = [("end", "z", "n", "acquire", None, 1, 3000)], [("end2", "z", "n", "acquire", None, 1, 3001)]
    for k, rows in enumerate([*batches, *last]):
        keys = ("id", "resource", "holder", "action", "token", "seconds", "at")
        (folder / "in" / f"{k:03d}.json").write_text("\n".join(json.dumps(dict(zip(keys, (*r[:6], at(r[6])), strict=True))) for r in rows))
    stream = spark.readStream.schema(leases.REQUEST).option("maxFilesPerTrigger", 1).json(str(folder / "in"))
    before = spark.conf.get(KEY)
    spark.conf.set(KEY, leases.PROVIDER)
    try:
        out = leases.leases(leases.valid(stream)[0], "10 minutes")
        out.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "check")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(KEY, before)
    return spark.read.schema(leases.DECISION).parquet(str(folder / "out")).collect()


def test_any_order_and_repetition_gives_the_same_leases(spark, tmp_path):
    got = run(spark, tmp_path / "one", [REQUESTS])
    assert {r.id: (r.outcome, r.token) for r in got if r.id and r.id.startswith("r")} == WANT
    r = random.Random(4)
    mixed = r.sample(REQUESTS, len(REQUESTS))
    again = run(spark, tmp_path / "two", [mixed[:5], mixed[3:9], mixed[7:], mixed[:2]])
    assert {x.id: (x.outcome, x.token) for x in again if x.id and x.id.startswith("r")} == WANT
    assert sum(1 for x in again if x.id == "r1") == 1
    assert {(x.resource, x.token) for x in got if x.outcome == "expired"} == {(x.resource, x.token) for x in again if x.outcome == "expired"}


def test_bad_requests_are_told_apart(spark):
    rows = [("1", "a", "x", "acquire", None, 1, None), (None, "a", "x", "acquire", None, 1, None)]
    good, bad = leases.valid(spark.createDataFrame(rows, leases.REQUEST))
    assert good.count() == 0 and bad.count() == 2
