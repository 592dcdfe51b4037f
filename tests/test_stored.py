"""Ordinates by splits, stored vectors in two phases, bases by a QR tree: forms and faults that SQL does not reach."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import bases
from quillon.sources import ordinates, vectors

TEXTS = ["14.13", "", 'a "quoted" one', "\\", "\\\\", '\\"', "é\n\t", "[", "],", '","', '"', "x" * 300, "tail\\"] * 7


@pytest.mark.parametrize("size", [401, 1 << 20])
def test_arrays_are_the_same_for_every_split_size(spark, tmp_path, size):
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.json").write_text(json.dumps(TEXTS, ensure_ascii=False))
    (tmp_path / "two").mkdir()
    half = json.dumps(TEXTS[:40], indent=1)[:-2]
    (tmp_path / "two" / "a.json").write_text(half + "\n")
    (tmp_path / "two" / "b.json").write_text("," + json.dumps(TEXTS[40:])[1:])
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "a.json").write_text(" [ ]\n")
    keys = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        for name in ("one", "two"):
            got = ordinates.ordinates(spark, str(tmp_path / name)).collect()
            assert [r.text for r in sorted(got)] == TEXTS and [r.ordinal for r in sorted(got)] == list(range(1, len(TEXTS) + 1))
            assert [r.text for r in sorted(ordinates.ordinates(spark, str(tmp_path / name), 3).collect())] == TEXTS[:3]
        assert ordinates.ordinates(spark, str(tmp_path / "none")).collect() == []
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_other_forms_are_refused(spark, tmp_path):
    for k, text in enumerate(('{"a": "b"}', '["a" "b"]', '["a", 3]', '["a",,"b"]', '"a"', '["a"', "[3]")):
        (tmp_path / f"{k}.json").write_text(text)
        with pytest.raises(ValueError, match="not one JSON array"):
            ordinates.ordinates(spark, str(tmp_path / f"{k}.json"))
    (tmp_path / "few.json").write_text('["a"]')
    with pytest.raises(ValueError, match="fewer than 2"):
        ordinates.ordinates(spark, str(tmp_path / "few.json"), 2)


def test_arrays_round_trip_and_are_named_by_content(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k long, t string").repartition(5)
    path = ordinates.write_ordinates(df, str(tmp_path / "w"), "k", "t")
    whole = "".join(open(f"{path}/{f}").read() for f in sorted(os.listdir(path)) if f.startswith("part-"))
    assert json.loads(whole) == TEXTS
    back = ordinates.ordinates(spark, path)
    assert [r.text for r in sorted(back.collect())] == TEXTS
    assert ordinates.ordinates(spark, ordinates.write_ordinates(df.limit(0), str(tmp_path / "e"), "k", "t")).collect() == []
    one, two = ordinates.identity(back, "n", 4).first(), ordinates.identity(back.repartition(3), "n", 4).first()
    assert one == two and one["count"] == len(TEXTS)
    changed = back.withColumn("text", F.when(F.col("ordinal") == 50, "other").otherwise(F.col("text")))
    assert ordinates.identity(changed, "n", 4).first().sha256 != one.sha256


# --- Stored vectors


def test_ranges_open_their_chunks_alone(spark, tmp_path):
    path = str(tmp_path / "v")
    vectors.write(spark.range(1000).select(F.col("id").alias("i"), (F.col("id") * 0.5).alias("v")).repartition(7), path, chunk=64)
    told = json.load(open(f"{path}/manifest.json"))
    assert told["length"] == 1000 and [c[0] for c in told["chunks"]] == list(range(0, 1000, 64))
    assert sorted((r.i, r.v) for r in vectors.read(spark, path).collect()) == [(k, k * 0.5) for k in range(1000)]
    for c in told["chunks"]:  # all but two chunks are spoilt, so they cannot have been read
        if c[0] not in (128, 192):
            with open(f"{path}/{c[3]}", "r+b") as f:
                f.write(b"?")
    assert sorted(r.i for r in vectors.read(spark, path, 130, 250).collect()) == list(range(130, 250))
    df = vectors.read(spark, path)
    assert sorted(r.i for r in df.filter("i >= 140 AND i < 255").collect()) == list(range(140, 255))
    assert [r.v for r in df.filter("i = 200").collect()] == [100.0]
    assert df.filter("i > 150 AND i <= 160").rdd.getNumPartitions() == 1
    assert vectors.read(spark, path, 5000).collect() == []
    with pytest.raises(Exception, match="not what the manifest says"):
        df.filter("i = 0").collect()


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    rows = spark.range(300).select(F.col("id").alias("i"), F.lit(1.0).alias("v"))
    for k, bad in enumerate((rows.filter("i <> 100"), rows.unionAll(rows.limit(1)), rows.withColumn("v", F.when(F.col("i") != 7, 1.0)), rows.withColumn("i", F.col("i") + 1))):
        path = str(tmp_path / f"bad{k}")
        with pytest.raises(Exception):  # noqa: B017
            vectors.write(bad, path, chunk=64)
        assert not os.path.exists(f"{path}/manifest.json")
        with pytest.raises(Exception, match="not completed"):
            vectors.read(spark, path).collect()
    assert vectors.read(spark, vectors.write(rows.limit(0), str(tmp_path / "none"))).collect() == []


# --- Bases


def test_a_basis_is_orthonormal_whatever_the_condition(spark, monkeypatch):
    monkeypatch.setattr(bases, "FAN", 2)
    r = np.random.default_rng(5)
    n, k = 500, 7
    a = r.normal(size=(n, k)) @ np.diag(10.0 ** np.arange(0, -k, -1)) + 1e-9 * r.normal(size=(n, k))
    a[:, 3] = a[:, 2] + 1e-7 * a[:, 3]  # nearly dependent
    df = spark.createDataFrame([(i, a[i].tolist()) for i in range(n)], "i long, x array<double>").repartition(9)
    basis = bases.orthonormal(df)
    q = np.array([x.q for x in sorted(basis.rows.collect(), key=lambda x: x.i)])
    assert basis.loss < 1e-13 and np.abs(q.T @ q - np.eye(k)).max() < 1e-13
    assert np.allclose(q @ basis.triangle, a, rtol=0, atol=1e-12) and (np.diag(basis.triangle) > 0).all() and np.allclose(np.tril(basis.triangle, -1), 0)
    v = r.normal(size=n)
    got = bases.project(basis, spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i long, v double"))
    assert np.allclose([x.v for x in sorted(got.collect())], q @ (q.T @ v), atol=1e-12)


def test_dependent_columns_and_odd_rows_are_refused(spark):
    r = random.Random(3)
    rows = [(i, [x := r.random(), 2 * x, r.random()]) for i in range(50)]
    with pytest.raises(ValueError, match="column 1 depends"):
        bases.orthonormal(spark.createDataFrame(rows, "i long, x array<double>"))
    for bad in ([(1, [1.0]), (2, [1.0, 2.0])], [], [(1, [])]):
        with pytest.raises(ValueError, match="same number"):
            bases.orthonormal(spark.createDataFrame(bad, "i long, x array<double>"))
    with pytest.raises(Exception, match="finite"):
        bases.orthonormal(spark.createDataFrame([(1, [1.0, float("nan")]), (2, [1.0, None])], "i long, x array<double>"))


def test_asymmetry_counts_missing_mirror_images(spark):
    m = spark.createDataFrame([(1, 2, 5.0), (2, 1, 5.0), (1, 3, 2.0), (2, 2, 9.0), (3, 2, 1.0), (2, 3, 1.5)], "i long, j long, v double")
    assert tuple(bases.asymmetry(m).first()) == (5, 2, 2.0)
    assert tuple(bases.asymmetry(m.limit(0)).first()) == (0, 0, 0.0)
