"""What the second review of the third round found: small cases that failed before."""

import numpy as np
import pytest

from quillon.catalogue import governed, lookups, stores
from quillon.functions import certified
from quillon.operators import budget, linalg, recurrences, roots
from quillon.sources import stored_index, work
from tests import test_recurrences
from tests.test_round4 import stored


def shown(rows):
    """Rows as text, so that -0.0 is not 0.0."""
    return sorted(map(repr, map(tuple, rows)))


def test_certified_digits_of_a_gap_of_one_are_minus_zero(spark, tmp_path):
    # Gaps of 1, of a little more and of a little less: -log10 is -0.0, under 0 and over 0.
    items = [(k, 1, 1, 2.0, 2001.0 + g) for k, g in enumerate((1.0, 1.0000002, 0.9999998, 10.0))]
    d = stored(spark, tmp_path, lineitem=(items, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double"), part=([(1, 3)], "p_partkey long, p_size int"))
    assert shown(governed.certified_comparison(spark, d).select("id", "digits").collect()) == ["(0, -0.0)", "(1, -0.0)", "(2, 0.0)", "(3, -1.0)"]


def test_digits_of_a_gap_of_one_to_the_reference_are_minus_zero(spark, tmp_path):
    items = [(k, 1, 1, 2.0, 2 * (900.0 + g)) for k, g in enumerate((1.0, 1.0000002, 0.9999998, 0.0))]
    d = stored(spark, tmp_path, lineitem=(items, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double"), part=([(1, 3, 900.0)], "p_partkey long, p_size int, p_retailprice double"))
    assert shown(lookups.reference_comparison(spark, d).select("id", "digits").collect()) == ["(0, -0.0)", "(1, -0.0)", "(2, 0.0)", "(3, inf)"]


@pytest.mark.parametrize("width,wide,chunk", [(7, 4, 3), (512, 8_192, 4_096)])
def test_streamed_families_have_the_values_sums_and_signs_of_the_tree(spark, monkeypatch, width, wide, chunk):
    for name, value in (("LIST", 0), ("WIDE", wide), ("CHUNK", chunk)):
        monkeypatch.setattr(recurrences, name, value)
    test_recurrences.test_values_sums_and_signs(spark, monkeypatch, width, 5, 3)


def test_equal_points_meet_their_terms_once(spark, monkeypatch):
    monkeypatch.setattr(recurrences, "LIST", 10)
    d, e = np.linspace(-2, 2, 40), np.full(40, 0.5)
    values = np.linalg.eigvalsh(np.diag(d) + np.diag(e[1:], 1) + np.diag(e[1:], -1))
    rows = spark.createDataFrame([(k % 2, k // 2, float(d[k // 2]), 0.5) for k in range(80)], "f long, i long, entry double, beside double")
    points = spark.range(6000).selectExpr("id % 2 AS f", "id", "CASE WHEN id % 2 = 0 THEN id % 5 ELSE id % 30 END / 7.0D AS at")
    seen = []
    lists = recurrences._lists
    monkeypatch.setattr(recurrences, "_lists", lambda placed, size: seen.append(placed.count()) or lists(placed, size))
    got = recurrences.inertia(points, rows, ["f"], "at", "i").collect()
    # The even family has 5 points of its own and goes by the tree, the odd one 15 and is streamed.
    assert len(got) == 6000 and sorted(seen) == [5, 15]
    assert all(r.below == int((values < r.at).sum()) for r in got)


def test_texts_are_a_file_a_row_from_all_tasks_and_not_a_folder_a_row(spark, tmp_path):
    rows = spark.range(40).selectExpr("id AS s", "concat('t', id) AS value")
    work.texts(rows, str(tmp_path / "flat"), "s")
    files = list((tmp_path / "flat").rglob("*.txt"))
    assert sorted(f.read_text() for f in files) == sorted(f"t{k}\n" for k in range(40))
    assert len({f.parent for f in files}) == 1 and len({f.name[:10] for f in files}) == 4
    named = rows.selectExpr("value", "s AS name", "s % 3 AS shard")
    work.texts(named, str(tmp_path / "deep"), "name", "shard", "name")
    assert {f.parent.parent.name for f in (tmp_path / "deep").rglob("*.txt")} == {f"shard={k}" for k in range(3)}


def test_spectra_are_cut_into_gaps(spark, monkeypatch):
    # One group of many gaps is many tasks' work; the values are those of the dense matrix.
    monkeypatch.setattr(roots, "GAPS", 4)
    r = np.random.default_rng(8)
    d, u = np.round(r.normal(size=23), 1), np.where(np.arange(23) % 6 == 0, 0.0, r.normal(size=23))
    rows = [("a", float(x), float(y), 0.7) for x, y in zip(d, u, strict=True)] + [("b", float(x), 0.5, 0.0) for x in d]
    got = roots.rank_one_spectrum(spark.createDataFrame(rows, "m string, d double, u double, alpha double"), "m").collect()
    for m, want in (("a", np.linalg.eigvalsh(np.diag(d) + 0.7 * np.outer(u, u))), ("b", np.sort(d))):
        own = sorted((g.ordinal, g.value) for g in got if g.m == m)
        assert [k for k, _ in own] == list(range(23)) and np.allclose([v for _, v in own], want, atol=1e-9)


def test_a_large_index_has_more_files_than_shuffle_partitions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored_index, "ROWS", 500)
    rows = spark.range(10_000).selectExpr(
        "CAST(id % 50 AS STRING) AS C", "id % 40 AS N", "id % 7 AS P", "id AS ordinal", "'k' AS kind", "'o' AS observable", "CAST(NULL AS STRING) AS outcome", "CAST(id AS STRING) AS value", "'{}' AS record"
    )
    told = spark.createDataFrame([("a", "s", "indexed", None)], "path string, sha256 string, status string, reason string")
    path = f"file://{tmp_path}/index"
    assert stored_index.build(rows, told, path) == 10_000
    sizes = [r.rows for r in spark.read.parquet(f"{path}/files").select("rows").collect()]
    assert len(sizes) >= 16 and max(sizes) < 2_000
    assert sorted(r.N for r in stored_index.query(spark, path, 100_000, C="7")[0].collect()) == sorted(k % 40 for k in range(7, 10_000, 50))


def test_members_are_not_sent_to_the_driver(spark, tmp_path):
    d = stored(spark, tmp_path, part=([(k, f"n{k}", k % 5) for k in range(20)], "p_partkey long, p_name string, p_size int"))
    got = stores.zip_json_store(spark, d)
    assert got.count() == 20 and all(r.intact and r.repeatable for r in got.collect())
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_streamed_sums_are_scaled_only_where_values_leave_their_size(monkeypatch):
    j, x, seen = np.arange(64), np.linspace(-0.9, 0.9, 7), []
    w = np.cos(j)
    add = recurrences.Ranges._add
    monkeypatch.setattr(recurrences.Ranges, "_add", lambda self, *a: seen.append(1) or add(self, *a))
    s = recurrences.Stream(x, False)
    s.take(np.stack([(2 * j + 1) / (j + 1), 0 * j, j / (j + 1), w], axis=1))
    s.add()
    assert len(seen) == 1
    assert np.allclose(s.sums.v[0] * 2.0 ** s.sums.v2, np.polynomial.legendre.legval(x, w), rtol=0, atol=1e-13)


def test_entries_of_a_matrix_are_dealt_out_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(linalg, "ENTRIES", 50)
    parts = spark.range(1000).selectExpr("id % 40 AS i", "id % 25 AS j", "1D AS v")
    m = linalg.assembled(parts)
    assert m.rdd.getNumPartitions() == 20 and sum(r.v for r in m.collect()) == 1000
    vectors = spark.createDataFrame([(t, i, None if i == 3 else float(t + i)) for t in range(3) for i in range(25) if (t, i % 5) != (1, 0)], "task long, i long, v double")
    want = sorted(map(tuple, linalg.batch(m, vectors).collect()))
    side = linalg.batch(m, vectors, [0, 1, 2])
    # An entry is met once, not once a task.
    assert sorted(map(tuple, side.collect())) == want and 0 < len(want) < 3 * 40
    assert side._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [task") == 0


def test_audited_objects_are_dealt_out_by_their_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(linalg, "ENTRIES", 50)
    items = [(k % 3, k, 2.0) for k in range(1000)]
    d = stored(spark, tmp_path, lineitem=(items, "l_suppkey long, l_partkey long, l_quantity double"), supplier=([(k,) for k in range(4)], "s_suppkey long"))
    got = governed.audit_of_shards(spark, d)
    assert "hashpartitioning(shard" in (plan := got._jdf.queryExecution().executedPlan().toString()) and ", 20), REPARTITION_BY_NUM" in plan
    want = [(s, sum(k % 5 > 0 for k in o), 2 * sum(k % 5 > 0 for k in o), sum(k % 7 == 0 and k % 5 > 0 for k in o), sum(k % 5 == 0 and k % 7 > 0 for k in o)) for s in range(4) for o in [range(s, 1000, 3) if s < 3 else []]]
    assert sorted(map(tuple, got.collect())) == want


def test_small_groups_of_a_range_are_opened_in_one_frame(spark, tmp_path, monkeypatch):
    # Frames that are opened, by the rows they hold: a file each.
    monkeypatch.setattr(budget, "RANGE", 64)
    rows = spark.range(640).selectExpr("id DIV 4 AS g", "id", "1 + id % 4 AS cost")
    held, whole = [], budget.written

    def kept(df, label):
        if label == "budget-opened":
            held.append(df._jdf.queryExecution().logical().toString())
        return whole(df, label)

    monkeypatch.setattr(budget, "written", kept)
    got = {(r.g, r.id % 4): r.taken for r in budget.spend(rows, ["g"], ["id"], "cost", 5).collect()}
    assert got == {(g, k): k < 2 for g in range(160) for k in range(4)}
    assert held and all("FlatMapGroupsInPandas [range" in h for h in held)


def test_equal_rows_of_a_batch_are_worked_out_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def told(s, t):
        calls.add(1)
        return s * 2, f"{t}!"

    rows = spark.range(0, 1000, 1, 1).selectExpr("id", "id % 5 AS s", "IF(id % 3 = 0, NULL, 'a') AS t")
    got = rows.select("id", certified.rowwise(told, "struct<a:bigint,b:string>")("s", "t").alias("r")).collect()
    assert all((r.r.a, r.r.b) == (2 * (r.id % 5), "None!" if r.id % 3 == 0 else "a!") for r in got) and calls.value == 10
    signs = spark.createDataFrame([(0.0,), (-0.0,), (1.5,)], "x double").coalesce(1)
    assert shown(signs.select(certified.rowwise(lambda x: str(float(x)), "string")("x")).collect()) == ["('-0.0',)", "('0.0',)", "('1.5',)"]
