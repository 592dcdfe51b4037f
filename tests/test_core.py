"""The engine's own operators: edge rows that SQL comparison does not reach."""

import json
import math
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.functions import exact, numbers
from quillon.operators import aggregates, dag, gates, index, ladders, linalg, ranks, roots
from quillon.plans.reuse import ReuseTable, key_digest
from quillon.sources import store
from quillon.streaming import journal


def test_packets_are_all_or_nothing(spark, tmp_path):
    good = {"kind": "k", "lambda_squared": "12.5", "n_modes": "3", "precision_bits": "64", "values": {"a": "1.50", "b": "x", "tail_3": "1"}, "rows": [{"ordinal": "1", "values": {"c": ".5", "d": "５"}}]}
    for name, packet in {"a": good, "b": good | {"n_modes": "1.5"}, "c": good | {"n_modes": str(2**63)}, "d": good | {"n_modes": str(2**63 - 1)}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(packet))
    (tmp_path / "e.json").write_text("not json [")
    measured, inventory = index.scan_packets(spark, str(tmp_path), ["indexed:tail_"])
    assert {(r.path[-6:-5], r.observable) for r in measured.collect()} == {(f, o) for f in "ad" for o in "ac"}
    assert {(r.path[-6:-5], r.status) for r in inventory.collect()} == {("a", "indexed"), ("b", "failed"), ("c", "failed"), ("d", "indexed"), ("e", "failed")}
    with pytest.raises(ValueError):
        index.allowed(F.col("x"), ["other:p"])


def test_exact_decimals():
    assert [exact.canonical_text(s) for s in ("+00.500", "5.", ".5", "1e400", "-0", "１", " 1", "1_0", None)] == ["5e-1", "5", "5e-1", "1e400", "0", None, None, None, None]
    assert exact.order(exact.parsed("0." + "1" * 60), exact.parsed("0." + "1" * 60 + "1")) == -1
    a, b = exact.Interval("-1", "2"), exact.Interval("1/3", "1/2")
    assert (a * b).lo == Fraction(-1, 2) and a.square().lo == 0 and b.reciprocal().lo == 2 and (a - b).hi == Fraction(5, 3)
    with pytest.raises(ZeroDivisionError):
        a.reciprocal()
    assert exact.polynomial([Fraction(1), Fraction(0), Fraction(2)], Fraction(3)) == 19
    p = [Fraction(c) for c in (-6, 11, -6, 1)]
    assert exact.root_count(p, 0, 4) == 3 and len(exact.isolate(p, 0, 4)) == 3 and exact.root_count(p, Fraction(3, 2), 2) == 1
    assert exact.inertia([[2, 1], [1, 2]]) == (2, 0, 0) and exact.inertia([[2, 1], [1, 2]], 2) == (1, 1, 0) and exact.inertia([[0, 0, 1], [0, 0, 0], [1, 0, 0]]) == (1, 1, 1) and exact.inertia([[2, 1], [1, 2]], Fraction(3, 2)) == (1, 1, 0)


def test_exact_columns(spark):
    df = spark.createDataFrame([("1e-500", "0", ["0.1", "0.2"]), ("0.3", "0.3", ["0.1", "0.2"]), ("x", "1", ["1"])], "a string, b string, t array<string>")
    got = df.select(exact.compare("a", "b").alias("c"), exact.compare_to_sum("b", "t").alias("s"), exact.to_double("a").alias("d"), exact.enclose("a", F.lit(3)).alias("e"), exact.matching_digits("a", "b").alias("m")).collect()
    assert [r.c for r in got] == [1, 0, None] and [r.s for r in got] == [-1, 0, 0] and got[0].d is None and got[1].d == 0.3 and got[1].e.lo == "3e-1"
    assert [r.m for r in got] == [0, 99, None]
    assert spark.range(1).select(exact.from_double(F.lit(0.1))).first()[0].startswith("0.1000000000000000055")


def test_gates_and_windows(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0)], "id int, v double")
    out = {r.id: (r.reasons, r.accepted) for r in gates.gated(df, ("low", F.col("v") < 3), ("odd", F.col("id") % 2 == 1)).collect()}
    assert out == {1: (["low", "odd"], False), 2: ([], True)}
    s = spark.createDataFrame([(1, k, v) for k, v in enumerate([0.0, 1.0, 0.0, -1.0, -2.0, 0.0, 3.0])], "g int, k int, v double")
    assert [(r.lower, r.upper) for r in ladders.sign_crossings(s, ["g"], "k", "v").collect()] == [(1, 3), (4, 6)]
    assert ranks.dense_position(s, "v", "k").orderBy("position").select("position").collect()[-1][0] == 6
    b = ladders.greedy_batches(spark.createDataFrame([(1, k, z) for k, z in enumerate([5, 5, 20, 1, 9])], "g int, k int, z int"), "g", "k", "z", 10).orderBy("k")
    assert [r.batch for r in b.collect()] == [0, 0, 1, 2, 2]


def test_pairwise_is_a_tree(spark):
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 7, 64, 100):
        v = (rng.normal(size=n) * 10.0 ** rng.integers(-8, 8, n)).tolist()
        tree = v or [0.0]
        while len(tree) > 1:
            tree = [tree[i] + (tree[i + 1] if i + 1 < len(tree) else 0.0) for i in range(0, len(tree), 2)]
        df = spark.createDataFrame([(v,)], "v array<double>")
        assert df.select(aggregates.pairwise(F.col("v"))).first()[0] == tree[0]


def test_graphs(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "node string, dep string")
    n = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "node string")
    assert {(r.node, r.level) for r in dag.levels(e, n).collect()} == {("a", 2), ("b", 1), ("c", 0), ("d", 0)}
    assert {(r.node, r.depth) for r in dag.closure(e, spark.createDataFrame([("a",)], "root string")).collect()} == {("a", 0), ("b", 1), ("c", 1)}
    with pytest.raises(ValueError):
        dag.levels(e.union(spark.createDataFrame([("c", "a")], "node string, dep string")), n)


def test_spectra(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(12, 12))
    a = a + a.T
    assert np.allclose(linalg.jacobi(a)[0], np.linalg.eigvalsh(a))
    assert np.allclose(linalg.lanczos(a, 12), np.linalg.eigvalsh(a))
    w = np.linalg.eigvalsh(a)
    value, _, residual, outcome = linalg.inverse_iteration(a, w[3] + 1e-4)
    assert abs(value - w[3]) < 1e-10 and outcome == "converged"
    b = a @ a.T + np.eye(12)
    assert np.allclose(linalg.generalized(a, b), np.sort(np.linalg.eigvals(np.linalg.solve(b, a)).real))
    d, u = np.array([0.0, 1.0, 1.0, 2.0]), np.array([0.5, 1.0, 0.5, 0.0])
    for alpha in (0.7, -0.7):
        df = spark.createDataFrame([(1, float(x), float(y), alpha) for x, y in zip(d, u)], "m int, d double, u double, alpha double")
        got = [r.value for r in roots.rank_one_spectrum(df, "m").orderBy("ordinal").collect()]
        assert np.allclose(got, np.linalg.eigvalsh(np.diag(d) + alpha * np.outer(u, u)))
    assert abs(roots.newton(lambda x: x**3 - 2, lambda x: 3 * x * x, 0.0, 2.0)[0] - 2 ** (1 / 3)) < 1e-12
    assert roots.newton(lambda x: x * x + 1, lambda x: 2 * x, 0.0, 1.0)[1] == "no_sign_change"
    assert spark.range(1).select(numbers.sturm_count(F.array(F.lit(2.0), F.lit(2.0)), F.array(F.lit(-1.0)), F.lit(2.0))).first()[0] == 1


def test_simplex_forms_checks_every_index(spark, monkeypatch):
    from quillon.catalogue import analysis

    # The query returns every moment now, each with its gap to the other route.
    assert [r.gap for r in analysis.simplex_forms(spark, "").collect()] == [0] * 35
    right = analysis.forms.simplex_moments
    monkeypatch.setattr(analysis.forms, "simplex_moments", lambda df: right(df).withColumn("moment", F.when(F.col("degree") == 0, F.col("moment")).otherwise(0.5)))
    assert sum(r.gap > 0 for r in analysis.simplex_forms(spark, "").collect()) == 34


def test_store_and_reuse(spark, tmp_path):
    objects = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "k int, p string")
    first = store.put(spark, str(tmp_path / "s"), objects, "k", "p")
    assert first.filter("fresh").count() == 3
    assert store.put(spark, str(tmp_path / "s"), objects, "k", "p").filter("fresh").count() == 0
    assert store.fetch(spark, str(tmp_path / "s"), first).filter("intact").count() == 2
    assert [(r.seq, r.length) for r in store.parts(spark.createDataFrame([("d", 25)], "digest string, bytes long"), part=10).collect()] == [(0, 10), (1, 10), (2, 5)]
    a = spark.createDataFrame([("x", 1, "d"), ("y", 2, "e")], "path string, bytes long, digest string")
    b = spark.createDataFrame([("x", 1, "f"), ("z", 2, "e")], "path string, bytes long, digest string")
    assert {(r.path, r.problem) for r in store.verify(a, b).collect()} == {("x", "digest"), ("y", "missing"), ("z", "unexpected")}
    t = ReuseTable(spark, str(tmp_path / "r"), "long")
    asked = spark.range(5).withColumn("digest", key_digest(F.col("id")))
    run = lambda df: df.select("digest", (F.col("id") * 2).alias("value"))
    assert t.resolve(asked.limit(3), run).filter("disposition = 'computed'").count() == 3
    assert t.resolve(asked, run).filter("disposition = 'reused'").count() == 3
    assert t.resolve(asked, run, "verify").filter("disposition = 'verified'").count() == 5
    with pytest.raises(LookupError):
        t.resolve(spark.range(9).withColumn("digest", key_digest(F.col("id"))), run, "require_reuse")


def test_journal_stream(spark, tmp_path):
    events = [{"schema_version": 1, "tx": "t", "seq": k, "phase": p, "elapsed_seconds": 1.0, "at": f"2024-01-01T00:0{k}:00"} for k, p in enumerate(["planned", "staged", "uploaded"])]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text("\n".join(map(json.dumps, [*events, events[1]])) + "\nbad line\n")
    good, bad = journal.read_events(spark, str(tmp_path / "in"))
    journal.journal(good, str(tmp_path / "j"), str(tmp_path / "c")).awaitTermination()
    assert [tuple(r) for r in journal.states(spark, str(tmp_path / "j")).collect()] == [("t", "uploaded", "indexed", 3)]
    q = journal.phase_windows(good).writeStream.outputMode("complete").format("memory").queryName("phases").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(r.calls for r in spark.table("phases").collect()) == 4
    q = bad.writeStream.format("memory").queryName("bad").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.value for r in spark.table("bad").collect()] == ["bad line"]


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
    assert isinstance(pd.DataFrame(), pd.DataFrame)


def test_positions_are_dense_whatever_else_a_row_holds(spark):
    from pyspark.sql import functions as F

    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet").select("l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_suppkey")
        got = ranks.dense_position(rows, "l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").select("position", "l_quantity")
        n = rows.count()
        assert got.agg(F.count_distinct("position"), F.min("position"), F.max("position")).first() == (n, 0, n - 1)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_chains_tell_cycles_and_depth(spark):
    spark.range(0, 101).selectExpr("id AS node", "id + 1 AS next").createOrReplaceTempView("t_line")
    got = dag.chain(spark, "SELECT * FROM t_line", "SELECT 0L AS start").collect()
    assert [r.problem for r in got if r.problem] == ["too deep"] and max(r.step for r in got) == 65
    spark.range(0, 3).selectExpr("id AS node", "(id + 1) % 3 AS next").createOrReplaceTempView("t_ring")
    got = dag.chain(spark, "SELECT * FROM t_ring", "SELECT 0L AS start").collect()
    assert sorted((r.step, r.node, r.problem) for r in got if r.problem) == [(3, 0, "cycle")] and len(got) == 4


def test_plans_spend_a_budget_in_dependency_order(spark):
    nodes = spark.createDataFrame([(n,) for n in "abcdef"], "node string")
    edges = spark.createDataFrame([("c", "a"), ("d", "b"), ("e", "c"), ("f", "d")], "node string, dep string")
    candidates = spark.createDataFrame([("a", 1, 9), ("a", 2, 3), ("b", 1, 50), ("c", 1, 4), ("d", 1, 1), ("f", 1, 1)], "node string, candidate int, cost long")
    got = {r.node: (r.level, r.candidate, r.status) for r in dag.planned(nodes, edges, candidates, [F.col("cost")], 10).collect()}
    assert got == {"a": (0, 2, "planned"), "b": (0, 1, "over_budget"), "c": (1, 1, "planned"), "d": (1, 1, "blocked"), "e": (2, None, "no_candidate"), "f": (2, 1, "blocked")}


def test_resolution_tells_its_limits(spark):
    line = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(70)] + [("wide", f"n{60 + k}") for k in range(9)], "node string, dep string")
    known = spark.createDataFrame([(f"n{k}",) for k in range(70)] + [("wide",)], "node string")
    roots = spark.createDataFrame([("n0",), ("n69",), ("n68",), ("wide",), ("n65",)], "root string")
    got = {r.root: (r.nodes, r.depth, r.outcome) for r in dag.resolved(roots, line, known, 8, 9).collect()}
    assert got == {"n0": (10, 9, "too_deep"), "n69": (2, 1, "missing"), "n68": (3, 2, "missing"), "wide": (12, 3, "too_many"), "n65": (6, 5, "missing")}


def test_invalid_hypotheses_are_refused(spark):
    from quillon.operators import governance

    case = "case_id int, partition string, prediction double, tolerance double"
    good = spark.createDataFrame([(1, "train", 1.0, 0.1)], case)
    assert len(governance.freeze(good, ["train"]).first().digest) == 64
    for bad in ([(1, "train", 1.0, 0.1), (1, "train", 2.0, 0.1)], [(1, "other", 1.0, 0.1)], [(1, "train", None, 0.1)], [(1, "train", 1.0, -1.0)]):
        with pytest.raises(Exception, match="not a valid case"):
            governance.freeze(spark.createDataFrame(bad, case), ["train"]).collect()


def test_limits_and_memo(spark):
    import time

    from quillon.plans import capture, limits

    assert limits.limited(spark, lambda token: spark.range(10).count(), 60) == 10
    with pytest.raises(limits.Cancelled):
        limits.limited(spark, lambda token: (time.sleep(0.5), token.check()), 0.1)
    bytes_ = limits.Reservations(100)
    with bytes_.reserved(80):
        assert not bytes_.try_reserve(30) and bytes_.try_reserve(20)
        with pytest.raises(TimeoutError):
            with bytes_.reserved(10, 0.05):
                pass
    with pytest.raises(MemoryError):
        with bytes_.reserved(101):
            pass
    memo, calls = capture.Memo(), []
    assert [memo.get("k", int, lambda: calls.append(1) or 7) for _ in range(2)] == [7, 7] and len(calls) == 1
    with pytest.raises(TypeError):
        memo.get("x", int, lambda: "no")


class PluginStore:
    """A store that a data source reads."""

    def keys(self):
        return [f"k{n}" for n in range(5)]

    def read(self, key):
        return key.encode() * 2


def test_plugins_and_command_line(spark, tmp_path):
    import io

    from quillon import __main__ as cli
    from quillon import plugins

    known = plugins.Registry()
    known.add(plugins.RealFunction("f", lambda x: x))
    with pytest.raises(ValueError):
        known.add(plugins.RealFunction("f", lambda x: x))
    assert known.names(plugins.RealFunction) == ["f"]
    with pytest.raises(PermissionError):
        plugins.Evaluator("e", lambda u: u).column(F.lit(1.0), False)
    with pytest.raises(Exception, match="finite"):
        spark.range(3).select(plugins.Evaluator("e", lambda u: u / 0).column(F.col("id").cast("double"), True)).collect()
    reader = plugins.StoreReader({"factory": f"{PluginStore.__module__}:PluginStore", "partitions": "2"})
    assert sorted(row for p in reader.partitions() for row in reader.read(p)) == [(f"k{n}", f"k{n}k{n}".encode()) for n in range(5)]
    (tmp_path / "r.json").write_text(json.dumps({"name": "family_kinds", "input": "/root/testdata/sf0.001"}))
    out = io.StringIO()
    assert cli.main(["query", str(tmp_path / "r.json")], spark, out) == 0
    assert [json.loads(x) for x in out.getvalue().splitlines()] == [r.asDict() for r in spark.read.parquet("/root/testdata/sf0.001/part.parquet").filter("p_type LIKE 'ECO%'").select(F.col("p_type").alias("kind")).distinct().collect()]


def test_bare_packets_are_maps_of_retained_fields(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"kind": "k", "lambda_squared": "2", "n_modes": "3", "precision_bits": "64", "ground": "1.5", "note": "x"}))
    measured, _ = index.scan_packets(spark, str(tmp_path))
    assert [(r.observable, r.value) for r in measured.collect()] == [("ground", "1.5")]
    for text in ("", "# nothing", "prefix:a\nprefix:a", "other:b"):
        with pytest.raises(ValueError):
            index.policy(text)
    assert index.policy("prefix:a\nindexed:b") == ["prefix:a", "indexed:b"]


def test_screw_function(spark):
    from quillon.functions import analytic
    from quillon.operators import transforms

    assert str(analytic.euler(30)).startswith("0.577215664901532860606512090082")
    assert str(analytic.catalan(30)).startswith("0.915965594177219015054603514932")
    near = [analytic.screw_smooth(Decimal(t), 30) for t in ("0.5", "0.5000000000000000000000000001")]  # quadrature, series
    assert abs(near[0] - near[1]) < Decimal("1e-27") and analytic.screw_smooth(Decimal(0), 30) == 0
    points = [(1, 1.5), (2, -1.5), (3, 0.0), (4, None), (5, float("nan")), (6, 2.5), (7, 1.5), (8, 1e-9)]
    got = {r.k: r.g for r in transforms.screw(spark.createDataFrame(points, "k int, t double"), "k", "t", 2.0).collect()}
    prime = lambda t: sum(math.log(p) / math.sqrt(n) * (t - math.log(n)) for n, p in ((2, 2), (3, 3), (4, 2), (5, 5), (7, 7)) if math.log(n) <= t)
    assert abs(got[1] - (float(analytic.screw_smooth(Decimal("1.5"), 20)) + prime(1.5))) < 1e-12
    assert got[1] == got[2] == got[7] and got[3] == 0 and got[4] is None and got[5] is None and got[6] is None
    assert got[8] < 0 and abs(got[8]) < 1e-7


def test_census_and_sector_gap():
    from quillon.functions import certified

    assert certified.census([0, 0], 0, 1, []) == (None, None, 0, 0, "", "refused") and certified.census([1, 1], 1, 1, [])[-1] == "refused"
    assert certified.census([0, 0, -1, 1], 0, 1, []) == (0, 0, 2, 1, "", "counted")  # x^2 (x - 1)
    assert certified.census([-2, 0, 1], -2, 2, [0, 9]) == (2, 2, 0, 0, "", "counted")
    assert certified.census([4, 0, -4, 0, 1], 0, 2, [])[-1] == "multiple_root"  # (x^2 - 2)^2
    r = np.random.default_rng(3)
    for n in (1, 2, 3) * 5:
        m = r.integers(-9, 9, (2 * n + 1, 2 * n + 1))
        m = m + m.T
        m = m + m[::-1, ::-1]
        values, vectors = np.linalg.eigh(m.astype(float))
        if np.diff(values).min() < 1e-3:
            continue
        even = values[np.abs(vectors - vectors[::-1]).max(0) < 1e-6]
        odd = values[np.abs(vectors + vectors[::-1]).max(0) < 1e-6]
        box = lambda x: (Fraction(x - 1e-6), Fraction(x + 1e-6))
        status, parity, gap = certified.sector_gap(m.tolist(), box(even[0]), box(even[1]), box(odd[0]))
        assert (status, parity) == ("replayed", "even" if even[0] < odd[0] else "odd")
        assert (gap is None) == (parity == "odd") and (gap is None or abs(float(Fraction(gap)) - (min(even[1], odd[0]) - even[0])) < 1e-5)
        assert certified.sector_gap(m.tolist(), box(even[1]), box(even[1]), box(odd[0]))[0] == "even_ground"
    assert certified.sector_gap([[1, 2], [2, 1]], (0, 1), (0, 1), (0, 1))[0] == "refused"
    assert certified.sector_gap([[1, 0, 0], [0, 1, 0], [0, 0, 2]], (0, 1), (0, 1), (0, 1))[0] == "not_symmetric"
