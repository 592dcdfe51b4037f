"""What the review of the fourth round found: small cases that failed before."""

import numpy as np
from pyspark.sql import functions as F

from quillon.catalogue import domain, governed
from quillon.operators import linalg
from quillon.sources import packets
from tests.test_round4 import stored


def test_packets_are_judged_without_a_schema_of_all_they_hold(spark):
    rows = '{"ordinal":1,"values":{"a":"1"},"outcome":"x"}'
    texts = [
        '{"report":{"data":{"n_modes":1,"rows":[' + rows + ',7]}}}', '{"data":{"rows":{}, "b":"2"}}', '{"rows":[],"c":"3"}', '{"rows":null,"c":"3"}', '{"rows":[{"values":[]}]}',
        '{"report":"x"}', '{"report":null}', '{"report":{"data":[1]}}', '[1]', '{"manifest":[],"c":"3"}', '{"manifest":{"key":1},"c":"3"}', '{"values":null,"rows":[' + rows + ']}',
    ]
    files = spark.createDataFrame([(str(k), t.encode(), "") for k, t in enumerate(texts)], "path string, content binary, sha256 string")
    judged = packets.parsed(files)
    kind = "a part is of another kind"
    got = {int(r["path"]): (r["reason"], r["n"]) for r in judged.selectExpr("path", "reason", "size(found) AS n").collect()}
    assert [got[k] for k in range(len(texts))] == [
        (None, 1), (None, 1), (None, 1), (kind, 1), (kind, 0), (kind, 0), (kind, 0), ("no measurement", 0), ("not an object", 0), (kind, 1), (kind, 1), (kind, 1),
    ]
    plan = judged._jdf.queryExecution().analyzed().toString()
    assert not any(f"schema_of_variant({c}#" in plan for c in ("packet", "report", "data"))


def test_like_rows_are_folded_and_others_are_kept(spark):
    rng = np.random.default_rng(3)
    whole = rng.integers(-3, 4, (7, 7)).astype(float)
    u, d = np.array([1.0, 2, 1, 1, 2, 3, 1]), np.array([5.0, 4, 5, 6, 4, 4, 5])
    # Equal values in another order, and a permuted pair, look alike but are not.
    twisted = np.array([[1.0, 2, 3, 4], [2, 1, 4, 3], [3, 4, 1, 2], [4, 3, 2, 1]])
    cases = [whole + whole.T, np.outer(u, u) + np.diag(d), np.ones((5, 5)), np.eye(4), twisted, np.array([[2.0]])]
    rows = [(k, i, j, float(a[i, j])) for k, a in enumerate(cases) for i in range(len(a)) for j in range(len(a))]
    got = linalg.folded_eigenvalues(spark.createDataFrame(rows, "matrix_id int, i long, j long, v double")).orderBy("matrix_id", "ordinal").collect()
    for k, a in enumerate(cases):
        own = [r for r in got if r["matrix_id"] == k]
        assert [r["ordinal"] for r in own] == list(range(len(a)))
        assert np.allclose([r["value"] for r in own], np.linalg.eigvalsh(a), atol=1e-9)


def test_a_dense_matrix_of_like_rows_is_no_group_of_all_its_entries(spark, tmp_path, monkeypatch):
    most, of = [], linalg.eigenvalues
    monkeypatch.setattr(linalg, "eigenvalues", lambda m, by="matrix_id": most.append(m.groupBy(by).count().agg(F.max("count")).first()[0]) or of(m, by))
    d = stored(spark, tmp_path, supplier=([(k, k % 2) for k in range(600)], "s_suppkey long, s_nationkey int"))
    got = sorted(map(tuple, domain.independent_routes(spark, d).collect()))
    assert got == [(0, 300, "agree"), (1, 300, "agree")] and most == [60 * 60]


def test_values_too_large_for_a_step_of_one_are_not_certified_from_a_quantity_of_30_on(spark, tmp_path):
    items = [(k, 1, 1, q, x) for k, (q, x) in enumerate([(40.0, 1e17), (40.0, float("nan")), (40.0, float("inf")), (40.0, 900.0), (2.0, 2011.0)])]
    d = stored(spark, tmp_path, lineitem=(items, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double"), part=([(1, 3)], "p_partkey long, p_size int"))
    got = sorted(map(tuple, governed.certified_comparison(spark, d).select("id", "digits", "inside").collect()))
    assert got == [(0, None, None), (1, None, None), (2, None, None), (3, None, None), (4, -1.0, True)]
