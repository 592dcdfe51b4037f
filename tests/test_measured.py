"""Nested packets and the stored index on rows that SQL does not reach."""

import json

import pytest
from pyspark.sql import functions as F

from quillon.operators import index
from quillon.sources import packets, stored_index


def test_policy_refuses_all_but_rules():
    assert index.policy("prefix:a\nindexed:b_1") == ["prefix:a", "indexed:b_1"]
    for text in ("", "prefix:a\n\nindexed:b", "# why\nprefix:a", "prefix:a # why", "prefix:", "prefix", "other:a", "prefix:a-b", "prefix:a\nprefix:a", " prefix:a"):
        with pytest.raises(ValueError):
            index.policy(text)


DATA = {"lambda_squared": "12.5", "n_modes": 3, "precision_bits": 64, "values": {"a": "1.50", "b": "x", "tail_3": "1", "n": 4, "t": True}, "rows": [{"ordinal": 1, "label": "l", "values": {"c": ".5", "d": "５"}, "notes": ["n"]}, "skip", 7]}
CASES = {
    "flat": (DATA | {"kind": "k"}, None),
    "nested": ({"report": {"kind": "k", "data": DATA}, "manifest": {"key": {"kind": "m"}, "content_digest": "d1"}}, None),
    "by_manifest": ({"report": {"data": DATA}, "manifest": {"key": {"kind": "m"}}, "artifact_digest": "d2"}, None),
    "unclassified": (DATA | {"source_precision_bits": 7, "manifest": {}}, None),
    "source_manifest": ({"report": {"data": DATA | {"outcome": "done", "source": {"s": 1}}}, "source_manifest": {"content_digest": "d3"}}, None),
    "bare": ({"report": {"data": {"lambda_squared": "2", "ground": "-1e5", "note": "x", "values": {}}}}, None),
    "null_wide": (DATA | {"n_modes": None, "precision_bits": None, "lambda_squared": None}, None),
    "edge": (DATA | {"n_modes": 2**63 - 1}, None),
    "too_wide": (DATA | {"n_modes": 2**63}, "N is not a whole number"),
    "negative": (DATA | {"n_modes": -1}, "N is not a whole number"),
    "flag": (DATA | {"n_modes": True}, "N is not a whole number"),
    "text_n": (DATA | {"n_modes": "3"}, "N is not a whole number"),
    "half": (DATA | {"precision_bits": 1.5}, "P is not a whole number"),
    "ordinal": (DATA | {"rows": [{"ordinal": 1, "values": {"c": "1"}}, {"ordinal": "2", "values": {"c": "1"}}]}, "an ordinal is not a whole number"),
    "unread_ordinal": (DATA | {"rows": [{"ordinal": "2", "values": {"c": "text"}}]}, None),
    "c": (DATA | {"lambda_squared": 12}, "C is not text"),
    "kind": (DATA | {"kind": 1}, "kind is not text"),
    "outcome": (DATA | {"rows": [{"outcome": 3, "values": {"c": "1"}}]}, "an outcome is not text"),
    "list": ([DATA], "not an object"),
    "no_rows": ({"report": {"data": {"values": {"a": "x"}, "n_modes": "free"}}}, "no measurement"),
    "data_list": ({"report": {"data": []}}, "no measurement"),
    "report_list": ({"report": []}, "a part is of another kind"),
    "manifest_null": (DATA | {"manifest": None}, "a part is of another kind"),
    "values_null": (DATA | {"values": None}, "a part is of another kind"),
    "row_values": (DATA | {"rows": [{"values": ["1"]}]}, "a part is of another kind"),
    "rows_number": (DATA | {"rows": 3}, "a part is of another kind"),
}


def test_nested_packets(spark, tmp_path):
    for name, (packet, _) in CASES.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(packet))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "deep.json").write_text(json.dumps(DATA))
    (tmp_path / "broken.json").write_text("{")
    (tmp_path / "bytes.json").write_bytes(b'{"a": "\xff"}')
    (tmp_path / "large.json").write_text(json.dumps(DATA | {"pad": "x" * 5000}))
    (tmp_path / "other.txt").write_text(json.dumps(DATA))
    rows, told = packets.scan(spark, str(tmp_path), ["indexed:tail_"], 4000)
    got = {r.path.rsplit("/", 1)[1][:-5]: (r.status, r.reason, r.sha256 is not None) for r in told.collect()}
    want = {name: ("unassessed" if reason else "indexed", reason, True) for name, (_, reason) in CASES.items()}
    assert got == want | {"deep": ("indexed", None, True), "broken": ("unassessed", "not JSON", True), "bytes": ("unassessed", "not JSON", True), "large": ("unassessed", "over the byte limit", False)}
    rows = [r.asDict() | {"r": json.loads(r.record)} for r in rows.collect()]
    by = lambda name: {x["observable"]: x for x in rows if x["r"]["packet"].endswith(f"/{name}.json")}
    flat = by("flat")
    assert set(flat) == {"a", "c"} and flat["a"]["value"] == "1.50" and flat["a"]["ordinal"] is None and flat["c"]["ordinal"] == 1
    assert (flat["a"]["C"], flat["a"]["N"], flat["a"]["P"], flat["a"]["kind"], flat["a"]["outcome"]) == ("12.5", 3, 64, "k", "unassessed")
    assert flat["c"]["r"]["ordinal_scope"] == "l" and flat["c"]["r"]["notes"] == ["n"] and flat["a"]["r"]["ordinal_scope"] == "aggregate" and flat["a"]["r"]["sources"] == []
    assert by("nested")["a"]["kind"] == "k" and by("nested")["a"]["r"]["artifact_digest"] == "d1"
    assert by("by_manifest")["a"]["kind"] == "m"
    assert by("unclassified")["a"]["kind"] == "unclassified" and by("unclassified")["a"]["P"] == 7
    named = by("source_manifest")
    assert named["c"]["outcome"] == "done" and named["a"]["r"]["artifact_digest"] == "d3" and named["a"]["r"]["sources"] == {"s": 1}
    assert {k: v["r"]["ordinal_scope"] for k, v in by("bare").items()} == {"lambda_squared": "retained_field", "ground": "retained_field"}
    assert by("null_wide")["a"]["N"] is None and by("edge")["a"]["N"] == 2**63 - 1
    with pytest.raises(ValueError):
        packets.scan(spark, str(tmp_path), [], 0)


def test_the_stored_index_skips_files_and_loses_nothing(spark, tmp_path):
    rows = spark.range(20_000).select(
        (F.col("id") % 50).cast("string").alias("C"), (F.col("id") % 40).alias("N"), F.when(F.col("id") % 9 > 0, F.col("id") % 7).alias("P"), F.col("id").alias("ordinal"),
        F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("kind"), F.concat(F.lit("o"), (F.col("id") % 3)).alias("observable"),
        F.lit(None).cast("string").alias("outcome"), F.col("id").cast("string").alias("value"), F.lit("{}").alias("record"),
    )
    told = spark.createDataFrame([("b", None, "unassessed", "why"), ("a", "s", "indexed", None)], "path string, sha256 string, status string, reason string")
    path = f"file://{tmp_path}/index"
    assert stored_index.build(rows, told, path, 64) == 20_000
    for equal in ({"C": "7"}, {"N": 7}, {"C": "7", "N": 17, "P": 3}, {"P": 6, "observable": "o1"}, {"ordinal": 777}, {"C": "absent"}, {"N": -1}, {}, {"outcome": "none"}):
        got, skipped = stored_index.query(spark, path, 100_000, **equal)
        want = rows
        for k, v in equal.items():
            want = want.filter(F.col(k) == v)
        assert sorted(r.ordinal for r in got.collect()) == sorted(r.ordinal for r in want.collect())
        assert skipped.files == skipped.by_range + skipped.by_filter + skipped.opened
    assert stored_index.query(spark, path, 10, ordinal=777)[1].opened <= 4
    assert stored_index.query(spark, path, 10, C="7")[1].opened < 64 / 2
    assert stored_index.query(spark, path, 10, C="25x")[1].by_filter > 0
    assert [r.path for r in stored_index.inventory(spark, path).collect()] == ["a", "b"]
    first = stored_index.query(spark, path, 3, kind="odd")[0].collect()
    assert [(r.C, r.N, r.P, r.ordinal) for r in first] == [(r.C, r.N, r.P, r.ordinal) for r in rows.filter("kind = 'odd'").orderBy("C", "N", "P", "ordinal", "observable").limit(3).collect()]
    with pytest.raises(ValueError, match="unknown"):
        stored_index.query(spark, path, 3, colour="red")
    with pytest.raises(ValueError, match="not completed"):
        stored_index.query(spark, f"{path}/rows", 3)
    with pytest.raises(Exception, match="exists"):
        stored_index.build(rows, told, path)
    empty = f"file://{tmp_path}/empty"
    assert stored_index.build(rows.limit(0), told, empty) == 0
    assert stored_index.query(spark, empty, 3, C="7")[0].collect() == []
