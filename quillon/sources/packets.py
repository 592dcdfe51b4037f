"""Report packets: nested JSON documents of exact decimals, flattened to measurements and an inventory.

A packet is an object. Its report is its field ``report`` or the packet itself, and the report's data is its field ``data`` or the
report itself. Data holds a map of values, rows with maps of their own, or, with neither, is a map of values itself. Every text
that is a decimal and whose name the field policy lets through is a measurement; numbers, flags and other texts are not.

A file is read by one task and judged as a whole, inside its row: nothing is shuffled. Its length is known before its
content is read, so files over the limit are never opened.

Defined cases: a file that is not an object in UTF-8 JSON (or names a field twice), one with a report, manifest, values or rows of another kind
than an object or a list, and one where a measurement's N, P or ordinal is no whole number from 0 to 2**63 - 1, or its C, kind or outcome no
text, gives no measurement and says why; missing fields are null; a file without any measurement is unassessed too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import DECIMAL, allowed

KINDS = {"text": "STRING", "whole": "BIGINT"}
#: What a row of a list may hold; a row that is no object is null.
ROWS = "array<struct<ordinal:variant,label:variant,values:variant,outcome:variant,notes:variant>>"

MEASURED = ["C", "N", "P", "ordinal", "kind", "observable", "outcome", "value", "record"]


def _get(v: Column, field: str) -> Column:
    return F.try_variant_get(v, f"$.{field}", "variant")


def _object(v: Column, at: str = "$") -> Column:
    """Whether there is an object at a path. A struct without fields tells it: nothing below is copied or walked through."""
    return F.try_variant_get(v, at, "struct<>").isNotNull()


def _list(v: Column, at: str = "$") -> Column:
    """Whether there is a list at a path; one with a first entry is told by that alone."""
    return F.try_variant_get(v, f"{at}[0]", "variant").isNotNull() | F.try_variant_get(v, at, "array<variant>").isNotNull()


def _is(v: Column, kind: str) -> Column:
    """Whether a variant is there and of a plain kind; false for none."""
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit(KINDS[kind])), F.lit(False))


def _has(v: Column, field: str) -> Column:
    """Whether an object has a field, of JSON's null too."""
    return _object(v, f"$.{field}") | _get(v, field).isNotNull()


def _default(v: Column, field: str, other: Column) -> Column:
    return F.coalesce(_get(v, field), other)


def _null(v: Column) -> Column:
    return v.isNull() | F.coalesce(F.is_variant_null(v), F.lit(False))


def _empty(v: Column) -> Column:
    """What counts as nothing: none, null, and an empty object, list or text. A list with a first entry is not written out."""
    return _null(v) | F.try_variant_get(v, "$[0]", "variant").isNull() & F.coalesce(F.to_json(v).isin("{}", "[]", '""', "0", "false"), F.lit(False))


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def read_files(spark: SparkSession, paths: str | list[str], most_bytes: int, glob: str) -> DataFrame:
    """(path, bytes, content, sha256) of the files under folders; content and digest are null beyond most_bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(paths)
    small = files.filter(F.col("length") <= most_bytes).select("path", F.col("length").alias("bytes"), "content", F.sha2("content", 256).alias("sha256"))
    large = files.filter(F.col("length") > most_bytes).select("path", F.col("length").alias("bytes"), F.lit(None).cast("binary").alias("content"), F.lit(None).cast("string").alias("sha256"))
    return small.unionAll(large)


def parsed(files: DataFrame, rules: list[str] = ()) -> DataFrame:
    """(path, sha256, reason, measured array) of files (path, content, sha256)."""
    out = files.withColumn("packet", F.try_parse_json(F.try_validate_utf8(F.col("content").cast("string"))))
    p = F.col("packet")
    out = out.withColumn("inner", _has(p, "report"))
    # The report is read by its paths, so that of all the packet holds only the data are copied, once.
    reported = lambda field: F.when(F.col("inner"), _get(p, f"report.{field}")).otherwise(_get(p, field))
    out = out.withColumn("data", F.coalesce(reported("data"), F.when(F.col("inner"), _get(p, "report")).otherwise(p)))
    data = F.col("data")
    named = ~_has(p, "manifest") | _object(p, "$.manifest")
    key = _get(_get(p, "manifest"), "key")
    kind = F.coalesce(reported("kind"), F.coalesce(_get(key, "kind"), F.parse_json(F.lit('"unclassified"'))))
    manifest = F.when(~_empty(_get(p, "manifest")), _get(p, "manifest")).otherwise(_get(p, "source_manifest"))
    base = F.coalesce(_default(data, "outcome", F.parse_json(F.lit('"unassessed"'))), F.parse_json(F.lit("null")))
    out = out.withColumns({
        "C": _get(data, "lambda_squared"), "N": _get(data, "n_modes"),
        "P": _default(data, "source_precision_bits", _get(data, "precision_bits")), "kind": kind,
        "artifact_digest": _default(manifest, "content_digest", _get(p, "artifact_digest")),
        "sources": F.when(~_empty(_get(data, "source")), _get(data, "source")).otherwise(F.coalesce(reported("source_dependencies"), F.parse_json(F.lit("[]")))),
        "base": base, "convention": _default(data, "convention", _default(data, "ordinal_scope", F.parse_json(F.lit('"see source report"')))),
        "values": F.coalesce(_default(data, "values", F.parse_json(F.lit("{}"))), F.parse_json(F.lit("null"))),
        "named": named,
    })
    # The maps of values: (ordinal, scope, values, outcome, notes).
    empty_list = F.parse_json(F.lit("[]"))
    part = lambda ordinal, scope, values, outcome, notes: F.struct(
        ordinal.alias("ordinal"), scope.alias("scope"), values.alias("values"), outcome.alias("outcome"), notes.alias("notes")
    )
    none = F.lit(None).cast("variant")
    aggregate = F.array(part(none, F.parse_json(F.lit('"aggregate"')), F.col("values"), F.col("base"), empty_list))
    listed = F.filter(F.coalesce(F.try_variant_get(data, "$.rows", ROWS), F.array().cast(ROWS)), lambda r: r.isNotNull())
    rowed = F.transform(listed, lambda r: part(
        r["ordinal"], F.coalesce(r["label"], F.parse_json(F.lit('"row"'))), F.coalesce(r["values"], F.parse_json(F.lit("{}"))),
        F.coalesce(r["outcome"], F.col("base")), F.coalesce(r["notes"], empty_list),
    ))
    bare = F.when(F.try_variant_get(data, "$.rows[0]", "variant").isNull() & _empty(_get(data, "values")) & _empty(_get(data, "rows")), F.array(part(none, F.parse_json(F.lit('"retained_field"')), data, F.col("base"), empty_list))).otherwise(
        F.array().cast("array<struct<ordinal:variant,scope:variant,values:variant,outcome:variant,notes:variant>>")
    )
    out = out.withColumn("maps", F.concat(aggregate, rowed, bare))
    keep = lambda e: allowed(e["key"], list(rules)) & _is(e["value"], "text") & F.coalesce(F.regexp_like(_text(e["value"]), F.lit(DECIMAL)), F.lit(False))
    entries = lambda m: F.filter(F.map_entries(F.coalesce(F.try_variant_get(m["values"], "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))), keep)
    found = F.flatten(F.transform("maps", lambda m: F.transform(entries(m), lambda e: F.struct(
        m["ordinal"].alias("ordinal"), m["scope"].alias("scope"), m["outcome"].alias("outcome"), m["notes"].alias("notes"), e["key"].alias("observable"), _text(e["value"]).alias("value"),
    ))))
    out = out.withColumn("found", F.when(_object(data), found).otherwise(F.array().cast("array<struct<ordinal:variant,scope:variant,outcome:variant,notes:variant,observable:string,value:string>>")))
    whole = lambda v: _null(v) | (_is(v, "whole") & F.coalesce(F.try_variant_get(v, "$", "bigint") >= 0, F.lit(False)))
    text = lambda v: _null(v) | _is(v, "text")
    some = F.size("found") > 0
    rows_fit = _list(data, "$.rows") | _object(data, "$.rows") | _get(data, "rows").isNull() | _is(_get(data, "rows"), "text")
    shaped = (
        F.when(F.col("inner"), _object(p, "$.report")).otherwise(_object(p)) & F.col("named") & (~_has(p, "manifest.key") | _object(p, "$.manifest.key"))
        & (~_object(data) | (F.forall("maps", lambda m: _object(m["values"])) & rows_fit))
    )
    reason = (
        F.when(F.col("content").isNull(), "over the byte limit").when(p.isNull(), "not JSON").when(~_object(p), "not an object")
        .when(~F.coalesce(shaped, F.lit(False)), "a part is of another kind")
        .when(some & ~whole(F.col("N")), "N is not a whole number").when(some & ~whole(F.col("P")), "P is not a whole number")
        .when(F.exists("found", lambda f: ~whole(f["ordinal"])), "an ordinal is not a whole number")
        .when(some & ~text(F.col("C")), "C is not text").when(some & ~text(F.col("kind")), "kind is not text")
        .when(F.exists("found", lambda f: ~text(f["outcome"])), "an outcome is not text").when(~some, "no measurement")
    )
    return out.withColumn("reason", reason)


def scan(spark: SparkSession, paths: str | list[str], rules: list[str] = (), most_bytes: int = 64 << 20, glob: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """(measurements with MEASURED, inventory (path, sha256, status, reason)) of the packets under folders."""
    if most_bytes <= 0:
        raise ValueError("the byte limit must be positive")
    judged = parsed(read_files(spark, paths, most_bytes, glob), rules)
    whole = lambda v: F.try_variant_get(v, "$", "bigint")
    # An outer explosion, filtered behind: a filter on the reason would be pushed below all steps of the parse and hold each many times over.
    kept = ["C", "N", "P", "kind", "artifact_digest", "sources", "convention", "path", "sha256"]
    rows = judged.select(*kept, F.explode_outer(F.when(F.col("reason").isNull(), F.col("found"))).alias("f")).filter("f IS NOT NULL")
    f = F.col("f")
    rows = rows.select(
        _text(F.col("C")).alias("C"), whole(F.col("N")).alias("N"), whole(F.col("P")).alias("P"), whole(f["ordinal"]).alias("ordinal"), _text(F.col("kind")).alias("kind"),
        f["observable"].alias("observable"), _text(f["outcome"]).alias("outcome"), f["value"].alias("value"), "artifact_digest", "sources", "convention",
        F.col("path").alias("packet"), f["scope"].alias("scope"), f["notes"].alias("notes"), F.col("sha256").alias("packet_sha256"),
    )
    record = F.to_json(F.struct(
        "C", F.lit("lambda_squared").alias("C_definition"), "N", "P", F.lit("bits").alias("P_unit"), "kind", "artifact_digest", "sources", "outcome", "convention",
        F.lit("not separately declared; see observable and convention").alias("units"), "packet", "ordinal", F.col("scope").alias("ordinal_scope"), "observable", "value", "notes", "packet_sha256",
    ), {"ignoreNullFields": "false"})
    inventory = judged.select("path", "sha256", F.when(F.col("reason").isNull(), "indexed").otherwise("unassessed").alias("status"), "reason")
    return rows.select(*MEASURED[:-1], record.alias("record")), inventory
