"""Measurement index: packets of exact decimals, an equality-filtered query, an inventory."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import GRAMMAR

#: The whole text is a number.
DECIMAL = f"^({GRAMMAR})$"
#: Largest integer of the numeric columns.
LIMIT = 2**63 - 1


#: The words that begin a rule of a field policy.
RULES = ("prefix", "indexed")


def policy(text: str) -> list[str]:
    """Rules of a policy text, one a line and nothing else: a blank line, a comment, an unknown rule, an odd prefix or a rule given twice is an error, as is no rule."""
    rules = text.splitlines()
    for k, rule in enumerate(rules, 1):
        kind, colon, prefix = rule.partition(":")
        if not colon or kind not in RULES or not re.fullmatch(r"[A-Za-z0-9_]+", prefix) or rule in rules[: k - 1]:
            raise ValueError(f"line {k} of the policy is no rule of its own: {rule!r}")
    if not rules:
        raise ValueError("a policy has a rule")
    return rules


def allowed(name: Column, rules: list[str]) -> Column:
    """Field policy: ``prefix:p`` drops names that start with p, ``indexed:p`` those of p and ASCII digits alone."""
    out = F.lit(True)
    for rule in rules:
        kind, _, p = rule.partition(":")
        if kind not in RULES or not p:
            raise ValueError(f"unknown rule {rule!r}")
        hit = F.startswith(name, F.lit(p))
        if kind == "indexed":
            hit = hit & F.regexp_like(F.substring(name, len(p) + 1, 1 << 30), F.lit("^[0-9]+$"))
        out = out & ~hit
    if len(set(rules)) != len(rules):
        raise ValueError("a rule is given twice")
    return out


def flatten(df: DataFrame, keys: list[str], values: str, rules: list[str] = ()) -> DataFrame:
    """One row for each allowed entry of a map column whose value is an ASCII decimal."""
    out = df.select(*keys, F.explode(values).alias("observable", "value"))
    return out.filter(allowed(F.col("observable"), list(rules)) & F.regexp_like("value", F.lit(DECIMAL)))


def lets_through(name: str, rules: list[str]) -> bool:
    """``allowed`` for a name that is known when the plan is made."""
    for rule in rules:
        kind, _, p = rule.partition(":")
        rest = name[len(p) :]
        if name.startswith(p) and (kind == "prefix" or (rest.isascii() and rest.isdigit())):
            return False
    return True


def flatten_columns(df: DataFrame, keys: list[str], values: dict[str, Column], rules: list[str] = ()) -> DataFrame:
    """``flatten`` where every row has the same observables: those the policy drops are never made, the others are stacked without a map."""
    allowed(F.lit(""), list(rules))
    kept = [F.struct(F.lit(name).alias("observable"), value.alias("value")) for name, value in values.items() if lets_through(name, list(rules))]
    out = df.select(*keys, F.inline(F.array(*kept) if kept else F.array().cast("array<struct<observable:string,value:string>>")))
    return out.filter(F.regexp_like("value", F.lit(DECIMAL)))


#: The field names of a flat packet.
PACKET = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("lambda_squared", T.StringType()), T.StructField("n_modes", T.StringType()),
    T.StructField("precision_bits", T.StringType()), T.StructField("values", T.MapType(T.StringType(), T.StringType())),
    T.StructField("rows", T.ArrayType(T.StructType([
        T.StructField("ordinal", T.StringType()), T.StructField("outcome", T.StringType()),
        T.StructField("values", T.MapType(T.StringType(), T.StringType())),
    ]))),
])


def scan_packets(spark: SparkSession, path: str, rules: list[str] = (), most_bytes: int = 64 << 20, glob: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """(measurements, inventory) of a folder of JSON packets; a file with any bad row gives none, and a reason.

    A packet with neither values nor rows is itself a map of retained fields: its fields of text, but the packet's own, are its values.
    """
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    files = files.select(F.col("_metadata.file_path").alias("path"), "value", F.sha2(F.col("value").cast("binary"), 256).alias("sha256"))
    parsed = files.withColumns({"p": F.from_json("value", PACKET), "big": F.octet_length("value") > most_bytes})
    own = F.map_filter(F.from_json("value", "map<string,string>"), lambda k, _: ~k.isin(*PACKET.fieldNames()))
    bare = (F.size(F.coalesce("p.values", F.create_map().cast("map<string,string>"))) == 0) & (F.size(F.coalesce("p.rows", F.array().cast(PACKET["rows"].dataType))) == 0)
    parsed = parsed.withColumn("p", F.when(bare, F.col("p").withField("values", own)).otherwise(F.col("p")))
    rows = parsed.filter("p.kind IS NOT NULL AND NOT big").select(
        "path", F.col("p.kind").alias("kind"), F.col("p.lambda_squared").alias("C"), F.col("p.n_modes").alias("N"), F.col("p.precision_bits").alias("P"),
        F.explode_outer(F.concat(
            F.array(F.struct(F.lit("0").alias("ordinal"), F.lit(None).cast("string").alias("outcome"), F.coalesce("p.values", F.create_map().cast("map<string,string>")).alias("values"))),
            F.coalesce("p.rows", F.array().cast(PACKET["rows"].dataType)),
        )).alias("r"),
    )
    rows = rows.select("path", "kind", "C", "N", "P", "r.ordinal", "r.outcome", F.explode("r.values").alias("observable", "value"))
    whole = lambda c: F.regexp_like(c, F.lit("^[0-9]+$")) & F.try_to_number(F.col(c), F.lit("9" * 38)).between(0, LIMIT)
    rows = rows.withColumn("ok", F.coalesce(whole("N") & whole("P") & whole("ordinal"), F.lit(False)))
    rows = rows.withColumn("good", F.bool_and("ok").over(W.partitionBy("path")))
    measured = rows.filter("good").filter(allowed(F.col("observable"), list(rules)) & F.regexp_like("value", F.lit(DECIMAL)))
    bad = rows.filter("NOT good").select("path").distinct().withColumn("bad", F.lit(True))
    reason = F.when(F.col("big"), "too large").when(F.col("p.kind").isNull(), "not a packet").when(F.col("bad"), "a row is not valid")
    inventory = parsed.join(bad, "path", "left").select("path", "sha256", F.when(reason.isNull(), "indexed").otherwise("failed").alias("status"), reason.alias("reason"))
    return measured.drop("ok", "good"), inventory


def index_query(measured: DataFrame, limit: int = 200, **equal) -> DataFrame:
    """Rows that equal every given filter, ordered, the first few."""
    out = measured
    for name, value in equal.items():
        if value is not None:
            out = out.filter(F.col(name) == value)
    return out.orderBy(*[c for c in ("C", "N", "P", "ordinal", "observable") if c in out.columns]).limit(limit)
