"""URL filter: rules of (host, path) against URLs, by hash-prefix joins.

Every distinct (host, path) of the input is expanded into host-suffix and path-prefix
expressions. An expression meets the rules through an equi-join on the first 32 bits of its
SHA-256; the whole digest then confirms the match, and the longest rule wins (equal lengths:
block before allow, then the greater rule text).

Defined cases: a null URL or one without ``://`` has an empty host and path and takes the
default verdict; a URL whose host is empty can match nothing, as every rule has a host; ports and user
info stay part of the host; urls of any length are judged whole; repeated rows and null ids each keep their own row; an empty
table gives an empty result. Columns named host, path, rule or verdict in the input give way to the
result's own; all other columns are kept, whatever their names: the input travels as one struct.

No URL is dealt to one task: URLs without a host take the default where they stand, those that more than a
``HOT_SHARE``-th of all rows hold get their verdict by broadcast, and only the others are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_az, written

RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

#: Rule tables of at most so many rows (they are counted) are broadcast: about 100 bytes a row, so 10 MB. Larger ones are shuffled.
BROADCAST_RULES = 100_000
#: A URL is hot if more than one in so many rows has it, and at least HOT_LEAST; there are fewer than HOT_SHARE of them.
HOT_SHARE, HOT_LEAST = 10_000, 1_000
OWN = ("host", "path", "rule", "verdict")


def parse_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL column; the host's A-Z lower-cased, both empty without ``://``."""
    known = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.when(known, lower_az(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))).otherwise(F.lit(""))
    path = F.when(known, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))
    return host, path


def rule_table(spark: SparkSession, rules) -> DataFrame:
    """(verdict, rule_host, rule_path, rule, digest, short) of rules: a list of (verdict, host, path), or a table with these columns."""
    if isinstance(rules, DataFrame):
        table = rules.select("verdict", F.col("host").alias("rule_host"), F.col("path").alias("rule_path")).dropna()
    else:
        rows = [F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("rule_host"), F.lit(p).alias("rule_path")) for v, h, p in rules]
        empty = F.array().cast("array<struct<verdict:string,rule_host:string,rule_path:string>>")
        table = spark.range(1).select(F.inline(F.array(*rows) if rows else empty))
    return (
        table.withColumn("rule_host", lower_az("rule_host"))
        .dropDuplicates()
        .withColumn("rule", F.concat("rule_host", "rule_path"))
        .withColumn("digest", F.sha2(F.concat_ws("\n", "rule_host", "rule_path"), 256))
        .withColumn("short", F.substring("digest", 1, 8))
    )


def judge_urls(df: DataFrame, rules=RULES, url: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with host, path, rule and verdict for each row."""
    spark = df.sparkSession
    table = rule_table(spark, rules)
    if isinstance(rules, DataFrame):
        table = written(table, "url-rules")
        # As many rows as there are lengths of paths and numbers of labels.
        lengths = sorted(r[0] for r in table.select(F.length("rule_path")).distinct().collect())
        most_labels = table.select(F.max(F.size(F.split("rule_host", "\\.")))).first()[0] or 1
        known = table.count()
    else:
        lengths = sorted({len(p) for _, _, p in rules})
        most_labels, known = max((h.count(".") + 1 for _, h, _ in rules), default=1), len(rules)
    if known <= BROADCAST_RULES:
        table = F.broadcast(table)

    host, path = parse_url(F.col(f"`{url}`"))
    kept = [c for c in df.columns if c.lower() not in OWN]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(0).alias("_"))
    rows = df.select(row.alias("row"), host.alias("host"), path.alias("path"))

    # Only as many labels and such prefix lengths as some rule has can match.
    urls = rows.filter("host <> ''").groupBy("host", "path").agg(F.count("*").alias("copies"))
    suffixes = F.array_compact(F.array(*[
        F.when(F.size("labels") >= n, F.concat_ws(".", F.slice("labels", -n, n))) for n in range(1, most_labels + 1)
    ]))
    prefixes = F.array_compact(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]))
    expressions = (
        urls.withColumn("labels", F.split("host", "\\."))
        .select("host", "path", "copies", F.explode(suffixes).alias("s"), prefixes.alias("prefixes"))
        .select("host", "path", "copies", "s", F.explode("prefixes").alias("p"))
        .withColumn("full", F.sha2(F.concat_ws("\n", "s", "p"), 256))
        .withColumn("short", F.substring("full", 1, 8))
    )
    best = (
        expressions.join(table, "short")
        .filter(F.col("full") == F.col("digest"))
        .groupBy("host", "path")
        .agg(F.max(F.struct(
            F.length("rule").alias("size"), (F.col("verdict") == "block").cast("int").alias("strict"), "rule", "verdict",
        )).alias("best"), F.max("copies").alias("copies"))
        .select("host", "path", F.struct("best.rule", "best.verdict").alias("found"), "copies")
    )
    # What matched no rule needs no join: the hot ones are told apart before the shuffle, matched or not.
    total = rows.count()
    is_hot = F.col("copies") > max(HOT_LEAST, total // HOT_SHARE)
    hot = urls.filter(is_hot).select("host", "path").join(best.select("host", "path", "found"), ["host", "path"], "left")
    hot = F.broadcast(written(hot.select("host", "path", F.lit(True).alias("hot"), F.col("found").alias("hot_found")), "url-hot"))  # fewer than HOT_SHARE
    told = rows.join(hot, ["host", "path"], "left")
    done = F.coalesce("hot", F.col("host") == "")
    at_once = told.filter(done).select("row", "host", "path", F.col("hot_found").alias("found"))
    rest = told.filter(~done).select("row", "host", "path").join(best.filter(~is_hot).select("host", "path", "found"), ["host", "path"], "left")
    out = at_once.unionByName(rest.select("row", "host", "path", "found"))
    fields = [F.col("row")[c].alias(c) for c in kept]
    return out.select(*fields, "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.lit(default)).alias("verdict"))
