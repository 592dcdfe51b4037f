"""Command line: JSON in, JSON lines out. ``python -m quillon VERB REQUEST.json`` with {"input": folder of Parquet tables, ...}."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import registry
from .operators import dag, governance, index, lookup
from .sources import packages, store, tables


def _table(spark: SparkSession, request: dict, key: str) -> DataFrame:
    return tables.table(spark, request["input"], request[key])


VERBS = {
    "index-query": lambda spark, r: index.index_query(index.scan_packets(spark, r["path"], r.get("rules", []))[0], r.get("limit", 200), **r.get("equal", {})),
    "index-inventory": lambda spark, r: index.scan_packets(spark, r["path"], r.get("rules", []))[1],
    "closure": lambda spark, r: dag.closure(_table(spark, r, "edges"), _table(spark, r, "roots")),
    "levels": lambda spark, r: dag.levels(_table(spark, r, "edges"), _table(spark, r, "nodes")),
    "resolve": lambda spark, r: governance.resolve(_table(spark, r, "queries"), _table(spark, r, "copies"), F.expr(r.get("accepted", "true"))),
    "exclude": lambda spark, r: lookup.exclusion(_table(spark, r, "atoms"), _table(spark, r, "excluded"), r["key"])[0],
    "fetch": lambda spark, r: store.fetch(spark, r["store"], _table(spark, r, "digests")).select("digest", "intact"),
    "verify-bundle": lambda spark, r: packages.verify_bundle(spark, r["bundle"], r.get("decode", True)),
    "repairs": lambda spark, r: governance.repairs(_table(spark, r, "computed"), _table(spark, r, "stored"), r["key"], r["digest"]),
    "query": lambda spark, r: registry.queries()[r["name"]](spark, r["input"]),
}


def main(args: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    parser = argparse.ArgumentParser(prog="quillon", description=__doc__)
    parser.add_argument("verb", choices=[*VERBS, "list"])
    parser.add_argument("request", nargs="?", help="a JSON file")
    given = parser.parse_args(args)
    if given.verb == "list":
        print(json.dumps({"verbs": sorted(VERBS), "queries": sorted(registry.queries())}), file=out)
        return 0
    with open(given.request) as f:
        request = json.load(f)
    spark = spark or SparkSession.builder.appName("quillon").getOrCreate()
    result = VERBS[given.verb](spark, request)
    for line in result.toJSON().toLocalIterator():  # a row at a time
        print(line, file=out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
