"""All registered queries of the engine with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name -> (function of (spark, sf_dir), SQL or None)
REGISTERED: dict = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) as a query, with the SQL it must equal."""

    def keep(f):
        REGISTERED[name] = (f, sql)
        return f

    return keep


def _load() -> None:
    from . import catalogue  # noqa: F401


def queries() -> dict:
    _load()
    return {k: f for k, (f, _) in REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: sql for k, (_, sql) in REGISTERED.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return REGISTERED["index_query"][0](spark, sf_dir)
