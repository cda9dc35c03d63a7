"""Registered queries, each beside the SQL that gives the same answer."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from millrace.session import UNION_PARTITIONING, scratch_path, shared_dir

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
_LAYOUTS: dict[tuple[str, str, str], str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its inventory ID; without SQL it is checked by tests instead."""

    def register(run: Query) -> Query:
        @wraps(run)
        def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            spark.conf.set(UNION_PARTITIONING, "false")
            shared_dir(spark)
            return run(spark, sf_dir)

        if name in QUERIES:
            raise KeyError(f"two queries are called {name}")
        QUERIES[name] = prepared
        if sql is not None:
            ORACLE[name] = sql
        return prepared

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def layout(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> str:
    """A layout derived from the tables, written once per session and data set."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _LAYOUTS:
        path = scratch_path(spark, name)
        write(path)
        _LAYOUTS[key] = path
    return _LAYOUTS[key]
