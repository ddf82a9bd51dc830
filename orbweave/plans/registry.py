"""Registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orbweave.sources.tables import TABLES, load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a DataFrame query under its function's name, with SQL that gives the same."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: SQL functions that carry one name in both engines.
_NAMES = {
    "sha256(s STRING) RETURNS STRING RETURN sha2(s, 256)",
    "epoch_us(t TIMESTAMP) RETURNS BIGINT RETURN unix_micros(t)",
}


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    for t in TABLES:
        if t in text:
            load(spark, sf_dir, t).createOrReplaceTempView(t)
    for f in _NAMES:
        if f.split("(")[0] in text:
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {f}")
    return spark.sql(text)
