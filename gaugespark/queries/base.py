"""Registration of queries with the SQL they are checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gaugespark.sources.tables import parquet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The driver's tables of one folder, by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return parquet(self._spark, self._folder, name)


def query(sql: str | None = None):
    """Registers a function of Tables under its name."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def digest_weight_sql(unit: str, draw: str = "draw") -> str:
    """operators.resampling.digest_weight in DuckDB's SQL."""
    u = f"(('0x' || substr(md5({unit}::VARCHAR || ':' || {draw}::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
    bounds, p, cumulative = [], 0.36787944117144233, 0.0
    for k in range(1, 9):
        cumulative += p
        bounds.append(cumulative)
        p /= k
    return "(" + " + ".join(f"({u} >= {b!r}::DOUBLE)::INT" for b in bounds) + ")"
