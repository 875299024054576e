"""Every query with SQL against DuckDB on the smallest tables; the others must run."""

import math
from pathlib import Path

import duckdb
import pytest

from gaugespark import catalogue

FOLDER = Path("/root/testdata/sf0.001")
NAMES = sorted(catalogue.QUERIES)
#: Every customer of the smallest tables may have an order.
MAY_BE_EMPTY = {"anti_exclude"}


def plain(value):
    if value is None or isinstance(value, (str, bool)):
        return str(value)
    if isinstance(value, float) or type(value).__name__ == "Decimal":
        value = float(value)
        return "nan" if math.isnan(value) else f"{value + 0:.6g}"
    return f"{float(value):.6g}" if isinstance(value, int) else str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, str(FOLDER))
    names, rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert rows or name in MAY_BE_EMPTY
    if name in catalogue.ORACLES:
        cursor = duck.execute(catalogue.ORACLES[name])
        expected_names, expected = rows_of([d[0] for d in cursor.description], cursor.fetchall())
        assert names == expected_names
        assert rows == expected


def test_every_query_says_what_it_covers():
    import inspect

    from gaugespark.queries import composites, inference, records, relational, statistics, textual

    for module in (composites, inference, records, relational, statistics, textual):
        for name, f in inspect.getmembers(module, inspect.isfunction):
            if name in catalogue.QUERIES:
                assert f.__doc__, name


def test_flagship_is_registered():
    assert catalogue.FLAGSHIP in catalogue.QUERIES
