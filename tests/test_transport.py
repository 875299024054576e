"""The transport data source: one file over many tasks, filters in the tasks, and the same rows as the whole read."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugespark.sources import tables, transport
from tests.test_sources_and_streams import ibm, transport_file


@pytest.fixture(scope="module")
def file(tmp_path_factory):
    rows = [(float(i), f"n{i % 7}" if i % 5 else "", (i - 300) * 0.37 if i % 11 else 0.0) for i in range(1000)]
    path = tmp_path_factory.mktemp("t") / "t.xpt"
    path.write_bytes(transport_file([("seqn", 1), ("name", 2), ("v", 1)], rows))
    return str(path), rows


def test_one_file_over_many_tasks(spark, file):
    path, rows = file
    df = transport.transport(spark, path, rows=64)
    assert df.rdd.getNumPartitions() == 16 and df.columns == ["SEQN", "NAME", "V"]
    got = sorted(tuple(r) for r in df.collect())
    assert [(a, b or "") for a, b, _ in got] == [r[:2] for r in rows]
    assert np.allclose([r[2] for r in got], [r[2] for r in rows], rtol=1e-15)
    whole = tables.xport(spark, path, "SEQN double, NAME string, V double").collect()
    assert sorted((r.SEQN, r.NAME or "") for r in whole) == [(a, b or "") for a, b, _ in got]
    assert np.allclose([r.V for r in sorted(whole)], [r[2] for r in got], rtol=1e-15)


def test_filters_are_pushed(spark, file):
    path, rows = file
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = transport.transport(spark, path, rows=100)
        for condition, want in [
            (F.col("SEQN") >= 990, lambda r: r[0] >= 990),
            ((F.col("V") < -100) & (F.col("NAME") == "n3"), lambda r: r[2] < -100 and r[1] == "n3"),
            (F.col("NAME").isNull() & (F.col("SEQN") < 50), lambda r: not r[1] and r[0] < 50),
            (F.col("SEQN").isin(3.0, 5.0, 7.5), lambda r: r[0] in (3, 5)),
            (F.length("NAME") > 5, lambda r: False),
        ]:
            assert sorted(r.SEQN for r in df.where(condition).collect()) == [r[0] for r in rows if want(r)]
        reader = transport.PushingReader(path, 10)
        left = list(reader.pushFilters([transport.GreaterThan(("SEQN",), 5.0), transport.GreaterThan(("NAME",), "a"), transport.EqualTo(("OTHER",), 1)]))
        assert len(left) == 2 and len(reader.pushed) == 1
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def test_numbers():
    values = [0.0, 1.0, -1.0, 0.1, 1e-60, -123456.789, 1e60, 2**53 + 1.0]
    got, missing = transport.numbers(np.frombuffer(b"".join(ibm(v) for v in values), np.uint8).reshape(-1, 8))
    assert all(math.isclose(a, b, rel_tol=1e-15) for a, b in zip(got, values)) and not missing.any()
    _, missing = transport.numbers(np.frombuffer(b"." + bytes(7) + b"A" + bytes(7) + b"_" + bytes(7) + b"\x41\x10" + bytes(6), np.uint8).reshape(-1, 8))
    assert missing.tolist() == [True, True, True, False]
    short, _ = transport.numbers(np.frombuffer(ibm(2.5)[:3], np.uint8).reshape(-1, 3))
    assert short[0] == 2.5


def test_a_file_without_rows(spark, tmp_path):
    (tmp_path / "e.xpt").write_bytes(transport_file([("a", 1)], []))
    assert transport.transport(spark, str(tmp_path / "e.xpt")).count() == 0
