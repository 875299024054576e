"""Fits from sums against fits of the rows themselves."""

import hashlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugespark.operators import least_squares, models
from gaugespark.queries import refits
from gaugespark.queries.base import Tables

FOLDER = "/root/testdata/sf0.001"


def test_pivoted_solution_equals_a_solve():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x = np.column_stack([np.ones(30), rng.normal(size=(30, 4)) * [1, 100, 0.01, 5]])
        y = rng.normal(size=30)
        assert least_squares.pivoted_solution(x.T @ x, x.T @ y) == pytest.approx(np.linalg.lstsq(x, y, rcond=None)[0], rel=1e-6)


def test_columns_that_others_determine_are_left_out():
    rng = np.random.default_rng(2)
    a, c = rng.normal(size=(2, 40))
    y = 1 + 2 * a - c
    for x in (np.column_stack([np.ones(40), a, 3 * a + 1, c]), np.column_stack([np.ones(40), a, c, np.full(40, 7.0)])):
        found = least_squares.pivoted_solution(x.T @ x, x.T @ y)
        kept = ~np.isnan(found)
        assert kept.sum() == 3 and kept[0]
        assert x[:, kept] @ found[kept] == pytest.approx(y)
    assert np.isnan(least_squares.pivoted_solution(np.zeros((2, 2)), np.zeros(2))).all()


def test_slopes_by_group(spark):
    rng = np.random.default_rng(3)
    rows = [("ab"[i % 2], *map(float, rng.normal(size=3))) for i in range(60)] + [("a", None, 1.0, 1.0), ("c", 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "g string, p double, q double, y double")
    got = {r.g: r for r in least_squares.joint_slopes(df, ["g"], {"p": F.col("p"), "q": F.col("q")}, F.col("y")).collect()}
    for g in "ab":
        own = np.array([r[1:] for r in rows if r[0] == g and r[1] is not None])
        want = np.linalg.lstsq(np.column_stack([np.ones(len(own)), own[:, :2]]), own[:, 2], rcond=None)[0]
        assert (got[g].intercept, got[g].p, got[g].q) == pytest.approx(tuple(want))
        assert got[g].n == len(own)
    assert (got["c"].intercept, got["c"].p, got["c"].q) == (3.0, None, None)


def test_logistic_draws_equal_fits_one_by_one(spark):
    rng = np.random.default_rng(5)
    rows = []
    for draw in range(30):
        n = rng.integers(1, 30, 8)
        rows += [(draw, float(x), int(k), int(rng.binomial(k, 1 / (1 + np.exp(-0.3 * draw / 10 - x))))) for x, k in zip(np.linspace(-2, 2, 8), n)]
    rows += [(100, 1.0, 5, 2), (101, None, 3, 1)]
    df = spark.createDataFrame(rows, "draw int, x double, n long, y long")
    got = {r.draw: r for r in least_squares.logistic_draws(df, ["draw"], "x", "n", "y").collect()}
    assert set(got) == {*range(30), 100}
    for draw in (0, 7, 29, 100):
        one = df.where(F.col("draw") == draw)
        every = one.withColumn("hit", F.explode(F.array(F.lit(1), F.lit(0)))).withColumn("w", F.when(F.col("hit") == 1, F.col("y")).otherwise(F.col("n") - F.col("y")))
        a, b = models.logistic_line(every, F.col("x"), F.col("hit"), F.col("w"))
        assert (got[draw].intercept, got[draw].slope) == pytest.approx((a, b), abs=1e-6)


def weight(unit, draw):
    u = int(hashlib.md5(f"{unit}:{draw}".encode()).hexdigest()[:8], 16) / 2**32
    return int(np.searchsorted(np.cumsum([np.exp(-1) / np.prod(range(1, k + 1)) for k in range(8)]), u, side="right"))


def test_refits_equal_fits_of_the_rows(spark):
    """Some draws of the spline refits against penalised fits of all rows, each taken as often as its unit."""
    t = Tables(spark, FOLDER)
    got = {r.draw: r.asDict() for r in refits.spline_refits(t).collect()}
    assert len(got) == refits.REFITS and Path(FOLDER).exists()
    rows = t.orders.select("o_custkey", F.log1p("o_totalprice").alias("price"), F.when(F.col("o_orderkey") % 7 > 0, F.col("o_custkey").cast("double")).alias("account"), (F.col("o_orderstatus") == "F").cast("double").alias("y"))
    basis, names, _ = models.spline_design(rows.where(F.xxhash64("o_custkey") % 3 != 0), ["price", "account"])
    data = rows.select("o_custkey", "y", *basis).toPandas()
    x = np.column_stack([np.ones(len(data)), data[names].to_numpy(float)])
    for draw in (0, 1, 150, 299):
        by = {u: weight(u, draw) for u in data.o_custkey.unique()}
        w = data.o_custkey.map(by).to_numpy()
        assert got[draw]["n"] == w.sum()
        normal, right = (x.T * w) @ x + np.diag([0.0] + [refits.RIDGE] * len(names)), (x.T * w) @ data.y.to_numpy(float)
        want = np.linalg.solve(normal, right)
        assert [got[draw][c] for c in ("intercept", *names)] == pytest.approx(list(want), abs=2e-6)
