"""Inference queries and operators against numpy and hand-worked cases."""

import math
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gaugespark import catalogue
from gaugespark.functions import values
from gaugespark.operators import keys, metrics, models, ranks, resampling, routing
from gaugespark.queries import inference
from gaugespark.queries.base import Tables
from gaugespark.sources import tables

FOLDER = Path("/root/testdata/sf0.001")


def read(name):
    return pq.read_table(FOLDER / f"{name}.parquet").to_pylist()


def run(spark, name):
    return catalogue.QUERIES[name](spark, str(FOLDER)).collect()


@pytest.fixture
def small_ranges(monkeypatch):
    """Ranges of a few rows, as a large table has them."""
    monkeypatch.setattr(ranks, "ROWS", 40)


def test_ranges_grow_with_the_table(spark, small_ranges):
    rng = np.random.default_rng(4)
    data = [(int(i), float(v) if v == v else None, f"k{i % 50:03d}", "ab"[i % 2]) for i, v in enumerate(rng.choice([0.5, 1.5, np.nan, *rng.random(60)], 3000, p=[0.4, 0.2, 0.02, *([0.38 / 60] * 60)]))]
    df = spark.createDataFrame(data, "id long, v double, name string, g string").repartition(5)
    known = [r for r in data if r[1] is not None]
    for tie, place in (("id", 0), ("name", 2)):
        got = {r.id: r._nth for r in ranks.numbered(df.where("v is not null"), "v", tie).collect()}
        order = sorted(known, key=lambda r: (r[1], r[place]))
        assert sorted(got.values()) == list(range(1, len(known) + 1))
        assert all((a[1], a[place]) <= (b[1], b[place]) for a, b in zip(*(lambda s: (s, s[1:]))(sorted(known, key=lambda r: got[r[0]]))))
        if tie == "id":
            assert [got[r[0]] for r in order] == list(range(1, len(known) + 1))
    falling = {r.id: r._nth for r in ranks.numbered(df.where("v is not null"), "v", "id", falling=True).collect()}
    assert [falling[r[0]] for r in sorted(known, key=lambda r: (-r[1], r[0]))] == list(range(1, len(known) + 1))
    sums = {(r.g, r.v): (r.n, r.n_before) for r in ranks.running(df.where("v is not null"), "v", {"n": F.lit(1)}, ["g"]).collect()}
    for (g, v), (n, before) in sums.items():
        assert (n, before) == (sum(r[1] == v and r[3] == g for r in known), sum(r[1] < v and r[3] == g for r in known))
    for group in ([], ["g"]):
        for r in ranks.percentiles(df, "v", (0, 0.005, 0.3, 0.5, 1), group).collect():
            own = [x[1] for x in known if not group or x[3] == r.g]
            assert r.n == len(own)
            assert r.p == pytest.approx(np.quantile(own, (0, 0.005, 0.3, 0.5, 1)).tolist())


def test_metrics_over_many_ranges(spark, small_ranges):
    rng = np.random.default_rng(5)
    data = [(int(i), float(rng.integers(0, 300)), bool(rng.random() < 0.4)) for i in range(2000)]
    df = spark.createDataFrame(data, "id long, s double, y boolean")
    (got,) = metrics.auroc(df, "s", F.col("y")).collect()
    pos, neg = (np.array([s for _, s, y in data if y == k]) for k in (True, False))
    assert got.auroc == pytest.approx(((pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()))
    least = ranks.running_minimum(df.groupBy("s").agg(F.min("id").alias("v")), "s", "v", "m").collect()
    per = {}
    for i, s, _ in data:
        per[s] = min(i, per.get(s, i))
    assert {r.s: r.m for r in least} == {s: min((v for t, v in per.items() if t < s), default=None) for s in per}


def test_exact_intervals_have_their_tails(spark):
    cases = [(0, 5), (5, 5), (1, 10), (7, 20), (250, 1000), (3, 4000)]
    got = values.exact_intervals(spark.createDataFrame(cases, "k long, n long"), "k", "n").collect()

    def above(k, n, p):
        return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k, n + 1))

    for r in got:
        assert r.low == 0 if r.k == 0 else above(r.k, r.n, r.low) == pytest.approx(0.025, abs=1e-6)
        assert r.high == 1 if r.k == r.n else 1 - above(r.k + 1, r.n, r.high) == pytest.approx(0.025, abs=1e-6)
    assert len(run(spark, "clopper_pearson")) == 3


def test_holm_bounds_stop(spark):
    """a holds at alpha / 3, b doesn't at alpha / 2, so c keeps b's level and isn't ok."""
    draws = [(k, d, v) for k, base in (("a", 1.0), ("b", -0.1), ("c", -0.4)) for d, v in enumerate(np.linspace(base - 0.5, base + 0.5, 401))]
    df = spark.createDataFrame([(k, int(d), float(v)) for k, d, v in draws], "k string, draw int, v double")
    got = {r.k: (r.bound, r.ok) for r in resampling.holm_bounds(df, "k", "v", 0.2).collect()}
    own = {k: sorted(v for x, _, v in draws if x == k) for k in "abc"}
    level = {"a": 0.025 / 3, "b": 0.025 / 2, "c": 0.025 / 2}
    assert got == {k: (pytest.approx(own[k][math.floor(level[k] * 400)]), k == "a") for k in "abc"}
    assert {r.k: r.outcome for r in resampling.holm_outcomes(df, "k", "v", 0.2).collect()} == {"a": "non-inferior", "b": "inconclusive", "c": "inconclusive"}


def newton(x, y, w):
    beta, design = np.zeros(2), np.stack([np.ones(len(x)), x], 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-design @ beta))
        beta = beta + np.linalg.solve((design * (w * p * (1 - p))[:, None]).T @ design + 1e-8 * np.eye(2), design.T @ (w * (y - p)) - 1e-8 * beta)
    return beta


def test_logistic_fits(spark):
    customers, orders = read("customer"), defaultdict(int)
    for o in read("orders"):
        orders[o["o_custkey"]] += 1
    nation = np.array([c["c_nationkey"] for c in customers])
    x = np.array([orders[c["c_custkey"]] / 10 for c in customers])
    y = np.array([float(c["c_acctbal"] > 5000) for c in customers])
    for r in run(spark, "leave_group_logistic"):
        assert (r.intercept, r.slope) == pytest.approx(newton(x[nation != r.c_nationkey], y[nation != r.c_nationkey], np.ones((nation != r.c_nationkey).sum())).tolist(), abs=1e-5)
    rows = inference._risk(Tables(spark, str(FOLDER))).withColumn("half", F.pmod(F.xxhash64("l_orderkey"), F.lit(2)).cast("int")).collect()
    for r in run(spark, "recalibrated_halves"):
        side = lambda k: (np.array([q.x for q in rows if q.half == k]), np.array([float(q.y) for q in rows if q.half == k]))
        (fx, fy), (ox, oy) = side(r.fitted_on), side(1 - r.fitted_on)
        beta = newton(fx, fy, np.ones(len(fx)))
        p = 1 / (1 + np.exp(-(beta[0] + beta[1] * ox)))
        assert (r.intercept, r.slope, r.n) == (pytest.approx(beta[0], abs=1e-5), pytest.approx(beta[1], abs=1e-5), len(ox))
        assert r.log_loss == pytest.approx(-(oy * np.log(p) + (1 - oy) * np.log(1 - p)).mean(), abs=1e-5)
    lines = models.logistic_lines(spark.createDataFrame([], "f int, x double, y int"), "f", "x", "y")
    assert lines.count() == 0


def test_survival_and_support(spark):
    risk = {r.c_custkey: r.risk for r in run(spark, "survival_logit")}
    customers = read("customer")
    dead = np.array([risk[c["c_custkey"]] for c in customers if c["c_acctbal"] < 0])
    alive = np.array([risk[c["c_custkey"]] for c in customers if c["c_acctbal"] >= 0])
    assert len(risk) == len(customers) and dead.min() > alive.max()
    support = run(spark, "category_support")
    kept = [s for s, n in __import__("collections").Counter(c["c_mktsegment"] for c in customers).items() if n >= 20]
    assert {r.segment for r in support} == set(kept)
    assert 0.9 < np.mean([r.supported for r in support]) <= 1
    (imputed,) = run(spark, "imputed_values")
    assert imputed.error < imputed.median_error


def test_small_pieces(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 2.0, 3.0)], "a int, b int, x double, simultaneous_low double")
    assert df.select(keys.first_present(df, ["z", "b", "a"]).alias("v"), keys.first_present(df, ["z"]).alias("w")).collect() == [(None, None)]
    assert resampling.marginal_only(df).columns == ["a", "b", "x"]
    licence = tmp_path / "LICENSE"
    with pytest.raises(PermissionError):
        tables.guarded(df, str(licence), 5)
    licence.write_text("free")
    assert tables.guarded(df, str(licence), 5, "a", df).count() == 1
    with pytest.raises(PermissionError):
        tables.guarded(df, str(licence), 0)
    with pytest.raises(PermissionError):
        tables.guarded(df, str(licence), 5, "a", df.where("a > 1"))
    empty = df.limit(0)
    assert keys.staged_sample(empty, "b", "a", ["x"], 3).count() == 0
    grid = routing.decile_grid(empty, "x", F.col("a") > 0, F.col("a") > 0, F.col("x"), F.col("x"), 0.1)
    assert grid.count() == 0



def test_layouts():
    text = "DATA one;\\n INPUT SEQN 1-5 SEX $ 6 AGE 7-8\\n @9 CODE $3. @12 WEIGHT 8.2 LAST 20;\\nRUN; OTHER 1-2"
    assert tables.layout(text) == {"SEQN": (1, 5, False), "SEX": (6, 6, True), "AGE": (7, 8, False), "CODE": (9, 11, True), "WEIGHT": (12, 19, False), "LAST": (20, 20, False)}


def test_spline_design_follows_a_bend(spark):
    """A risk that rises and falls again, with missing values of another risk."""
    rng = np.random.default_rng(8)
    x = rng.random(1500)
    y = (rng.random(1500) < np.where(np.abs(x - 0.5) < 0.25, 0.9, 0.1)).astype(int)
    rows = [(i, None if i % 10 == 0 else float(v), "ab"[i % 2], int(1 if i % 10 == 0 else k)) for i, (v, k) in enumerate(zip(x, y))]
    out = models.crossfitted(spark.createDataFrame(rows, "id long, v double, g string, y int"), "id", "y", ["v"], ["g"], folds=3).toPandas()
    by = {r[0]: r[1] for r in rows}
    middle = out.p[[by[i] is not None and abs(by[i] - 0.5) < 0.15 for i in out.id]].mean()
    outer = out.p[[by[i] is not None and abs(by[i] - 0.5) > 0.35 for i in out.id]].mean()
    assert len(out) == 1500 and middle > 0.75 and outer < 0.3 and out.p[[by[i] is None for i in out.id]].mean() > 0.9


def test_rows_of_a_boosted_fit_are_dealt_to_all_cores(spark):
    from gaugespark.operators import models

    rows = models.spread(spark.range(50).coalesce(1))
    assert rows.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and rows.count() == 50
