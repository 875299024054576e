"""The queries of 2000 draws against brute force over all weights."""

import hashlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

from gaugespark import catalogue

FOLDER = Path("/root/testdata/sf0.001")
DRAWS = 2000
STEPS = np.cumsum([np.exp(-1) / np.prod(range(1, k + 1)) for k in range(8)])


def weights(units):
    """A row for each unit, a column for each draw."""
    u = [[int(hashlib.md5(f"{unit}:{d}".encode()).hexdigest()[:8], 16) / 2**32 for d in range(DRAWS)] for unit in units]
    return np.searchsorted(STEPS, np.array(u), side="right")


@pytest.fixture(scope="module")
def orders():
    return pq.read_table(FOLDER / "orders.parquet").to_pylist()


@pytest.fixture(scope="module")
def customers(orders):
    units = sorted({o["o_custkey"] for o in orders})
    return {u: i for i, u in enumerate(units)}, weights(units)


def means(orders, customers, keep=lambda o: True):
    place, w = customers
    hit, n = np.zeros(len(place)), np.zeros(len(place))
    for o in filter(keep, orders):
        hit[place[o["o_custkey"]]] += o["o_totalprice"] > 150000
        n[place[o["o_custkey"]]] += 1
    return hit @ w / (n @ w)


@pytest.fixture(scope="module")
def strata(orders, customers):
    return {p: means(orders, customers, lambda o, p=p: o["o_orderpriority"] == p) for p in {o["o_orderpriority"] for o in orders}}


def rows(spark, name):
    return catalogue.QUERIES[name](spark, str(FOLDER)).collect()


def test_interval_and_p_of_all_draws(spark, orders, customers):
    m = means(orders, customers)
    (got,) = rows(spark, "bootstrap_interval")
    assert (got.low, got.high, got.se) == pytest.approx((*np.quantile(m, [0.025, 0.975]), m.std(ddof=1)), abs=1e-8)
    (got,) = rows(spark, "bootstrap_p")
    assert got.p == pytest.approx(min(1, 2 * (min((m <= 0.5).sum(), (m >= 0.5).sum()) + 1) / (DRAWS + 1)), abs=1e-8)


def test_strata_of_all_draws(spark, orders, strata):
    for r in rows(spark, "bootstrap_by_stratum"):
        m = strata[r.o_orderpriority]
        assert (r.low, r.high, r.se) == pytest.approx((*np.quantile(m, [0.025, 0.975]), m.std(ddof=1)), abs=1e-8)
    for r in rows(spark, "margin_verdict"):
        assert r.bonferroni == pytest.approx(np.quantile(0.5 - strata[r.o_orderpriority], 0.005), abs=1e-8)
    c = np.quantile(np.max([abs(m - m.mean()) / m.std(ddof=1) for m in strata.values()], axis=0), 0.95)
    for r in rows(spark, "simultaneous_intervals"):
        assert r.high - r.low == pytest.approx(2 * c * strata[r.o_orderpriority].std(ddof=1), abs=3e-6)


def test_refits_of_all_draws(spark, orders, customers):
    place, w = customers
    v = np.zeros((5, len(place)))
    for o in orders:
        x, y = o["o_totalprice"] / 1e5, o["o_orderstatus"] == "F"
        v[:, place[o["o_custkey"]]] += [1, x, x * y, x * x, y]
    n, x, xy, xx, y = v @ w
    got = {r.draw: r.slope for r in rows(spark, "refit_slopes")}
    assert [got[d] for d in range(DRAWS)] == pytest.approx((n * xy - x * y) / (n * xx - x * x), abs=2e-6)


def test_auroc_of_all_draws(spark):
    counts = defaultdict(lambda: np.zeros((2, 50)))
    for r in pq.read_table(FOLDER / "lineitem.parquet", columns=["l_suppkey", "l_quantity", "l_returnflag"]).to_pylist():
        counts[r["l_suppkey"]][int(r["l_returnflag"] == "R"), int(r["l_quantity"]) - 1] += 1
    units = sorted(counts)
    q, p = np.einsum("uct,ud->cdt", np.array([counts[u] for u in units]), weights(units))
    expected = (p * (np.cumsum(q, 1) - q / 2)).sum(1) / (p.sum(1) * q.sum(1))
    got = {r.draw: r.auroc for r in rows(spark, "auroc_by_draw")}
    assert [got[d] for d in range(DRAWS)] == pytest.approx(list(expected), abs=2e-6)
