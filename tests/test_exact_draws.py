"""Exact bootstrap counts against the tree worked out by hand."""

import hashlib
from collections import Counter, defaultdict
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugespark.operators import exact_draws

M = 1 << 32


def mix(x):
    for f in (73244475, 73244475, 1):
        x = ((x >> 16) ^ x) * f % M
    return x


def number(v):
    return int(hashlib.md5(str(v).encode()).hexdigest()[:8], 16)


def by_hand(units, draws, leaf):
    """(draw, stratum): units taken, with repeats, by one pick after another down the tree."""
    strata = defaultdict(list)
    for unit, stratum in units:
        strata[stratum or ""].append(unit)
    largest = max(len(u) for u in strata.values())
    deep = max(0, int(np.ceil(np.log2(largest / leaf))))
    out = {}
    for stratum, own in strata.items():
        place = {u: (1 << deep) + (number(u) >> (32 - deep)) for u in own}
        size = Counter(place[u] >> up for u in own for up in range(deep + 1))
        leaves = defaultdict(list)
        for u in sorted(own, key=lambda u: (number(u), str(u))):
            leaves[place[u]].append(u)
        for draw in range(draws):
            seed, now = mix((number(stratum) + draw) % M), {1: len(own)}
            for _ in range(deep):
                after = Counter()
                for node, c in now.items():
                    key = mix(seed ^ node)
                    for k in range(c):
                        after[2 * node + (mix((key + k) % M) * size[node] >= size.get(2 * node, 0) * M)] += 1
                now = after
            taken = Counter()
            for node, c in now.items():
                key = mix(seed ^ ((node + (1 << 31)) % M))
                for k in range(c):
                    taken[leaves[node][mix((key + k) % M) * len(leaves[node]) >> 32]] += 1
            out[draw, stratum] = taken
    return out


@pytest.mark.parametrize("leaf,picks", [(1024, 4096), (8, 7), (1, 5)])
def test_counts(spark, leaf, picks, monkeypatch):
    monkeypatch.setattr(exact_draws, "PICKS", picks)
    units = [(i, ["a", "b", None][i % 7 % 3]) for i in range(90)]
    df = spark.createDataFrame([(u, s, u * u, float(u)) for u, s in units], "u long, s string, x long, d double")
    got = {(r.draw, r.stratum): r for r in exact_draws.exact_sums(df, "u", ["x", "d"], 25, "s", leaf).collect()}
    want = by_hand(units, 25, leaf)
    assert got.keys() == want.keys()
    for k, taken in want.items():
        n = sum(s == (k[1] or None) for _, s in units)
        assert got[k].taken == got[k].n == sum(taken.values()) == n
        assert got[k].x == sum(u * u * c for u, c in taken.items()) and got[k].d == pytest.approx(sum(u * c for u, c in taken.items()))


def test_counts_are_those_of_a_multinomial(spark):
    """Mean 1, variance 1 - 1 / n and covariance -1 / n of counts over draws."""
    taken = by_hand([(i, "") for i in range(40)], 3000, 8)
    counts = np.array([[taken[d, ""][u] for u in range(40)] for d in range(3000)])
    assert (counts.sum(1) == 40).all()
    assert abs(counts.mean(0) - 1).max() < 0.09
    cov = np.cov(counts.T)
    assert abs(np.diag(cov).mean() - (1 - 1 / 40)) < 0.03
    assert abs(cov[np.triu_indices(40, 1)].mean() + 1 / 40) < 0.003


def test_empty(spark):
    assert exact_draws.exact_sums(spark.createDataFrame([], "u long, x long"), "u", ["x"], 10).count() == 0


@pytest.mark.parametrize("picks", [3, 8, 1 << 15])
def test_numbers_of_picks_come_in_parts(picks, monkeypatch):
    monkeypatch.setattr(exact_draws, "PICKS", picks)
    keys, counts = np.array([M - 2, 5, 77, 1 << 31], np.uint32), np.array([9, 1, 20, 3])
    got = [[] for _ in keys]
    for first, stop, starts, numbers in exact_draws._numbers(keys, counts):
        assert len(numbers) <= picks or stop == first + 1
        for row, some in zip(range(first, stop), np.split(numbers, starts[1:])):
            got[row] += some.tolist()
    assert got == [[mix((int(key) + k) % M) for k in range(c)] for key, c in zip(keys, counts)]


def test_picks_are_no_rows(spark):
    """One Generate for the draws, and none for their picks."""
    df = spark.range(64).select(F.col("id").alias("u"), F.col("id").alias("x"))
    plan = exact_draws.exact_sums(df, "u", ["x"], 10, leaf=8)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1


def test_large_values_stay_whole(spark):
    rows = [(i, (1 << 62) // 40 - i, Decimal(10) ** 20 + Decimal(i) / 100) for i in range(40)]
    df = spark.createDataFrame(rows, "u long, x long, d decimal(30,2)")
    want = by_hand([(i, "") for i in range(40)], 6, 8)
    for r in exact_draws.exact_sums(df, "u", ["x", "d"], 6, leaf=8).collect():
        taken = want[r.draw, ""]
        assert r.x == sum(rows[u][1] * c for u, c in taken.items()) and r.d == sum(rows[u][2] * c for u, c in taken.items())
