"""Distances to the nearest of a fitting set, and the support verdict, against all pairs."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from gaugespark.operators import neighbours
from gaugespark.queries import composites
from gaugespark.queries.base import Tables


def brute(judged, fitting):
    """The least distance of each (key, vector) to a fitting row of another key."""
    out = []
    for k, v in judged:
        d = [np.sqrt(((np.array(v) - np.array(w)) ** 2).sum()) for j, w in fitting if j != k and w is not None] if v is not None else []
        out.append((k, min(d, default=None)))
    return out


def same(got, want):
    key = lambda x: (str(x[0]), -1.0 if x[1] is None else x[1])
    for (a, d), (b, e) in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a == b and ((d is None and e is None) or d == pytest.approx(e, abs=1e-6))


def clustered(seed, n, clusters=12, width=6):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(clusters, width)) * 20
    return [(i, [float(x) for x in centre[i % clusters] + rng.normal(size=width)]) for i in range(n)]


@pytest.mark.parametrize("pivots,block", [(256, 2048), (12, 40), (1, 7)])
def test_nearest(spark, pivots, block):
    judged, fitting = clustered(1, 150), [(i + 100, v) for i, v in clustered(1, 400)]
    frames = [spark.createDataFrame(rows, "k long, v array<double>").repartition(3) for rows in (judged, fitting)]
    got = neighbours.nearest(*frames, "k", "v", pivots, block).collect()
    same([(r.k, r.distance) for r in got], brute(judged, fitting))
    if pivots == 12:
        assert sum(r.compared for r in got) < 0.2 * len(judged) * len(fitting)


def test_nulls_ties_and_hot_vectors(spark):
    rows = [(1, None), (2, [0.0, None]), (None, [1.0, 1.0]), (3, [5.0, 5.0]), (3, [5.0, 5.0]), (3, [9.0, 9.0])] + [(100 + i, [2.0, 2.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, v array<double>")
    got = {}
    for r in neighbours.nearest(df, df, "k", "v", 4, 10).collect():
        got.setdefault(r.k, []).append(r.distance)
    assert got[1] == got[2] == [None]
    assert got[100] == [0.0] and got[3] == pytest.approx([np.sqrt(18), np.sqrt(18), np.sqrt(98)]) or sorted(got[3]) == pytest.approx(sorted([np.sqrt(18), np.sqrt(18), np.sqrt(98)]))


def test_lone_and_none(spark):
    lone = spark.createDataFrame([(1, [1.0, 2.0])], "k long, v array<double>")
    (got,) = neighbours.supported(lone, lone, "k", "v").collect()
    assert (got.distance, got.supported) == (None, False)
    empty = lone.limit(0)
    (got,) = neighbours.supported(lone, empty, "k", "v").collect()
    assert (got.distance, got.supported) == (None, False)
    assert neighbours.supported(empty, lone, "k", "v").count() == 0


def test_standardised_columns_against_a_fitting_set(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(np.exp(rng.normal())), None if i % 9 == 0 else float(rng.normal()), 3.0, i % 3 > 0) for i in range(200)] + [(999, 1e6, 0.0, 3.0, False)]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double, fits boolean")
    vector = neighbours.standardised(df.where("fits"), ["a", "b", "c"], logs=["a"])
    df = df.withColumn("v", vector)
    own = {r.k: (r.v, r.fits) for r in df.collect()}
    got = {r.k: r for r in neighbours.supported(df, df.where("fits"), "k", "v", quantile=0.9).collect()}
    fit = np.array([v for v, f in own.values() if f])
    assert np.allclose(fit.mean(0), 0, atol=1e-9) or np.allclose(fit[:, 0].mean(), 0, atol=1e-9)
    assert not got[999].supported and all(v[2] == 0 for v, _ in own.values())
    leave = [d for _, d in brute([(k, v) for k, (v, f) in own.items() if f], [(k, v) for k, (v, f) in own.items() if f])]
    limit = np.quantile(leave, 0.9)
    for k, d in brute([(k, v) for k, (v, _) in own.items()], [(k, v) for k, (v, f) in own.items() if f]):
        assert got[k].distance == pytest.approx(d, abs=1e-6)
        if abs(d - limit) > 1e-9:
            assert got[k].supported == (d <= limit)


def test_query_of_support(spark):
    folder = "/root/testdata/sf0.001"
    known = pq.read_table(f"{folder}/embeddings.parquet").to_pylist()
    x = np.array([r["embedding"] for r in known], np.float64)
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    limit = np.quantile(d.min(1), 0.95)
    got = {r.vec_id: r for r in composites.nearest_support(Tables(spark, folder)).collect()}
    for r, e in zip(known, d.min(1), strict=True):
        assert abs(got[r["vec_id"]].distance - e) < 1e-4
        if abs(e - limit) > 1e-9:
            assert got[r["vec_id"]].supported == (e <= limit)


def test_a_row_is_kept_once_whatever_it_reaches(spark, monkeypatch):
    """Where bounds leave all cells open, rows are not repeated for each cell, and batches of them stay small."""
    rng, seen = np.random.default_rng(8), {}
    rows = [(i, [float(x) for x in rng.normal(size=32)]) for i in range(300)]
    plain = neighbours.kept

    def watched(df, name):
        out = plain(df, name)
        seen.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(neighbours, "kept", watched)
    df = spark.createDataFrame(rows, "k long, v array<double>")
    got = neighbours.nearest(df, df, "k", "v", 64, 100).collect()
    same([(r.k, r.distance) for r in got], brute(rows, rows))
    assert seen["reached"] == [300, 300]
