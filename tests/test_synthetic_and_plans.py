"""Made-up records, calls whose failures are rows, and spline bases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugespark.functions import values
from gaugespark.plans import calls
from gaugespark.sources import synthetic


def test_cohort_depends_on_keys_alone(spark):
    one = synthetic.cohort(spark, 3000, 5)
    again = synthetic.cohort(spark, 3000, 5).repartition(7)
    assert one.exceptAll(again).count() == 0
    assert synthetic.cohort(spark, 3000, 6).exceptAll(one).count() > 2500
    d = one.toPandas()
    assert d.age.between(40, 79).all() and 0.02 < d.sbp_mmhg.isna().mean() < 0.09
    assert d.groupby(d.age >= 65).death_10y.mean().diff().iloc[-1] > 0.1
    assert 0.15 < (d.split == "eval").mean() < 0.25


def test_respondents_follow_the_truth(spark):
    records = synthetic.cohort(spark, 1500, 1)
    out = synthetic.respondents(records, "SEQN", F.col("true_logit"), [("close", 0.1, 0.0), ("far", 2.0, 0.1)]).join(records, "SEQN").toPandas()
    out["truth"] = 1 / (1 + np.exp(-out.true_logit))
    error = out[out.valid].groupby("system").apply(lambda g: (g.p - g.truth).abs().mean(), include_groups=False)
    assert error["close"] < 0.03 < error["far"]
    assert out[out.system == "close"].valid.all() and 0.05 < (~out[out.system == "far"].valid).mean() < 0.15


def test_failing_calls_are_rows(spark):
    def answer(call):
        return {"p": 1.0 / call["n"]}

    rows = {r.n: (r.p, r.error) for r in calls.executed(spark.createDataFrame([(0,), (2,)], "n int"), answer, "p double").collect()}
    assert rows[2] == (0.5, None)
    assert rows[0][0] is None and rows[0][1].startswith("ZeroDivisionError")


def test_requests_are_keyed_by_sorted_names(spark):
    df = spark.createDataFrame([(1, "x")], "b int, a string")
    same = {calls.keyed(df, parts).first().request_key for parts in (["a", "b"], ["b", "a"])}
    assert len(same) == 1 and len(same.pop()) == 24


def test_spline_basis(spark):
    knots = [1.0, 2.5, 3.0, 6.0]
    df = spark.createDataFrame([(float(x),) for x in np.linspace(-1, 8, 181)] + [(None,)], "x double")
    found = [list(r) for r in df.select("x", *[b.alias(f"b{i}") for i, b in enumerate(values.spline_basis(F.col("x"), knots))]).collect()]
    assert all(v is None for v in found[-1])
    m = np.array(found[:-1])
    assert m.shape[1] == 1 + 6
    assert m[:, 1:].sum(1) == pytest.approx(np.ones(len(m)))
    outside = m[m[:, 0] < 1.0]
    assert np.abs(np.diff(outside[:, 1:], 2, axis=0)).max() < 1e-9
    steps = np.abs(np.diff(m[:, 1:], axis=0)).max()
    assert steps < 0.2  # no jumps at the knots
    t = [1.0] * 3 + knots + [6.0] * 3
    greville = np.array([sum(t[i + 1 : i + 4]) / 3 for i in range(6)])
    assert m[:, 1:] @ greville == pytest.approx(m[:, 0])  # straight lines are reproduced
