"""Slopes with an edit left out against plain loops, and the check of stored values before them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugespark.operators import slopes

SCHEMA = "u long, s string, e string, y double, x double"
ROWS = [(u, s, e, 0.5 * u + len(s) + i, 1.0 + i + u % 3) for u in range(12) for s in ("a", "bb") for i, e in enumerate(("p", "q", "r"))]
DRAWS = 40


def weights(unit, draw):
    return F.pmod(unit * 7 + draw * 5 + F.shiftright(unit * draw, 1), F.lit(3))


def by_hand(rows, draws):
    """(draw, system, without): slope."""
    w = lambda u, d: 1 if d < 0 else (u * 7 + d * 5 + ((u * d) >> 1)) % 3
    out = {}
    for d in range(-1, draws):
        for s in {r[1] for r in rows}:
            means = {}
            for e in {r[2] for r in rows if r[1] == s}:
                mine = [r for r in rows if r[1] == s and r[2] == e]
                n = sum(w(r[0], d) for r in mine)
                if n:
                    means[e] = (sum(w(r[0], d) * r[3] for r in mine) / n, sum(w(r[0], d) * r[4] for r in mine) / n)
            for without in ["", *means] if means else []:
                left = [v for e, v in means.items() if e != without]
                below = sum(x * x for _, x in left)
                out[d, s, without] = sum(y * x for y, x in left) / below if below else None
    return out


def test_slopes_of_draws(spark):
    odd = [(1, "a", None, 9.0, 9.0), (1, None, "p", 9.0, 9.0), (2, "a", "p", None, 1.0), (3, "only", "p", 2.0, 4.0), (3, "flat", "p", 2.0, 0.0)]
    df = spark.createDataFrame(ROWS + odd, SCHEMA).withColumn("draw", F.lit("clash"))
    got = {(r.draw, r.system, r.without): r.slope for r in slopes.drawn_slopes(df, "u", "s", "e", F.col("y"), F.col("x"), DRAWS, weights).collect()}
    want = by_hand([r for r in ROWS + odd if None not in r], DRAWS)
    assert got.keys() == want.keys()
    assert got[-1, "only", ""] == 0.5 and got[-1, "only", "p"] is None and got[-1, "flat", ""] is None
    for k, v in want.items():
        assert got[k] == (None if v is None else pytest.approx(v))


def test_intervals_and_stored_values(spark):
    df, want = spark.createDataFrame(ROWS, SCHEMA), by_hand(ROWS, DRAWS)
    stored = spark.createDataFrame([(s, want[-1, s, ""]) for s in ("a", "bb")], "system string, slope double")
    run = lambda kept: slopes.slopes_without(df, "u", "s", "e", F.col("y"), F.col("x"), kept, DRAWS, weights)
    got = {(r.without, r.system): r for r in run(stored).collect()}
    assert len(got) == 8
    for without in ("", "p", "q", "r"):
        drawn = np.array([[want[d, s, without] for s in ("a", "bb")] for d in range(DRAWS)])
        se = drawn.std(0, ddof=1)
        c = np.quantile((abs(drawn - drawn.mean(0)) / se).max(1), 0.95)
        for i, s in enumerate(("a", "bb")):
            r = got[without, s]
            assert (r.slope, r.low, r.high) == pytest.approx((want[-1, s, without], want[-1, s, without] - c * se[i], want[-1, s, without] + c * se[i]))
    # reported intervals are held too; a changed, missing or further system stops the work
    whole = run(stored).where("without = ''").drop("without")
    assert run(whole).count() == 8
    for wrong in (whole.withColumn("high", F.col("high") + F.when(F.col("system") == "bb", 1e-6).otherwise(0)), stored.where("system = 'a'")):
        with pytest.raises(ValueError, match=r"\['bb'\]"):
            run(wrong)
    with pytest.raises(ValueError, match="more"):
        run(stored.unionByName(spark.createDataFrame([("more", 1.0)], "system string, slope double")))


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert slopes.slopes_without(none, "u", "s", "e", F.col("y"), F.col("x"), spark.createDataFrame([], "system string, slope double"), 5, weights).count() == 0
