"""Column builders for cleaning, banding and scoring values."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def missing_if_nan(c: Column) -> Column:
    """NaN is a missing value here, so it is null from the first projection on."""
    return F.when(~F.isnan(c), c)


def missing_if_negative(c: Column) -> Column:
    return F.when(c >= 0, c)


def true_or_false(c: Column) -> Column:
    """A predicate that a missing value makes false, also under a negation."""
    return F.coalesce(c, F.lit(False))


def ladder(c: Column, steps: Sequence[tuple[float, str]], top: str | None = None, inclusive: bool = False) -> Column:
    """The label of the first step whose bound c is below (or at, if inclusive); null stays null."""
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for bound, label in steps:
        out = out.when((c <= bound) if inclusive else (c < bound), label)
    return out.otherwise(F.lit(top))


def ladder_by(group: Column, ladders: dict[str, Column]) -> Column:
    """One ladder for each value of group; null for other groups."""
    out = F.lit(None).cast("string")
    for value, column in ladders.items():
        out = F.when(group == value, column).otherwise(out)
    return out


def highest_of(first: Column, second: Column, steps: Sequence[tuple[float, float, str]], lowest: str) -> Column:
    """The highest category that either reading reaches; steps run from high to low."""
    out = F.when(first.isNull() & second.isNull(), F.lit(None).cast("string"))
    for a, b, label in steps:
        out = out.when(true_or_false(first >= a) | true_or_false(second >= b), label)
    return out.otherwise(lowest)


def coded(c: Column, codes: dict) -> Column:
    """The label of a code; null for a code that isn't listed."""
    out = F.lit(None).cast("string")
    for code, label in codes.items():
        out = F.when(c == code, label).otherwise(out)
    return out


def tri_state(c: Column) -> Column:
    return F.when(c == 1, "yes").when(c == 0, "no")


def mean_of_present(*cs: Column) -> Column:
    """The mean of the readings that are neither null nor 0."""
    kept = F.filter(F.array(*[F.nullif(c.cast("double"), F.lit(0.0)) for c in cs]), lambda x: x.isNotNull())
    return F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(kept), F.lit(0))


def any_of(*cs: Column) -> Column:
    """yes if one column is yes, no if all are no, else null."""
    answers = F.array(*cs)
    return F.when(true_or_false(F.array_contains(answers, "yes")), "yes").when(F.forall(answers, lambda x: true_or_false(x == "no")), "no")


def top_coded(c: Column, cap: float) -> Column:
    """A number as text, '> n' read as cap, anything else missing."""
    return F.when(F.trim(c).startswith(">"), F.lit(cap)).otherwise(F.trim(c).try_cast("double"))


def at_least_known(k: int, *cs: Column) -> Column:
    return sum((c.isNotNull().cast("int") for c in cs), F.lit(0)) >= k


def clipped(p: Column, low: float = 0.005) -> Column:
    return F.least(F.greatest(p, F.lit(low)), F.lit(1 - low))


def log_odds(p: Column, low: float = 0.005) -> Column:
    q = clipped(p, low)
    return F.ln(q / (1 - q))


def from_log_odds(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def log_loss(p: Column, y: Column, low: float = 1e-6) -> Column:
    q = clipped(p, low)
    return -(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """The Wilson interval of k out of n."""
    p, d = k / n, 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return mid - half, mid + half


def filtration_rate(creatinine: Column, age: Column, sex: Column) -> Column:
    """CKD-EPI 2021 creatinine equation (fixed published coefficients)."""
    female = sex == "female"
    k, a = F.when(female, 0.7).otherwise(0.9), F.when(female, -0.241).otherwise(-0.302)
    r = creatinine / k
    return 142 * F.pow(F.least(r, F.lit(1.0)), a) * F.pow(F.greatest(r, F.lit(1.0)), F.lit(-1.2)) * F.pow(F.lit(0.9938), age) * F.when(female, 1.012).otherwise(1.0)


def tokens_estimated(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def brier(p: Column, truth: Column) -> Column:
    """Multiclass Brier score of an array of probabilities; truth counts from 0."""
    return F.aggregate(F.transform(p, lambda x, i: F.pow(x - (i == truth).cast("double"), F.lit(2.0))), F.lit(0.0), lambda a, x: a + x)


def ranked_score(p: Column, truth: Column) -> Column:
    """Ranked probability score: squared differences of the cumulative shares over levels - 1."""
    start = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("s"), F.lit(0).alias("i"))

    def step(a, x):
        c = a["c"] + x
        return F.struct(c.alias("c"), (a["s"] + F.pow(c - (a["i"] >= truth).cast("double"), F.lit(2.0))).alias("s"), (a["i"] + 1).alias("i"))

    return F.aggregate(p, start, step)["s"] / (F.size(p) - 1)


def jsonable(c: Column) -> Column:
    """Numbers that JSON has no word for become null."""
    return F.when(~(F.isnan(c) | c.isin(float("inf"), float("-inf"))), c)


#: Fixed values of the published phenotypic age mortality score (Levine 2018).
GOMPERTZ_WEIGHTS = {"albumin": -0.0336, "creatinine": 0.0095, "glucose": 0.1953, "log_crp": 0.0954, "lymphocytes": -0.0120, "mcv": 0.0268, "rdw": 0.3306, "alk_phos": 0.00188, "wbc": 0.0554, "age": 0.0804}
GOMPERTZ_INTERCEPT, GOMPERTZ_SHAPE = -19.907, 0.0076927


def gompertz_risk(given: dict[str, Column], months: int = 120) -> Column:
    """The risk of death within a time, of a Gompertz hazard on a linear score."""
    score = sum((F.lit(w) * given[name] for name, w in GOMPERTZ_WEIGHTS.items()), F.lit(GOMPERTZ_INTERCEPT))
    return 1 - F.exp(-F.exp(score) * F.lit((math.exp(months * GOMPERTZ_SHAPE) - 1) / GOMPERTZ_SHAPE))


def edited(value: Column, op: Column, amount: Column) -> Column:
    """A value after an edit: add, multiply or set."""
    return F.when(op == "add", value + amount).when(op == "multiply", value * amount).when(op == "set", amount)


def spline_basis(c: Column, knots: Sequence[float], degree: int = 3) -> list[Column]:
    """The B-spline basis on given knots as expressions, linear beyond the outer ones.

    There are len(knots) + degree - 1 columns, which sum to 1 everywhere.
    """
    t = [float(knots[0])] * degree + [float(k) for k in knots] + [float(knots[-1])] * degree
    low, high, last = t[0], t[-1], max(i for i in range(len(t) - 1) if t[i] < t[i + 1])

    def raised(x, b, d, zero):
        out = []
        for i in range(len(b) - 1):
            left = (x - t[i]) / (t[i + d] - t[i]) * b[i] if t[i + d] > t[i] else zero
            right = (t[i + d + 1] - x) / (t[i + d + 1] - t[i + 1]) * b[i + 1] if t[i + d + 1] > t[i + 1] else zero
            out.append(left + right)
        return out

    def at(x: float) -> tuple[list[float], list[float]]:
        """Values and slopes at one place."""
        b = [float(t[i] <= x < t[i + 1] or (x == high and i == last)) for i in range(len(t) - 1)]
        for d in range(1, degree):
            b = raised(x, b, d, 0.0)
        over = lambda i: degree / (t[i + degree] - t[i]) if t[i + degree] > t[i] else 0.0
        slopes = [over(i) * b[i] - over(i + 1) * b[i + 1] for i in range(len(b) - 1)]
        return raised(x, b, degree, 0.0), slopes

    inner = [F.when((c >= t[i]) & ((c <= t[i + 1]) if i == last else (c < t[i + 1])), 1.0).otherwise(0.0) if t[i] < t[i + 1] else F.lit(0.0) for i in range(len(t) - 1)]
    for d in range(1, degree + 1):
        inner = raised(c, inner, d, F.lit(0.0))
    (v0, s0), (v1, s1) = at(low), at(high)
    return [F.when(c < low, v0[i] + s0[i] * (c - low)).when(c > high, v1[i] + s1[i] * (c - high)).when(c.isNotNull(), b) for i, b in enumerate(inner)]


def _beta_below(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction (Lentz's method)."""
    swap = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    safe = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(x), 1 / safe(1 - (a + b) * x / (a + 1))
    value = d
    for m in range(1, 400):
        for factor in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / safe(1 + factor * d), safe(1 + factor / c)
            value = value * d * c
    logs = np.array([math.lgamma(p + q) - math.lgamma(p) - math.lgamma(q) for p, q in zip(a, b)])
    with np.errstate(divide="ignore"):
        front = np.exp(logs + a * np.log(x) + b * np.log1p(-x)) / a
    return np.where(swap, 1 - front * value, front * value)


def beta_quantile(p: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where the beta distribution reaches p, by bisection; a and b are positive."""
    low, high = np.zeros(len(a)), np.ones(len(a))
    for _ in range(60):
        mid = (low + high) / 2
        under = _beta_below(mid, a, b) < p
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return (low + high) / 2


def exact_intervals(df: DataFrame, k: str, n: str, level: float = 0.95) -> DataFrame:
    """df with low, high: the exact binomial interval of k of n; df is aggregated already."""
    tail = (1 - level) / 2

    def run(batches):
        for batch in batches:
            hits, tries = (batch[c].to_numpy(np.float64) for c in (k, n))
            edge = lambda p, a, b, fixed, at: np.where(fixed, at, beta_quantile(p, np.where(fixed, 1.0, a), np.where(fixed, 1.0, b)))
            low, high = edge(tail, hits, tries - hits + 1, hits == 0, 0.0), edge(1 - tail, hits + 1, tries - hits, hits == tries, 1.0)
            yield batch.assign(low=low, high=high)

    return df.mapInPandas(run, StructType([*df.schema.fields, StructField("low", DoubleType()), StructField("high", DoubleType())]))
