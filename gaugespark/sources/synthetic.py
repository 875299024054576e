"""Made-up records and answers: every value is a function of its row's key and a seed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: int, *parts: Column) -> Column:
    """A number from 0 to 1 that depends on the parts and the seed alone."""
    return F.xxhash64(F.lit(seed), *parts).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)


def normal(seed: int, *parts: Column) -> Column:
    """Nearly standard normal: the sum of twelve uniform numbers less 6."""
    return sum((uniform(seed + k, *parts) for k in range(12)), F.lit(-6.0))


def one_of(u: Column, shares: dict[str, float]) -> Column:
    """A label by cumulative shares."""
    out, upto, labels = None, 0.0, list(shares)
    for label in labels[:-1]:
        upto += shares[label]
        out = F.when(u < upto, label) if out is None else out.when(u < upto, label)
    return out.otherwise(labels[-1])


def cohort(spark: SparkSession, n: int, seed: int = 0, eval_share: float = 0.2) -> DataFrame:
    """n records: SEQN, age, sex, smoking, sbp_mmhg, bmi (some missing), death_10y, true_logit, split."""
    u = lambda k: uniform(seed + 100 * k, F.col("SEQN"))
    z = lambda k: normal(seed + 100 * k, F.col("SEQN"))
    base = spark.range(1, n + 1).select(F.col("id").alias("SEQN")).select(
        "SEQN", (40 + F.floor(40 * u(1))).cast("int").alias("age"), one_of(u(2), {"female": 0.52, "male": 0.48}).alias("sex"), one_of(u(3), {"never": 0.5, "former": 0.3, "current": 0.2}).alias("smoking"),
        F.when(u(4) >= 0.05, F.round(125 + 18 * z(5), 0)).alias("sbp_mmhg"), F.when(u(6) >= 0.03, F.round(28 + 5 * z(7), 1)).alias("bmi"),
    )
    logit = -7.5 + 0.085 * F.col("age") + F.when(F.col("sex") == "male", 0.4).otherwise(0.0) + F.when(F.col("smoking") == "current", 0.8).otherwise(0.0) + 0.01 * (F.coalesce("sbp_mmhg", F.lit(125.0)) - 125)
    scored = base.withColumn("true_logit", logit)
    return scored.withColumn("death_10y", (u(8) < 1 / (1 + F.exp(-F.col("true_logit")))).cast("int")).withColumn("split", F.when(u(9) < eval_share, "eval").otherwise("fit"))


def respondents(items: DataFrame, key: str, truth: Column, systems: Sequence[tuple[str, float, float]], seed: int = 0) -> DataFrame:
    """key, system, p, valid: answers of systems (name, noise, share invalid), on a grid of hundredths."""
    spec = F.explode(F.array(*[F.struct(F.lit(n).alias("system"), F.lit(float(s)).alias("noise"), F.lit(float(i)).alias("invalid")) for n, s, i in systems]))
    rows = items.select(F.col(key), truth.alias("_z"), spec.alias("s")).select(key, "_z", "s.*")
    p = F.bround(1 / (1 + F.exp(-(F.col("_z") + F.col("noise") * normal(seed, F.col(key), F.col("system"))))), 2)
    valid = uniform(seed + 50, F.col(key), F.col("system")) >= F.col("invalid")
    return rows.select(key, "system", F.when(valid, p).alias("p"), valid.alias("valid"))
