"""Models: a two-parameter logistic fit by aggregates, pipelines on pyspark.ml, cross-fitting."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from gaugespark.functions.values import spline_basis
from gaugespark.sources.kept import kept


#: The most lines that are fitted from the driver, and categories of a multinomial fit.
MOST_FITS, MOST_CATEGORIES = 10_000, 200
#: Folds that are fitted at a time.
FITS = 5


def logistic_line(df: DataFrame, x: Column, y: Column, w: Column, rounds: int = 30, ridge: float = 1e-8, stop: float = 1e-8) -> tuple[float, float]:
    """Intercept and slope of a weighted logistic fit; each round is one aggregation of six sums."""
    rows = df.select(x.cast("double").alias("x"), y.cast("double").alias("y"), w.cast("double").alias("w")).where("x is not null and y is not null and w > 0")
    beta = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-(F.lit(float(beta[0])) + F.lit(float(beta[1])) * F.col("x"))))
        v, r = F.col("w") * p * (1 - p), F.col("w") * (F.col("y") - p)
        s = rows.agg(F.sum(v), F.sum(v * F.col("x")), F.sum(v * F.col("x") * F.col("x")), F.sum(r), F.sum(r * F.col("x"))).first()
        if s[0] is None:
            break
        step = np.linalg.solve(np.array([[s[0] + ridge, s[1]], [s[1], s[2] + ridge]]), np.array([s[3], s[4]]) - ridge * beta)
        beta = beta + step
        if np.abs(step).max() < stop:
            break
    return float(beta[0]), float(beta[1])


def logistic_lines(df: DataFrame, fit: str, x: str, y: str, w: Column | None = None, rounds: int = 30, ridge: float = 1e-8, stop: float = 1e-8) -> DataFrame:
    """fit, intercept, slope: a weighted logistic line for each value of fit, all in one aggregation a round.

    Fits are few (halves, groups, draws): their coefficients are on the driver,
    and more than MOST_FITS are refused (least_squares.logistic_draws has any number).
    """
    spark = df.sparkSession
    rows = df.select(fit, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), (F.lit(1.0) if w is None else w.cast("double")).alias("_w")).where(f"{fit} is not null and _x is not null and _y is not null and _w > 0")
    kind = dict(df.dtypes)[fit]
    schema = f"{fit} {kind}, intercept double, slope double"
    beta = {r[0]: np.zeros(2) for r in rows.select(fit).distinct().limit(MOST_FITS + 1).collect()}
    if len(beta) > MOST_FITS:
        raise ValueError(f"more than {MOST_FITS} fits")
    told = lambda of: spark.createDataFrame([(k, float(b[0]), float(b[1])) for k, b in beta.items() if k in of], schema)
    open_fits = set(beta)
    for _ in range(rounds):
        if not open_fits:
            break
        placed = rows.join(F.broadcast(told(open_fits)), fit)
        p = 1 / (1 + F.exp(-(F.col("intercept") + F.col("slope") * F.col("_x"))))
        v, r = F.col("_w") * p * (1 - p), F.col("_w") * (F.col("_y") - p)
        for s in placed.groupBy(fit).agg(F.sum(v), F.sum(v * F.col("_x")), F.sum(v * F.col("_x") * F.col("_x")), F.sum(r), F.sum(r * F.col("_x"))).collect():
            k = s[0]
            step = np.linalg.solve(np.array([[s[1] + ridge, s[2]], [s[2], s[3] + ridge]]), np.array([s[4], s[5]]) - ridge * beta[k])
            beta[k] = beta[k] + step
            if np.abs(step).max() < stop:
                open_fits.discard(k)
    return told(beta)


def preparation(numbers: list[str], labels: list[str]) -> list:
    """Median-imputed, scaled numbers and one-hot labels as the stages of a pipeline."""
    stages: list = [Imputer(inputCols=numbers, outputCols=[f"{c}_i" for c in numbers], strategy="median")]
    parts = [f"{c}_i" for c in numbers]
    if labels:
        stages += [StringIndexer(inputCols=labels, outputCols=[f"{c}_x" for c in labels], handleInvalid="keep"), OneHotEncoder(inputCols=[f"{c}_x" for c in labels], outputCols=[f"{c}_o" for c in labels])]
        parts += [f"{c}_o" for c in labels]
    return [*stages, VectorAssembler(inputCols=parts, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="features")]


def spread(df: DataFrame) -> DataFrame:
    """df as a table of as many parts as there are cores, read in as many tasks.

    What rows come from is worked out once for all passes of a fit, and its few bytes
    don't leave hundreds of jobs to one task, nor to a task for each of a shuffle's parts.
    """
    spark = df.sparkSession
    return kept(df, "rows").repartition(max(1, spark.sparkContext.defaultParallelism))


def boosted(numbers: list[str], labels: list[str], y: str, rounds: int = 100) -> Pipeline:
    estimator = GBTClassifier(labelCol=y, maxIter=rounds, maxDepth=4, stepSize=0.1, subsamplingRate=0.8, minInstancesPerNode=20, seed=7)
    return Pipeline(stages=[*preparation(numbers, labels), estimator])


def predicted(model, df: DataFrame, keys: list[str]) -> DataFrame:
    return model.transform(df).select(*keys, vector_to_array("probability")[1].alias("p"))


def spline_design(train: DataFrame, numbers: list[str], skewed: Sequence[str] = (), knots: int = 4) -> tuple[list[Column], list[str], int]:
    """Columns and names of the cubic spline basis of each number and of its missing indicator, and train's rows.

    Medians and knots (quantiles) are those of train, a few numbers each. Missing
    values get the median; skewed numbers are taken as log(1 + x), x at least 0.
    """
    levels = [k / (knots - 1) for k in range(knots)]
    found = train.agg(*[F.percentile_approx(c, [0.5, *levels], 10000).alias(c) for c in numbers], *[F.count_if(F.col(c).isNull()).alias(f"{c}_none") for c in numbers], F.count("*").alias("_n")).first()
    columns, names = [], []
    for c in numbers:
        if found[c] is None:
            continue
        at = (lambda v: math.log1p(max(float(v), 0.0))) if c in skewed else float
        places = sorted({at(v) for v in found[c][1:]})
        if len(places) < 2:
            continue
        x = F.coalesce(F.col(c).cast("double"), F.lit(float(found[c][0])))
        x = F.log1p(F.greatest(x, F.lit(0.0))) if c in skewed else x
        basis = spline_basis(x, places)
        columns += [b.alias(f"{c}_s{i}") for i, b in enumerate(basis)]
        names += [f"{c}_s{i}" for i in range(len(basis))]
        if found[f"{c}_none"]:
            columns.append(F.col(c).isNull().cast("double").alias(f"{c}_none"))
            names.append(f"{c}_none")
    return columns, names, found["_n"]


def crossfitted(df: DataFrame, key: str, y: str, numbers: list[str], labels: list[str], folds: int = 10, skewed: Sequence[str] = (), c: float = 10.0) -> DataFrame:
    """key, y, fold, p: each row scored by a penalised spline fit of the other folds.

    The rows are kept as a table, so what they come from is worked out once for
    all passes of all fits; FITS folds are fitted at a time, each with its own jobs.
    A fold whose other folds are empty has no predictions.
    """
    placed = kept(df.withColumn("fold", F.pmod(F.xxhash64(key), F.lit(folds)).cast("int")).withColumn(y, F.col(y).cast("double")), "folds")
    if labels:  # which labels there are isn't learnt from the outcomes, so it is told once for all folds
        coded = [StringIndexer(inputCols=labels, outputCols=[f"{x}_x" for x in labels], handleInvalid="keep"), OneHotEncoder(inputCols=[f"{x}_x" for x in labels], outputCols=[f"{x}_o" for x in labels])]
        placed = Pipeline(stages=coded).fit(placed).transform(placed)

    def scored(k: int) -> DataFrame:
        train, held = placed.where(F.col("fold") != k), placed.where(F.col("fold") == k)
        basis, names, n = spline_design(train, numbers, skewed)
        if not n:
            return held.select(key, y, "fold", F.lit(None).cast("double").alias("p")).limit(0)
        assembled = VectorAssembler(inputCols=[*names, *[f"{x}_o" for x in labels]], outputCol="features")
        fit = LogisticRegression(labelCol=y, regParam=1 / (c * n), standardization=False, maxIter=30, tol=1e-5)
        model = Pipeline(stages=[assembled, fit]).fit(train.select("*", *basis))
        return predicted(model, held.select("*", *basis), [key, y, "fold"])

    with ThreadPool(FITS) as pool:
        parts = pool.map(inheritable_thread_target(df.sparkSession)(scored), range(folds))
    return reduce(DataFrame.unionByName, parts)


def hazard_logistic(numbers: list[str], period: str, event: str) -> Pipeline:
    """A hazard of each period's own level and the numbers' common effect."""
    stages = [OneHotEncoder(inputCols=[period], outputCols=[f"{period}_o"], dropLast=False, handleInvalid="keep"), VectorAssembler(inputCols=[*numbers, f"{period}_o"], outputCol="features")]
    return Pipeline(stages=[*stages, LogisticRegression(labelCol=event, regParam=1e-6, standardization=False)])


def category_probabilities(df: DataFrame, numbers: list[str], category: str, least: int = 50) -> DataFrame:
    """df with p, a map of each category's probability by a multinomial fit on the scaled numbers.

    Categories with fewer than `least` rows are left out of the fit and the map.
    """
    names = sorted(r[0] for r in df.where(F.col(category).isNotNull()).groupBy(category).agg(F.count("*").alias("n")).where(F.col("n") >= least).limit(MOST_CATEGORIES + 1).collect())
    if len(names) > MOST_CATEGORIES:
        raise ValueError(f"more than {MOST_CATEGORIES} categories")
    place = F.array_position(F.array(*[F.lit(x) for x in names]), F.col(category))
    indexed = df.withColumn("_label", F.when(place > 0, (place - 1).cast("double")))
    fitted = Pipeline(stages=[*preparation(numbers, []), LogisticRegression(labelCol="_label", family="multinomial", regParam=1e-4)]).fit(indexed.where("_label is not null"))
    told = vector_to_array("probability")
    return fitted.transform(indexed).withColumn("p", F.map_from_arrays(F.array(*[F.lit(x) for x in names]), told)).select(*df.columns, "p")


def regression(numbers: list[str], estimator) -> Pipeline:
    """Median-imputed, scaled numbers and an estimator on them."""
    return Pipeline(stages=[*preparation(numbers, []), estimator])
