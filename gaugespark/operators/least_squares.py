"""Least squares and logistic lines of many groups or draws at once, from sums.

A fit needs no more of its rows than the sums of products of its columns (the
normal matrix). They are aggregated with partial sums, for each group, or for
each resampling unit and then each draw, and only the small matrices are solved,
a batch of them at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugespark.sources.kept import kept


def products(terms: Sequence[Column], y: Column, w: Column | None = None) -> dict[str, Column]:
    """The products of an intercept, the terms and y with each other, by name: the upper half of a normal matrix."""
    every = [F.lit(1.0), *[c.cast("double") for c in terms], y.cast("double")]
    weight = F.lit(1.0) if w is None else w.cast("double")
    return {f"_g{i}_{j}": weight * every[i] * every[j] for i in range(len(every)) for j in range(i, len(every))}


def pivoted_solution(normal: np.ndarray, right: np.ndarray, ridge: np.ndarray | float = 0.0, tolerance: float = 1e-9, first: int = 1) -> np.ndarray:
    """Coefficients of one system by Cholesky with pivots, the largest left share of a column next.

    The first columns (the intercept) are taken in order. A column of which no
    more than `tolerance` of its size is left, once the others are taken out, is
    left out of the fit: its coefficient is nan.
    """
    a, n = normal + np.diag(np.broadcast_to(ridge, len(normal))), len(normal)
    size = np.maximum(np.diag(a).copy(), 1e-300)
    rest, factor, order = a.astype(float).copy(), np.zeros((n, n)), []
    while len(order) < n:
        left = np.diag(rest) / size
        left[order] = -1
        # of equally good columns, the earlier
        pick = len(order) if len(order) < first else int(np.argmax(np.round(left, 12)))
        if left[pick] <= tolerance:
            break
        column = rest[:, pick] / np.sqrt(rest[pick, pick])
        factor[:, len(order)] = column
        rest -= np.outer(column, column)
        order.append(pick)
    out, k = np.full(n, np.nan), len(order)
    if k:
        lower = factor[order][:, :k]
        out[order] = np.linalg.solve(lower.T, np.linalg.solve(lower, right[order]))
    return out


def solved(sums: DataFrame, keys: Sequence[str], names: Sequence[str], ridge: float = 0.0) -> DataFrame:
    """keys, n (the sum of weights), intercept and a column for each of names: fits of rows of summed products.

    The intercept is not penalised. A column that the others determine is left
    out of its row's fit and null; so are all of a row without weight.
    """
    size = len(names) + 2
    at = [(i, j) for i in range(size) for j in range(i, size)]
    fields = ["intercept", *names]
    penalty = np.array([0.0] + [ridge] * len(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            full = np.zeros((batch.num_rows, size, size))
            for k, (i, j) in enumerate(at):
                values = batch.column(len(keys) + k).cast(pa.float64()).fill_null(0.0).to_numpy()
                full[:, i, j] = full[:, j, i] = values
            found = np.array([pivoted_solution(m[:-1, :-1], m[:-1, -1], penalty) for m in full]).reshape(batch.num_rows, size - 1)
            columns = [batch.column(k) for k in range(len(keys))] + [pa.array(full[:, 0, 0])]
            columns += [pa.array(found[:, k], mask=np.isnan(found[:, k])) for k in range(size - 1)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "n", *fields])

    kinds = dict(sums.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["n double"] + [f"`{f}` double" for f in fields])
    return sums.select(*keys, *[f"_g{i}_{j}" for i, j in at]).mapInArrow(run, schema)


def joint_slopes(df: DataFrame, group: Sequence[str], terms: dict[str, Column], y: Column, w: Column | None = None) -> DataFrame:
    """group, n, intercept and a slope for each term: joint least squares of each group, in one aggregation.

    Terms are centred on their group's first row by neither side: keep them of
    like size, since sums of squares lose what is under 1e-9 of a column. Rows
    with a null in any column don't count. A term that the others determine is
    left out and null.
    """
    used = df.select(*group, *[c.cast("double").alias(f"_t_{n}") for n, c in terms.items()], y.cast("double").alias("_y"), (F.lit(1.0) if w is None else w.cast("double")).alias("_w")).dropna(subset=[*[f"_t_{n}" for n in terms], "_y", "_w"])
    sums = used.groupBy(*group).agg(*[F.sum(c).alias(n) for n, c in products([F.col(f"_t_{n}") for n in terms], F.col("_y"), F.col("_w")).items()])
    return solved(sums, list(group), list(terms))


def logistic_draws(cells: DataFrame, keys: Sequence[str], x: str, n: str, y: str, rounds: int = 30, ridge: float = 1e-8, stop: float = 1e-8) -> DataFrame:
    """keys, intercept, slope: a logistic line for each key (a draw, a half of it) from counted cells.

    cells has a row for each key and x, with how many rows it stands for and how
    many of them are hits. All keys take a Newton step in one grouped aggregation
    a round; those whose step is under `stop` drop out of the next one. A key of
    one x only gets the least line that the ridge leaves, one without cells no row.
    """
    keys = list(keys)
    cells = kept(cells.select(*keys, F.col(x).cast("double").alias("_x"), F.col(n).cast("double").alias("_n"), F.col(y).cast("double").alias("_y")).where("_x is not null and _n > 0"), "cells")
    zero = F.lit(0.0)
    open_ = kept(cells.select(*keys).distinct().withColumns({"_a": zero, "_b": zero}), "states")
    done = []
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-(F.col("_a") + F.col("_b") * F.col("_x"))))
        v, r = F.col("_n") * p * (1 - p), F.col("_y") - F.col("_n") * p
        sums = cells.join(open_, keys).groupBy(*keys, "_a", "_b").agg(F.sum(v).alias("s"), F.sum(v * F.col("_x")).alias("sx"), F.sum(v * F.col("_x") * F.col("_x")).alias("sxx"), F.sum(r).alias("r"), F.sum(r * F.col("_x")).alias("rx"))
        s, sxx, r0, r1 = F.col("s") + ridge, F.col("sxx") + ridge, F.col("r") - ridge * F.col("_a"), F.col("rx") - ridge * F.col("_b")
        whole = s * sxx - F.col("sx") * F.col("sx")
        regular = F.when(whole > 1e-15 * s * sxx, whole)
        da, db = (sxx * r0 - F.col("sx") * r1) / regular, (s * r1 - F.col("sx") * r0) / regular
        moved = sums.select(*keys, (F.col("_a") + da).alias("_a"), (F.col("_b") + db).alias("_b"), F.greatest(F.abs(da), F.abs(db)).alias("_step"))
        moved = kept(moved, "states")
        done.append(moved.where(F.coalesce(F.col("_step") < stop, F.lit(True))))
        open_ = moved.where(F.col("_step") >= stop).drop("_step")
        if open_.isEmpty():
            break
    else:
        done.append(open_.withColumn("_step", F.lit(stop)))
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return every.select(*keys, F.col("_a").alias("intercept"), F.col("_b").alias("slope"))
