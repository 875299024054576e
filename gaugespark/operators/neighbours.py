"""Exact distances to the nearest row of a fitting set, by pivots and the triangle inequality.

Fitting rows go to the cell of their nearest pivot (a bounded sample of them). A
judged row is first held against its own cell, then only against cells that may
hold a nearer one: those whose ring of distances from their pivot it can reach
with the best distance so far. Cells are packed into bins of like size (a large
one is dealt out over several), and rows meet a bin, not a cell, in parts of a
bounded size: a row is sent once for each bin that it reaches, so what is sent is
at most the table once for each bin, however many cells bounds leave open. Nothing
but the pivots and the cells' radii is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugespark.operators import ranks
from gaugespark.sources.kept import kept

#: The most pivots, whatever the table, and the rows of a bin and of those that meet it at once.
PIVOTS, BLOCK = 256, 8192
#: Rows of a batch and of a matrix of distances, and pairs whose distances are worked out anew at once.
_ROWS, _PAIRS = 512, 1 << 16


def standardised(fitting: DataFrame, columns: Sequence[str], logs: Sequence[str] = ()) -> Column:
    """A vector of columns by the fitting set's means and standard deviations; those in logs as log(1 + x).

    A missing or negative (in logs) value is put at the mean. A column without
    spread, or without any value, is 0 for all.
    """
    of = {c: F.when(F.col(c) >= 0, F.log1p(F.col(c).cast("double"))) if c in logs else F.col(c).cast("double") for c in columns}
    found = fitting.agg(*[f(of[c]).alias(f"{c}_{k}") for c in columns for k, f in (("mean", F.avg), ("sd", F.stddev_pop))]).first()

    def scaled(c: str) -> Column:
        mean, sd = found[f"{c}_mean"], found[f"{c}_sd"]
        return F.coalesce((of[c] - mean) / sd, F.lit(0.0)) if sd else F.lit(0.0)

    return F.array(*[scaled(c) for c in columns])


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0))


def nearest(judged: DataFrame, fitting: DataFrame, key: str, vector: str, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """key, distance, compared: the Euclidean distance of each judged row to the nearest fitting row of another key.

    compared is how many fitting rows it was held against. Rows whose vector is
    null or has a null are never near anything: their distance is null, as is
    that of a row without any other. Rows that repeat a key are one key's rows,
    and each has its own distance.
    """
    spark = judged.sparkSession
    whole = F.col(vector).isNotNull() & ~F.exists(F.col(vector), lambda v: v.isNull() | F.isnan(v.cast("double")))
    plain = lambda df: df.select(F.col(key).cast("string").alias("k"), F.when(whole, F.transform(vector, lambda v: v.cast("double"))).alias("v"))
    known = kept(plain(fitting).where("v is not null"), "fitting")
    asked = kept(judged.select(F.col(key).alias("_key"), F.monotonically_increasing_id().alias("row"), F.col(key).cast("string").alias("k"), F.when(whole, F.transform(vector, lambda v: v.cast("double"))).alias("v")), "judged")
    # the pivots: at most so many rows, those of least hash
    centres = np.array([r.v for r in known.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(pivots).collect()])
    if not len(centres):
        return asked.select(F.col("_key").alias(key), F.lit(None).cast("double").alias("distance"), F.lit(0).cast("long").alias("compared"))
    shared = spark.sparkContext.broadcast(centres)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _distances(_matrix(batch.column(1)), shared.value) if batch.num_rows else np.zeros((0, 1))
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], names=["k", "v", "cell", "far"])

    cells = kept(known.mapInArrow(placed, "k string, v array<double>, cell int, far double"), "cells")
    # a row for each pivot: its ring of distances, and how many rows its cell has
    rings = {r.cell: r for r in cells.groupBy("cell").agg(F.min("far").alias("low"), F.max("far").alias("high"), F.count("*").alias("n")).collect()}
    low, high = (np.array([getattr(rings[c], f) if c in rings else np.inf for c in range(len(centres))]) for f in ("low", "high"))
    # each cell's first bin and how many it has: small cells share one, in the order of their distance from the first pivot
    bins, held_by_last = {}, block
    last = -1
    for c in sorted(rings, key=lambda c: float(((centres[c] - centres[0]) ** 2).sum())):
        if rings[c].n > block:
            bins[c] = (last + 1, -(-rings[c].n // block))
            last, held_by_last = last + bins[c][1], block
            continue
        if held_by_last + rings[c].n > block:
            last, held_by_last = last + 1, 0
        bins[c], held_by_last = (last, 1), held_by_last + rings[c].n
    dealing = spark.createDataFrame([(c, *bins[c]) for c in bins], "cell int, bin int, bins int")
    spread = F.pmod(F.xxhash64("k", "v"), F.col("bins")).cast("int")
    dealt = cells.join(F.broadcast(dealing), "cell").select("k", "v", "cell", "far", (F.col("bin") + spread).alias("bin"))
    bounds = spark.sparkContext.broadcast((low, high))

    def open_cells(d: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Which cells rows must be held against: their own without a best distance, else the others that may beat it."""
        low, high = bounds.value
        filled = np.isfinite(high)
        own = np.zeros(d.shape, bool)
        own[np.arange(len(d)), np.where(filled, d, np.inf).argmin(1)] = True
        gap = np.maximum(d - np.where(filled, high, 0), np.where(filled, low, 0) - d)
        # a margin for the rounding of distances
        reached = (gap < best[:, None] + 1e-6 * (1 + d)) & filled & ~own
        return np.where(np.isnan(best)[:, None], own, reached)

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with the bins of their open cells, a few rows at a time."""
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                found = open_cells(_distances(_matrix(part.column(2)), shared.value), part.column(3).to_numpy(zero_copy_only=False).astype(float))
                every = [sorted({b for c in np.flatnonzero(row) for b in range(bins[c][0], sum(bins[c]))}) for row in found]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(every, pa.list_(pa.int32()))], names=["row", "k", "v", "best", "to"])

    def against(one: pa.Table, two: pa.Table) -> pa.Table:
        if not one.num_rows or not two.num_rows:
            return pa.table({"row": pa.array([], pa.int64()), "d": pa.array([], pa.float64()), "compared": pa.array([], pa.int64())})
        two = two.sort_by([("cell", "ascending"), ("far", "ascending")])
        far, cell, y = two.column("far").to_numpy(), two.column("cell").to_numpy(), _matrix(two.column("v"))
        # keys as numbers: equal where keys are, and -1 for none
        names = pa.chunked_array([*one.column("k").chunks, *two.column("k").chunks]).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        mine, k = names[: one.num_rows], names[one.num_rows :]
        x, best = _matrix(one.column("v")), one.column("best").to_numpy(zero_copy_only=False).astype(float)
        squares = (y * y).sum(1)
        least, compared = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
        for at in range(0, len(x), _ROWS):
            away = _distances(x[at : at + _ROWS], shared.value)
            asks = open_cells(away, best[at : at + _ROWS])
            for c in np.unique(cell):
                rows = np.flatnonzero(asks[:, c])
                if not len(rows):
                    continue
                rows, d0 = rows + at, away[rows, c]
                # only rows of a ring about the pivot can be nearer than the best
                bound = np.where(np.isnan(best[rows]), np.inf, best[rows] + 1e-6 * (1 + d0))
                start, stop = np.searchsorted(cell, [c, c + 1])
                a = start + np.searchsorted(far[start:stop], (d0 - bound).min(), "left")
                b = start + np.searchsorted(far[start:stop], (d0 + bound).max(), "right")
                if a >= b:
                    continue
                # products name the rows that may be the nearest, whose distances are then worked out by differences
                size = (x[rows] ** 2).sum(1)
                d = size[:, None] + squares[a:b] - 2 * x[rows] @ y[a:b].T
                d[mine[rows][:, None] == k[a:b]] = np.inf
                margin = 1e-12 * (size + squares[a:b].max())
                at_best = np.minimum(d.min(1), least[rows] ** 2)
                one_of, other = np.nonzero(np.isfinite(d) & (d <= (at_best + margin)[:, None]))
                for s in range(0, len(one_of), _PAIRS):
                    i, j = one_of[s : s + _PAIRS], other[s : s + _PAIRS]
                    np.minimum.at(least, rows[i], np.sqrt(((x[rows[i]] - y[a + j]) ** 2).sum(1)))
                compared[rows] += b - a
        return pa.table({"row": one.column("row"), "d": least, "compared": compared})

    def held(rows: DataFrame) -> DataFrame:
        """row, d, compared: the least distances in the cells that rows reach."""
        cast = kept(rows.mapInArrow(reach, "row long, k string, v array<double>, best double, to array<int>"), "reached")
        asked_of = cast.withColumn("bin", F.explode("to")).drop("to")
        # of a bin that many rows reach, these are dealt out too: a row for each bin says to how many parts
        parts = kept(asked_of.groupBy("bin").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")), "parts")
        one = asked_of.join(F.broadcast(parts), "bin").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).drop("parts")
        two = dealt.join(F.broadcast(parts), "bin").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        met = one.groupBy("bin", "part").cogroup(two.groupBy("bin", "part")).applyInArrow(against, "row long, d double, compared long")
        return met.groupBy("row").agg(F.min("d").alias("d"), F.sum("compared").alias("compared"))

    whole_rows = asked.where("v is not null").select("row", "k", "v")
    own = kept(held(whole_rows.withColumn("best", F.lit(None).cast("double"))), "own-cells")
    second = whole_rows.join(own.select("row", F.col("d").alias("best")), "row").select("row", "k", "v", "best")
    other = kept(held(second), "other-cells")
    both = own.unionByName(other).groupBy("row").agg(F.min("d").alias("d"), F.sum("compared").alias("compared"))
    distance = F.when(F.col("d") < float("inf"), F.col("d"))
    return asked.join(both, "row", "left").select(F.col("_key").alias(key), distance.alias("distance"), F.coalesce("compared", F.lit(0)).cast("long").alias("compared"))


def supported(judged: DataFrame, fitting: DataFrame, key: str, vector: str, quantile: float = 0.95, **options) -> DataFrame:
    """key, distance, supported: whether a row is as near to the fitting set as that quantile of its own rows are to each other.

    A row without a distance is not supported; nor is any where the fitting set
    has no two rows.
    """
    own = nearest(fitting, fitting, key, vector, **options)
    limit = ranks.percentiles(own, "distance", (quantile,)).select(F.col("p")[0].alias("limit"))
    limit = fitting.sparkSession.range(1).join(F.broadcast(limit), F.lit(True), "left").select("limit")
    asked = own if judged is fitting else nearest(judged, fitting, key, vector, **options)
    return asked.join(F.broadcast(limit)).select(key, "distance", F.coalesce(F.col("distance") <= F.col("limit"), F.lit(False)).alias("supported"))
