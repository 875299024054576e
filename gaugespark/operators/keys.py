"""Keys, duplicates, alignment, unions and dominance."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugespark.operators.ranks import running_minimum


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in an order that leaves no ties."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


def failing_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with how often: empty where keys are unique."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def outside_domain(df: DataFrame, column: str, labels: Sequence[str]) -> DataFrame:
    """Values that are not declared labels, with how often they occur."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*labels)).groupBy(column).agg(F.count("*").alias("n"))


def in_all(df: DataFrame, key: str, of: str, n: int) -> DataFrame:
    """The keys that occur with n different values of another column."""
    return df.groupBy(key).agg(F.count_distinct(of).alias("_n")).where(F.col("_n") == n).select(key)


def aligned(universe: DataFrame, df: DataFrame, keys: Sequence[str], fill: dict) -> DataFrame:
    """A row for each key of the universe, missing values filled."""
    return universe.join(df, list(keys), "left").na.fill(fill)


def substituted(df: DataFrame, column: str, value: str, new: DataFrame) -> DataFrame:
    """One group's rows replaced by another run's."""
    return df.where(F.col(column) != value).unionByName(new, allowMissingColumns=True)


def on_frontier(df: DataFrame, key: str, cost: str, error: str) -> DataFrame:
    """The rows that no other row dominates: cheaper or equal, no more wrong, one strictly.

    Costs and errors are reduced to the least error of each cost first; a row
    stays if no cheaper cost has as small an error, which a running minimum
    over ranges of costs tells, with no pairs made.
    """
    best = df.groupBy(cost).agg(F.min(error).alias("_best"))
    kept = running_minimum(best, cost, "_best", "_before").where("_before is null or _before > _best")
    return df.join(kept.select(F.col(cost).alias("_c"), "_best"), (F.col(cost) == F.col("_c")) & (F.col(error) == F.col("_best"))).drop("_c", "_best")


def flow(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """step, n: how many rows are left after each step, in one pass."""
    passed, counts = F.lit(True), []
    for k, (name, predicate) in enumerate(steps):
        passed = passed & F.coalesce(predicate, F.lit(False))
        counts.append(F.struct(F.lit(k).alias("position"), F.lit(name).alias("step"), F.count_if(passed).alias("n")))
    return df.agg(F.array(*counts).alias("flow")).select(F.explode("flow").alias("f")).select("f.*")


def stacked(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def crosstab(df: DataFrame, row: str, column: str, levels: Sequence[str]) -> DataFrame:
    """Counts of each row value by the given levels, zeros included."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == x).alias(f"n_{x.lower().replace(' ', '_')}") for x in levels])


def first_present(df: DataFrame, candidates: Sequence[str]) -> Column:
    """The first of the candidate columns that the table has (not the first without null); null if it has none."""
    return next((F.col(c) for c in candidates if c in df.columns), F.lit(None))


def staged_sample(df: DataFrame, level: str, entity: str, order: Sequence[str], k: int) -> DataFrame:
    """At most k rows of each level, in an order without ties; an entity is drawn once.

    Levels are few. They take their turn from the rarest on (of equally rare
    ones the smaller name first), each from the entities not yet drawn.
    """
    sizes = df.where(F.col(level).isNotNull()).groupBy(level).agg(F.count("*").alias("n")).orderBy("n", level).collect()
    drawn = None
    for name in (r[0] for r in sizes):
        rows = df.where(F.col(level) == name)
        if drawn is not None:
            rows = rows.join(F.broadcast(drawn.select(entity)), entity, "left_anti").select(df.columns)
        part = keep_one(rows, [entity], [F.col(c) for c in order]).orderBy(*order).limit(k)
        drawn = part if drawn is None else drawn.union(part)
    return drawn if drawn is not None else df.limit(0)
