"""Slopes of a family of edits with each edit left out, given only where the stored slopes of the whole family come out again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugespark.operators.resampling import drawn_sums
from gaugespark.sources.kept import kept

#: What stands for no edit in the column without, and for the point estimate in draw.
WHOLE, POINT = "", -1


def drawn_slopes(df: DataFrame, unit: str, system: str, edit: str, y: Column, x: Column, draws: int, weight) -> DataFrame:
    """draw, system, without, slope: slopes through the origin over the edits' mean contrasts, of the point (draw POINT) and of each draw.

    An edit counts by its squared mean x: slope = sum(mean y * mean x) / sum(mean x ** 2)
    over edits; without names the edit that is left out, WHOLE none. Rows
    without y, x, system or edit don't count, nor do those without a unit; an edit
    that a draw leaves empty is not in that draw, and a system that has no other
    has no row there. A slope over no edits, or over mean x of 0, is null. Rows
    are summed to their unit before they meet the draws.
    """
    rows = df.select(F.col(unit).alias("unit"), F.col(system).cast("string").alias("system"), F.col(edit).cast("string").alias("edit"), y.cast("double").alias("y"), x.cast("double").alias("x"))
    units = kept(rows.dropna().groupBy("unit", "system", "edit").agg(F.sum("y").alias("y"), F.sum("x").alias("x"), F.count("*").alias("n")), "unit-cells")
    drawn = drawn_sums(units, "unit", ["system", "edit"], ["y", "x", "n"], draws, weight).where("n > 0").drop("_t")
    point = units.groupBy("system", "edit").agg(*[F.sum(c).alias(c) for c in ("y", "x", "n")])
    means = drawn.unionByName(point.withColumn("draw", F.lit(POINT))).withColumn("e", F.struct("edit", (F.col("y") / F.col("n")).alias("y"), (F.col("x") / F.col("n")).alias("x")))
    family = means.groupBy("draw", "system").agg(F.sort_array(F.collect_list("e")).alias("e"))
    each = family.withColumn("without", F.explode(F.concat(F.array(F.lit(WHOLE)), "e.edit")))
    left = F.filter("e", lambda e: e["edit"] != F.col("without"))
    total = lambda a, b: F.aggregate(left, F.lit(0.0), lambda s, e: s + e[a] * e[b])
    return each.select("draw", "system", "without", F.try_divide(total("y", "x"), total("x", "x")).alias("slope"))


def unproduced(mine: DataFrame, stored: DataFrame, key: str, columns: list[str], tolerance: float = 1e-9) -> DataFrame:
    """key of rows that only one side has, or whose values differ by more than tolerance of the stored size (at least 1). Two nulls are alike."""
    both = mine.select(F.col(key).alias("_mine"), *[F.col(c).alias(f"_{c}") for c in columns]).join(stored.select(key, *columns), F.col("_mine").eqNullSafe(F.col(key)), "full_outer")
    alike = lambda c: F.when(F.col(c).isNull() | F.col(f"_{c}").isNull(), F.col(c).isNull() & F.col(f"_{c}").isNull()).otherwise(F.abs(F.col(c) - F.col(f"_{c}")) <= tolerance * F.greatest(F.lit(1.0), F.abs(c)))
    wrong = F.col("_mine").isNull() | F.col(key).isNull()
    for c in columns:
        wrong = wrong | ~alike(c)
    return both.where(wrong).select(F.coalesce(key, "_mine").alias(key))


def slopes_without(df: DataFrame, unit: str, system: str, edit: str, y: Column, x: Column, stored: DataFrame, draws: int, weight, level: float = 0.95, tolerance: float = 1e-9) -> DataFrame:
    """without, system, slope, low, high: each edit left out in turn, and none (WHOLE).

    Intervals hold for all systems of one without together (max-t over its
    draws). stored has system and slope, and may have low and high, of the whole
    family as reported before; unless all of it comes out again, and no system
    more, ValueError names some of those that don't. Edits' names aren't empty.
    """
    slopes = kept(drawn_slopes(df, unit, system, edit, y, x, draws, weight), "slopes")
    taken = slopes.where((F.col("draw") != POINT) & F.col("slope").isNotNull())
    spread = taken.groupBy("without", "system").agg(F.stddev_samp("slope").alias("se"), F.avg("slope").alias("centre"))
    t = taken.join(spread, ["without", "system"]).where("se > 0").groupBy("without", "draw").agg(F.max(F.abs(F.col("slope") - F.col("centre")) / F.col("se")).alias("t"))
    critical = t.groupBy("without").agg(F.percentile("t", level).alias("c"))
    found = slopes.where(F.col("draw") == POINT).join(spread, ["without", "system"], "left").join(critical, "without", "left")
    margin = F.col("c") * F.col("se")
    out = kept(found.select("without", "system", "slope", (F.col("slope") - margin).alias("low"), (F.col("slope") + margin).alias("high")), "slopes-without")
    reported = [c for c in ("slope", "low", "high") if c in stored.columns]
    wrong = [r[0] for r in unproduced(out.where(F.col("without") == WHOLE), stored.withColumn("system", F.col("system").cast("string")), "system", reported, tolerance).limit(20).collect()]
    if wrong:
        raise ValueError(f"stored slopes do not come out again: {sorted(map(str, wrong))}")
    return out
