"""Ranks, running sums, percentiles and range frames.

Ranks over a whole table don't go through one task: values are counted first,
cut into ranges by an approximate summary, summed within each range, and the
few range totals give the offsets. Ranges grow in number with the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugespark.sources.kept import kept

#: About how many rows a range has, and the most ranges (each has a number on the driver).
ROWS, MOST = 500_000, 1024
_INFINITE = float("inf")


def _ranges(df: DataFrame, order: str) -> int:
    """How many ranges a table is cut into."""
    return max(1, min(MOST, -(-df.agg(F.count(order)).first()[0] // ROWS)))


def _ranged(df: DataFrame, order: str, name: str) -> tuple[DataFrame, list]:
    """df with the range, from 0, that its value of a numeric column falls in, and the hot values.

    A range has its least value and those up to the next one's. Values that
    fill more than one range are hot: the ranges that begin with them hold them
    first. Nulls are in the first range.
    """
    ranges = _ranges(df, order)
    if ranges == 1:
        return df.withColumn(name, F.lit(0)), []
    chosen = df.agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0]
    splits = [-_INFINITE, *sorted({x for c in chosen if -_INFINITE < (x := float(c)) < _INFINITE}), _INFINITE]
    if len(splits) == 2:
        return df.withColumn(name, F.lit(0)), []
    valued = df.withColumn("_value", F.coalesce(F.col(order).cast("double"), F.lit(-_INFINITE)))
    placed = Bucketizer(splits=splits, inputCol="_value", outputCol=name, handleInvalid="keep").transform(valued)
    hot = sorted({a for a, b in zip(chosen, chosen[1:]) if a == b})
    return placed.withColumn(name, F.col(name).cast("int")).drop("_value"), hot


def running(df: DataFrame, order: str, sums: dict[str, Column], group: Sequence[str] = ()) -> DataFrame:
    """One row for each value of a numeric column (and group), in order: the sums there and before.

    For each name in sums: name (over the value's rows) and name_before (over
    all rows of the group's smaller values).
    """
    group = list(group)
    # counted once: the ranges, their totals and the sums within them read this table
    values = kept(df.groupBy(*group, order).agg(*[F.sum(c).alias(n) for n, c in sums.items()]), "values")
    if _ranges(values, order) == 1:
        before = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return values.select(*group, order, *sums, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_before") for n in sums])
    ranged, _ = _ranged(values, order, "_range")
    totals = ranged.groupBy(*group, "_range").agg(*[F.sum(n).alias(f"_{n}") for n in sums])
    # at most MOST rows a group
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*group, "_range", *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in sums])
    within = Window.partitionBy(*group, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.select("*", *[F.coalesce(F.sum(n).over(within), F.lit(0)).alias(f"{n}_before") for n in sums])
    of_group = [F.col(f"p.{g}").eqNullSafe(F.col(f"s.{g}")) for g in group]
    both = placed.alias("p").join(starts.alias("s"), [F.col("p._range") == F.col("s._range"), *of_group])
    return both.select(*[f"p.{g}" for g in group], F.col(f"p.{order}"), *[F.col(f"p.{n}") for n in sums], *[(F.col(f"p.{n}_before") + F.col(f"s._{n}")).alias(f"{n}_before") for n in sums])


def percentiles(df: DataFrame, value: str, levels: Sequence[float], group: Sequence[str] = ()) -> DataFrame:
    """group, n, p: the exact linear percentiles of a numeric column at levels, as an array.

    Values are counted and ranked by ranges, so no task holds all of a group's
    values. n counts those that aren't null; a group without any has no row.
    """
    group = list(group)
    per = running(df.where(F.col(value).isNotNull()), value, {"_k": F.lit(1)}, group).withColumn("_v", F.col(value).cast("double"))
    totals = per.groupBy(*group).agg(F.sum("_k").alias("n"))
    same = [F.col(f"c.{g}").eqNullSafe(F.col(f"t.{g}")) for g in group]
    both = per.alias("c").join(totals.alias("t"), same) if group else per.alias("c").join(F.broadcast(totals.alias("t")))
    place = lambda q: (F.col("n") - 1) * F.lit(float(q))
    holds = lambda at: (F.col("_k_before") <= at) & (at < F.col("_k_before") + F.col("_k"))
    ends = [F.max(F.when(holds(at(place(q))), F.col("_v"))).alias(f"_{side}{i}") for i, q in enumerate(levels) for side, at in (("low", F.floor), ("high", F.ceil))]
    found = both.groupBy(*[f"c.{g}" for g in group], "n").agg(*ends)

    def between(i: int, q: float) -> Column:
        low, high, at = F.col(f"_low{i}"), F.col(f"_high{i}"), place(q)
        return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

    return found.select(*group, "n", F.array(*[between(i, q) for i, q in enumerate(levels)]).alias("p"))


def running_minimum(per: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """per (one row for each value of a numeric column) with the least value before each row."""
    ranged, _ = _ranged(per, order, "_range")
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_range").agg(F.min(value).alias("_least")).select("_range", F.min("_least").over(earlier).alias("_start"))
    within = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("_inside", F.min(value).over(within)).join(F.broadcast(starts), "_range")
    return placed.withColumn(name, F.least("_inside", "_start")).drop("_inside", "_start", "_range")


def _tie_number(df: DataFrame, tie: str) -> Column:
    """A number that rises (or stays) with the tie key: itself, or the first six bytes of a text."""
    if dict(df.dtypes)[tie] in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        return F.col(tie)
    return F.conv(F.rpad(F.hex(F.substring(F.col(tie).cast("string").cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("long")


def numbered(df: DataFrame, order: str, tie: str, falling: bool = False) -> DataFrame:
    """df with _nth: the place of each row, from 1, by order and then tie (always rising).

    Rows are dealt out by ranges of the order column; those of a hot value are
    dealt out again by ranges of the tie key (a number or a text), so that a
    value that a third of all rows share is numbered by many tasks.
    """
    keyed, hot = _ranged(df.withColumn("_by", -F.col(order) if falling else F.col(order)), "_by", "_range")
    if hot:
        keyed, _ = _ranged(keyed.withColumn("_tie", _tie_number(df, tie)), "_tie", "_part")
        is_hot = F.coalesce(F.col("_by").isin(hot), F.lit(False))
        # a range that begins with a hot value has it first, in parts of their own
        keyed = keyed.withColumn("_range", 2 * F.col("_range") + F.when(is_hot, 0).otherwise(1)).withColumn("_part", F.when(is_hot, F.col("_part")).otherwise(0)).drop("_tie")
    else:
        keyed = keyed.withColumn("_part", F.lit(0))
    earlier = Window.orderBy("_range", "_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = keyed.groupBy("_range", "_part").agg(F.count("*").alias("_n"))
    starts = parts.select("_range", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    placed = keyed.withColumn("_in", F.row_number().over(Window.partitionBy("_range", "_part").orderBy("_by", tie)))
    return placed.join(starts, ["_range", "_part"]).withColumn("_nth", F.col("_first") + F.col("_in")).drop("_by", "_range", "_part", "_in", "_first")


def tile(nth: Column, n: Column, tiles: int) -> Column:
    """The tile, from 1, of place nth of n, when the first n % tiles tiles get one more."""
    size, more = F.floor(n / tiles), n % tiles
    large = more * (size + 1)
    return F.when(nth <= large, F.ceil(nth / (size + 1))).otherwise(more + F.ceil((nth - large) / F.greatest(size, F.lit(1)))).cast("int")


def first_rank_decile(nth: Column, n: Column, tiles: int = 10) -> Column:
    """The quantile bin, from 1, of place nth of n when edges are linear quantiles of places; 1 for a lone row."""
    return F.greatest(F.lit(1), F.ceil(F.try_divide(tiles * (nth - 1), n - 1))).cast("int")


def range_minima(df: DataFrame, entity: str, time: str, value: str, frames: dict[str, tuple[int, int]]) -> DataFrame:
    """df with the least value of the entity in each frame (first and last offset from a row's time).

    An entity's rows are dealt out by time, in parts as long as the farthest
    offset; each row is also copied to the part next to its own, where others
    look back (or ahead) at it. So an entity with a third of all rows is spread
    over many tasks, and all frames share one shuffle.
    """
    reach = max(abs(x) for frame in frames.values() for x in frame)
    own = F.floor(F.col(time) / reach)
    copies = [own] + [own + 1] * any(low < 0 for low, _ in frames.values()) + [own - 1] * any(high > 0 for _, high in frames.values())
    spread = df.select("*", F.posexplode(F.array(*copies)).alias("_copy", "_part"))
    by = Window.partitionBy(entity, "_part").orderBy(time)
    found = spread.select("*", *[F.min(value).over(by.rangeBetween(low, high)).alias(name) for name, (low, high) in frames.items()])
    return found.where("_copy = 0").drop("_copy", "_part")


def earlier_minimum(df: DataFrame, entity: str, time: str, value: str, reach: int, name: str) -> DataFrame:
    """The least value of an entity in the reach before each row, its own time excluded."""
    return range_minima(df, entity, time, value, {name: (-reach, -1)})


def rise_stage(value: Column, least_short: Column, least_long: Column) -> Column:
    """0 to 3 by exact decimal multiples of earlier minima, or an absolute rise.

    Fixed values of the published rule: 1.5, 2 and 3 times, 0.3 within the
    short window, and 4.0 together with any of these.
    """
    ratio = lambda k: F.coalesce(value >= F.lit(k).cast("decimal(4,1)") * least_long, F.lit(False))
    rise = F.coalesce(value - least_short >= F.lit("0.30").cast("decimal(4,2)"), F.lit(False))
    any_rise = rise | ratio("1.5")
    return F.when(ratio("3.0") | (any_rise & (value >= F.lit("4.0").cast("decimal(4,1)"))), 3).when(ratio("2.0"), 2).when(any_rise, 1).otherwise(0)


def highest_first(df: DataFrame, entity: str, level: str, time: str) -> DataFrame:
    """Each entity's highest level, the earliest time it was reached."""
    return df.groupBy(entity).agg(F.max(F.struct(F.col(level), -F.col(time)))[level].alias(level), (-F.max(F.struct(F.col(level).alias("l"), (-F.col(time)).alias("t")))["t"]).alias(time))


def block_number(nth: Column, block: int) -> Column:
    return F.floor((nth - 1) / block).cast("int")


def person_periods(df: DataFrame, periods: Column, event: Column) -> DataFrame:
    """One row for each whole period of follow-up, period from 0; the event is on the last."""
    long = df.withColumn("_n", periods).where("_n > 0").withColumn("_event", event)
    long = long.withColumn("period", F.explode(F.sequence(F.lit(0), F.col("_n").cast("int") - 1)))
    return long.withColumn("event", (F.col("_event") & (F.col("period") == F.col("_n") - 1)).cast("int")).drop("_n", "_event")


def cumulative_risk(hazard: Column) -> Column:
    """1 - product of (1 - hazard), as an aggregate."""
    return 1 - F.exp(F.sum(F.log1p(-hazard)))
