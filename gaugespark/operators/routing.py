"""Decision pipelines over stored answers: who keeps an item, what that costs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugespark.operators.ranks import numbered, percentiles
from gaugespark.operators.resampling import digest_weight, drawn_sums

#: Certainty is compared with this tolerance.
TOLERANCE = 1e-9


def certain(top: Column, threshold: float = 1.0) -> Column:
    return F.coalesce(top >= threshold - TOLERANCE, F.lit(False))


def kept_share(df: DataFrame, confidence: str, tie: str, share: float) -> DataFrame:
    """df with kept: the most confident floor(share x n) rows, ties by key, no confidence last."""
    n = df.agg(F.count("*").alias("_n"))
    filled = df.withColumn("_c", F.coalesce(F.col(confidence), F.lit(float("-1e300"))))
    placed = numbered(filled, "_c", tie, falling=True).join(F.broadcast(n))
    return placed.withColumn("kept", F.col("_nth") <= F.floor(share * F.col("_n") + TOLERANCE)).drop("_nth", "_n", "_c")


def threshold_grid(df: DataFrame, confidence: str, first_ok: Column, second_ok: Column, thresholds: Sequence[float]) -> DataFrame:
    """threshold, kept, accuracy: the first system where it is confident enough, else the second.

    Equal confidences are counted first; only those counts meet the thresholds.
    """
    right = lambda ok: F.sum(F.coalesce(ok, F.lit(False)).cast("long"))
    counted = df.groupBy(F.col(confidence).alias("_c")).agg(F.count("*").alias("_n"), right(first_ok).alias("_a"), right(second_ok).alias("_b"))
    grid = counted.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))).withColumn("_keeps", F.coalesce(F.col("_c") >= F.col("threshold") - TOLERANCE, F.lit(False)))
    kept = F.coalesce(F.sum(F.when(F.col("_keeps"), F.col("_n"))), F.lit(0))
    return grid.groupBy("threshold").agg(kept.alias("kept"), F.try_divide(F.sum(F.when(F.col("_keeps"), F.col("_a")).otherwise(F.col("_b"))), F.sum("_n")).alias("accuracy"))


def decile_grid(df: DataFrame, confidence: str, first_ok: Column, second_ok: Column, first_cost: Column, second_cost: Column, margin: float) -> DataFrame:
    """threshold, share, accuracy, cost, random_line, within_margin at the deciles of confidence.

    The last threshold, null, has the second system alone. random_line is the
    accuracy if the same share went to the first system at random;
    within_margin compares with the second system alone.
    """
    found = percentiles(df, confidence, [k / 10 for k in range(10)]).select("p").first()
    thresholds = sorted(set(found.p if found else [])) + [float("inf")]
    right = lambda ok: F.coalesce(ok, F.lit(False)).cast("int")
    rows = df.select(F.col(confidence).alias("_c"), right(first_ok).alias("_a"), right(second_ok).alias("_b"), first_cost.alias("_f"), second_cost.alias("_g"))
    counted = rows.groupBy("_c").agg(F.count("*").alias("_n"), *[F.sum(c).alias(c) for c in ("_a", "_b", "_f", "_g")])
    grid = counted.withColumn("_t", F.explode(F.array(*[F.lit(t) for t in thresholds]))).withColumn("_keeps", F.coalesce(F.col("_c") >= F.col("_t"), F.lit(False)))
    n, kept = F.sum("_n"), F.coalesce(F.sum(F.when(F.col("_keeps"), F.col("_n"))), F.lit(0))
    mix = F.sum(F.when(F.col("_keeps"), F.col("_a")).otherwise(F.col("_b")))
    cost = F.sum("_f") + F.coalesce(F.sum(F.when(~F.col("_keeps"), F.col("_g"))), F.lit(0.0))
    out = grid.groupBy("_t").agg((kept / n).alias("share"), (mix / n).alias("accuracy"), (cost / n).alias("cost"), (F.sum("_a") / n).alias("_x"), (F.sum("_b") / n).alias("_y"))
    line = random_routing(F.col("_x"), F.col("_y"), F.col("share"))
    return out.select(F.when(F.col("_t") < float("inf"), F.col("_t")).alias("threshold"), "share", "accuracy", "cost", line.alias("random_line"), (F.col("accuracy") >= F.col("_y") - margin - 1e-12).alias("within_margin"))


def coverage_curve(df: DataFrame, confidence: str, tie: str, correct: Column, shares: Sequence[float]) -> DataFrame:
    """share, kept, right: of the most confident rows up to each share."""
    n = df.agg(F.count("*").alias("_n"))
    placed = numbered(df.where(F.col(confidence).isNotNull()), confidence, tie, falling=True).join(F.broadcast(n))
    cells = []
    for s in shares:
        inside = F.col("_nth") <= F.floor(F.lit(s) * F.col("_n") + TOLERANCE)
        cells.append(F.struct(F.lit(float(s)).alias("share"), F.count_if(inside).alias("kept"), F.count_if(inside & F.coalesce(correct, F.lit(False))).alias("right")))
    return placed.agg(F.array(*cells).alias("g")).select(F.explode("g").alias("g")).select("g.*")


def pairing(df: DataFrame, group: str, keeps: Column, first_ok: Column, second_ok: Column, first_cost: Column, second_cost: Column) -> DataFrame:
    """For each group: items kept, kept wrong, accuracy alone and paired, cost share of the second alone."""
    ok = F.coalesce(F.when(keeps, first_ok).otherwise(second_ok), F.lit(False))
    cost = first_cost + F.when(keeps, 0.0).otherwise(second_cost)
    return df.groupBy(group).agg(
        F.count("*").alias("n"),
        F.count_if(keeps).alias("kept"),
        F.count_if(keeps & ~F.coalesce(first_ok, F.lit(False))).alias("kept_wrong"),
        F.avg(F.coalesce(second_ok, F.lit(False)).cast("double")).alias("alone"),
        F.avg(ok.cast("double")).alias("paired"),
        F.try_divide(F.sum(cost), F.sum(second_cost)).alias("cost_share"),
    )


def cascade(first: Column, second: Column, third: Column) -> tuple[Column, Column]:
    """Two systems' common answer, else the third's; and whether the third was asked."""
    agree = F.coalesce(first == second, F.lit(False))
    return F.when(agree, first).otherwise(third), ~agree


def three_step(df: DataFrame, first: str, second: str, tie: str) -> DataFrame:
    """df with step 1, 2 or 3: the more confident half stays with the first system, of the
    rest the more confident half with the second, and the third takes what is left."""
    one = kept_share(df, first, tie, 0.5)
    rest = kept_share(one.where("not kept").drop("kept"), second, tie, 0.5)
    return one.where("kept").withColumn("step", F.lit(1)).drop("kept").unionByName(rest.withColumn("step", F.when(F.col("kept"), 2).otherwise(3)).drop("kept"))


def lowest_safe(df: DataFrame, threshold: str, ok: Column, group: Sequence[str] = ()) -> DataFrame:
    """group, lowest: the least threshold from which on all higher ones are acceptable."""
    group = list(group)
    refused = df.groupBy(*group).agg(F.max(F.when(~F.coalesce(ok, F.lit(False)), F.col(threshold))).alias("_refused"))
    safe = F.col("_refused").isNull() | (F.col(threshold) > F.col("_refused"))
    both = df.join(refused, group) if group else df.join(F.broadcast(refused))
    return both.groupBy(*group).agg(F.min(F.when(safe, F.col(threshold))).alias("lowest"))


def drawn_gains(cells: DataFrame, unit: str, confidence: str, n: str, first: str, partners: Sequence[str], thresholds: Sequence[float], draws: int) -> DataFrame:
    """partner, draw, threshold, gain: a hybrid's accuracy less the partner's alone, in each bootstrap draw.

    cells has the counts of a unit's items by confidence: n, those right by the
    first system and by each partner. A confidence counts by the thresholds that
    it reaches, so a unit has at most one cell more than there are thresholds,
    however fine its confidences; draws multiply these, never items.
    """
    levels = [float(t) for t in sorted(thresholds)]
    reached = F.size(F.filter(F.array(*[F.lit(t) for t in levels]), lambda t: F.coalesce(F.col(confidence) >= t - TOLERANCE, F.lit(False))))
    binned = cells.groupBy(unit, reached.alias("_reached")).agg(*[F.sum(c).alias(c) for c in (n, first, *partners)])
    sums = drawn_sums(binned, unit, ["_reached"], [n, first, *partners], draws, digest_weight)
    grid = sums.select("*", F.posexplode(F.array(*[F.lit(t) for t in levels])).alias("_nth", "threshold"))
    keeps = F.col("_nth") < F.col("_reached")
    gains = [F.struct(F.lit(p).alias("partner"), F.try_divide(F.sum(F.when(keeps, F.col(first) - F.col(p)).otherwise(0)), F.sum(n)).alias("gain")) for p in partners]
    out = grid.groupBy("draw", "threshold").agg(F.sum(n).alias("_n"), F.array(*gains).alias("g")).where("_n > 0")
    return out.select("draw", "threshold", F.explode("g").alias("g")).select("g.partner", "draw", "threshold", "g.gain")


def random_routing(first: Column, second: Column, share: Column) -> Column:
    return share * first + (1 - share) * second
