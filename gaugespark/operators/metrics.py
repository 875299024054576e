"""Accuracy, agreement, calibration and discrimination as aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugespark.operators.ranks import first_rank_decile, numbered, running, tile


def balanced_accuracy(df: DataFrame, stratum: str, correct: Column) -> DataFrame:
    """balanced: the plain mean of the strata's accuracies, missing answers wrong."""
    per = df.where(F.col(stratum).isNotNull()).groupBy(stratum).agg(F.avg(F.coalesce(correct, F.lit(False)).cast("double")).alias("acc"))
    return per.agg(F.avg("acc").alias("balanced"), F.count("*").alias("strata"))


def weighted_kappa(df: DataFrame, truth: str, answer: str, levels: int) -> DataFrame:
    """Quadratic weighted kappa of two levels 0 .. levels - 1; null without variation."""
    counts = df.where(F.col(truth).isNotNull() & F.col(answer).isNotNull()).groupBy(truth, answer).agg(F.count("*").alias("n"))
    sums = counts.agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.pow(F.col(truth) - F.col(answer), F.lit(2))).alias("observed"),
        *[F.sum(F.col("n") * F.col(c)).alias(f"s_{k}") for k, c in (("t", truth), ("a", answer))],
        *[F.sum(F.col("n") * F.col(c) * F.col(c)).alias(f"q_{k}") for k, c in (("t", truth), ("a", answer))],
    )
    # sum over all pairs of levels of (t - a)^2 p_t p_a, from the two margins' moments
    expected = F.col("q_t") + F.col("q_a") - F.try_divide(2 * F.col("s_t") * F.col("s_a"), F.col("n"))
    return sums.select("n", (1 - F.col("observed") / F.nullif(expected, F.lit(0.0))).alias("kappa"))


def auroc(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """n, n_pos, auroc: the share of positive and negative pairs in order, ties half."""
    rows = df.where(F.col(score).isNotNull() & positive.isNotNull())
    per = running(rows, score, {"pos": positive.cast("int"), "neg": (~positive).cast("int")})
    won = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    out = per.agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"), won.alias("won"))
    return out.select((F.col("p") + F.col("q")).alias("n"), F.col("p").alias("n_pos"), (F.col("won") / F.nullif(F.col("p") * F.col("q"), F.lit(0))).alias("auroc"))


def auroc_variance(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """auroc, variance after DeLong, from the placement of each distinct score."""
    rows = df.where(F.col(score).isNotNull() & positive.isNotNull())
    per = running(rows, score, {"pos": positive.cast("int"), "neg": (~positive).cast("int")})
    total = per.agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    placed = per.join(F.broadcast(total)).withColumn("v", F.try_divide(F.col("neg_before") + F.col("neg") / 2.0, F.col("q"))).withColumn("w", F.try_divide(F.col("p") - F.col("pos_before") - F.col("pos") / 2.0, F.col("p")))
    sums = placed.agg(F.max("p").alias("p"), F.max("q").alias("q"), *[F.sum(F.col(n) * F.col(x)).alias(f"{x}1") for n, x in (("pos", "v"), ("neg", "w"))], *[F.sum(F.col(n) * F.col(x) * F.col(x)).alias(f"{x}2") for n, x in (("pos", "v"), ("neg", "w"))])
    var = lambda x, n: F.try_divide(F.try_divide(F.col(f"{x}2") - F.try_divide(F.col(f"{x}1") * F.col(f"{x}1"), F.col(n)), F.col(n) - 1), F.col(n))
    return sums.select(F.try_divide("v1", "p").alias("auroc"), (var("v", "p") + var("w", "q")).alias("variance"))


def reliability(df: DataFrame, confidence: str, correct: Column, tie: str, bins: int = 10) -> DataFrame:
    """bin, n, confidence, accuracy of bins of equal counts in order of confidence."""
    rows = numbered(df.where(F.col(confidence).isNotNull()).withColumn("_ok", correct.cast("double")), confidence, tie)
    n = df.where(F.col(confidence).isNotNull()).agg(F.count("*").alias("_n"))
    placed = rows.join(F.broadcast(n)).withColumn("bin", tile(F.col("_nth"), F.col("_n"), bins))
    return placed.groupBy("bin").agg(F.count("*").alias("n"), F.avg(confidence).alias("confidence"), F.avg("_ok").alias("accuracy"))


def calibration_error(table: DataFrame) -> DataFrame:
    gap = F.abs(F.col("accuracy") - F.col("confidence"))
    return table.agg(F.try_divide(F.sum(F.col("n") * gap), F.sum("n")).alias("ece"), F.max(gap).alias("largest"))


def deciles(df: DataFrame, value: str, tie: str, tiles: int = 10) -> DataFrame:
    """df with decile: bins of places whose edges are linear quantiles."""
    n = df.where(F.col(value).isNotNull()).agg(F.count("*").alias("_n"))
    placed = numbered(df.where(F.col(value).isNotNull()), value, tie).join(F.broadcast(n))
    return placed.withColumn("decile", first_rank_decile(F.col("_nth"), F.col("_n"), tiles)).drop("_nth", "_n")


def risk_coverage(df: DataFrame, confidence: str, correct: Column) -> DataFrame:
    """For each distinct confidence, from high to low: rows covered and right answers so far.

    Rows of one confidence come in all at once, which is their order's average.
    """
    rows = df.where(F.col(confidence).isNotNull()).select((-F.col(confidence)).alias("_c"), correct.cast("int").alias("_ok"))
    per = running(rows, "_c", {"n": F.lit(1), "right": F.col("_ok")})
    return per.select((-F.col("_c")).alias("confidence"), "n", "right", (F.col("n_before") + F.col("n")).alias("covered"), (F.col("right_before") + F.col("right")).alias("right_so_far"))


def intraclass(df: DataFrame, item: str, rater: str, value: str) -> DataFrame:
    """ICC(2,1) of complete items by raters, from the sums of squares of a two-way layout."""
    k = df.agg(F.count_distinct(rater).alias("k"))
    rows = df.groupBy(item).agg(F.avg(value).alias("m"), F.sum(F.col(value) * F.col(value)).alias("q"), F.count("*").alias("c")).join(F.broadcast(k))
    columns = df.groupBy(rater).agg(F.avg(value).alias("m"))
    r = rows.agg(F.count("*").alias("n"), F.max("k").alias("k"), F.avg("m").alias("g"), F.var_pop("m").alias("vr"), F.sum("q").alias("q"))
    both = r.join(F.broadcast(columns.agg(F.var_pop("m").alias("vc"))))
    n, k = F.col("n"), F.col("k")
    total = F.col("q") - n * k * F.col("g") * F.col("g")
    ssr, ssc = n * k * F.col("vr"), n * k * F.col("vc")
    msr, msc, mse = F.try_divide(ssr, n - 1), F.try_divide(ssc, k - 1), F.try_divide(total - ssr - ssc, (n - 1) * (k - 1))
    return both.select("n", "k", F.try_divide(msr - mse, msr + (k - 1) * mse + k * F.try_divide(msc - mse, n)).alias("icc"))


def fleiss(df: DataFrame, item: str, answer: str) -> DataFrame:
    """Fleiss' kappa of items with the same number of answers each."""
    per = df.groupBy(item, answer).agg(F.count("*").alias("c"))
    items = per.groupBy(item).agg(F.sum("c").alias("r"), F.sum(F.col("c") * F.col("c")).alias("s"))
    agreed = items.agg(F.avg(F.try_divide(F.col("s") - F.col("r"), F.col("r") * (F.col("r") - 1))).alias("seen"), F.sum("r").alias("total"))
    shares = per.groupBy(answer).agg(F.sum("c").alias("c")).agg(F.sum(F.col("c") * F.col("c")).alias("squares"))
    chance = F.try_divide(F.col("squares"), F.col("total") * F.col("total"))
    return agreed.join(F.broadcast(shares)).select(((F.col("seen") - chance) / F.nullif(1 - chance, F.lit(0.0))).alias("kappa"))


def pooled_spread(df: DataFrame, item: str, value: str) -> DataFrame:
    """The root of the mean sample variance within items."""
    per = df.groupBy(item).agg(F.var_samp(value).alias("v"))
    return per.agg(F.sqrt(F.avg("v")).alias("pooled_sd"), F.count("v").alias("items"))


def origin_slope(df: DataFrame, group: str, y: str, x: str) -> DataFrame:
    return df.groupBy(group).agg(F.try_divide(F.sum(F.col(y) * F.col(x)), F.sum(F.col(x) * F.col(x))).alias("slope"))


def rank_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman's correlation: that of midranks."""
    for c in (x, y):
        per = running(df, c, {"_k": F.lit(1)}).select(F.col(c), (F.col("_k_before") + (F.col("_k") + 1) / 2.0).alias(f"_rank_{c}"))
        df = df.join(per, c)
    return df.agg(F.corr(f"_rank_{x}", f"_rank_{y}").alias("spearman"))


def by_levels(df: DataFrame, truth: str, answer: str) -> DataFrame:
    """exact, off_by_one, within_one over all rows; missing answers count as wrong."""
    gap = F.abs(F.col(truth) - F.col(answer))
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return df.agg(share(gap == 0).alias("exact"), share(gap == 1).alias("off_by_one"), share(gap <= 1).alias("within_one"))


def most_common(df: DataFrame, item: str, answer: str, least: int) -> DataFrame:
    """Items whose commonest answer comes at least so often; ties go to the smaller answer."""
    per = df.groupBy(item, answer).agg(F.count("*").alias("n"))
    first = Window.partitionBy(item).orderBy(F.desc("n"), answer)
    return per.withColumn("_k", F.row_number().over(first)).where((F.col("_k") == 1) & (F.col("n") >= least)).drop("_k")


def sensitivity(df: DataFrame, truth: Column, flagged: Column) -> DataFrame:
    """Counts and rates of a binary endpoint; a missing flag counts against the system."""
    hit, clear = F.coalesce(flagged, F.lit(False)), F.coalesce(~flagged, F.lit(False))
    counts = df.agg(F.count_if(truth & hit).alias("tp"), F.count_if(truth & ~hit).alias("fn"), F.count_if(~truth & clear).alias("tn"), F.count_if(~truth & ~clear).alias("fp"))
    return counts.select("*", F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")).alias("sensitivity"), F.try_divide(F.col("tn"), F.col("tn") + F.col("fp")).alias("specificity"))


def log_loss_table(df: DataFrame, p: str, y: str, clips: Sequence[float]) -> DataFrame:
    """The mean log-loss for each clip, in one pass."""
    losses = []
    for c in clips:
        q = F.least(F.greatest(F.col(p), F.lit(c)), F.lit(1 - c))
        losses.append(F.struct(F.lit(c).alias("clip"), F.avg(-(F.col(y) * F.ln(q) + (1 - F.col(y)) * F.ln(1 - q))).alias("log_loss")))
    return df.agg(F.array(*losses).alias("l")).select(F.explode("l").alias("l")).select("l.*")
