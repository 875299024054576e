"""Queries of metrics, resampling inference, range windows, routing and models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugespark.functions import values
from gaugespark.operators import metrics, models, ranks, resampling, routing
from gaugespark.queries.base import Tables, digest_weight_sql, query

#: Two levels 0 to 3 (truth and answer, some unusable) of each line, and a confidence.
LEVELS = """levels AS (SELECT *, l_linenumber % 4 AS truth, CASE WHEN l_tax > 0 THEN l_quantity::INT % 4 END AS answer FROM lineitem)"""
#: Bootstrap draws.
DRAWS = 2000


def _levels(t: Tables) -> DataFrame:
    answer = F.when(F.col("l_tax") > 0, F.col("l_quantity").cast("int") % 4)
    return t.lineitem.withColumn("truth", F.col("l_linenumber") % 4).withColumn("answer", answer)


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("""SELECT round(avg(a), 9) AS balanced, count(*) AS strata FROM (SELECT avg((o_totalprice > 150000)::INT) AS a FROM orders GROUP BY o_orderpriority)""")
def balanced_accuracy(t: Tables) -> DataFrame:
    """AGG-07, AGG-08: the mean of the strata's accuracies."""
    return _rounded(metrics.balanced_accuracy(t.orders, "o_orderpriority", F.col("o_totalprice") > 150000), "balanced", digits=9)


@query(f"""WITH {LEVELS}, c AS (SELECT truth, answer, count(*)::DOUBLE AS n FROM levels WHERE answer IS NOT NULL GROUP BY ALL),
a AS (SELECT truth, sum(n) AS n FROM c GROUP BY 1), b AS (SELECT answer, sum(n) AS n FROM c GROUP BY 1)
SELECT (SELECT sum(n) FROM c)::BIGINT AS n, round(1 - (SELECT sum(n * (truth - answer) ** 2) FROM c)
/ (SELECT sum(a.n * b.n * (truth - answer) ** 2) / (SELECT sum(n) FROM c) FROM a CROSS JOIN b), 9) AS kappa""")
def weighted_kappa(t: Tables) -> DataFrame:
    """AGG-11: quadratic weights, unusable answers left out."""
    return _rounded(metrics.weighted_kappa(_levels(t), "truth", "answer", 4), "kappa", digits=9)


@query(f"""WITH {LEVELS} SELECT round(avg(coalesce(abs(truth - answer) = 0, false)::INT), 9) AS exact, round(avg(coalesce(abs(truth - answer) = 1, false)::INT), 9) AS off_by_one,
round(avg(coalesce(abs(truth - answer) <= 1, false)::INT), 9) AS within_one FROM levels""")
def ordered_levels(t: Tables) -> DataFrame:
    """AGG-12, AGG-13: exact and near answers, unusable ones wrong."""
    return _rounded(metrics.by_levels(_levels(t), "truth", "answer"), "exact", "off_by_one", "within_one", digits=9)


@query("""WITH s AS (SELECT l_returnflag = 'R' AS pos, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS r FROM lineitem)
SELECT count(*) AS n, count(*) FILTER (pos) AS n_pos, round((sum(r) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)), 9) AS auroc FROM s""")
def auroc_midrank(t: Tables) -> DataFrame:
    """AGG-17, WIN-04: ties count half, without a window over the whole table."""
    return _rounded(metrics.auroc(t.lineitem, "l_discount", F.col("l_returnflag") == "R"), "auroc", digits=9)


@query("""WITH s AS (SELECT l_quantity AS x, l_returnflag = 'R' AS pos FROM lineitem), c AS (SELECT x, count(*) FILTER (pos)::DOUBLE AS p, count(*) FILTER (NOT pos)::DOUBLE AS q FROM s GROUP BY 1),
m AS (SELECT sum(p) AS p, sum(q) AS q FROM c),
v AS (SELECT c.x, c.p AS np, c.q AS nq, (sum(c.q) OVER (ORDER BY x) - c.q / 2) / m.q AS v10, (m.p - sum(c.p) OVER (ORDER BY x) + c.p / 2) / m.p AS v01 FROM c CROSS JOIN m)
SELECT round(sum(np * v10) / sum(np), 9) AS auroc, round((sum(np * v10 * v10) - sum(np * v10) ** 2 / sum(np)) / (sum(np) - 1) / sum(np) + (sum(nq * v01 * v01) - sum(nq * v01) ** 2 / sum(nq)) / (sum(nq) - 1) / sum(nq), 12) AS variance FROM v""")
def auroc_variance(t: Tables) -> DataFrame:
    """AGG-18: DeLong's variance from the placements of distinct scores."""
    out = metrics.auroc_variance(t.lineitem, "l_quantity", F.col("l_returnflag") == "R")
    return out.select(F.round("auroc", 9).alias("auroc"), F.round("variance", 12).alias("variance"))


@query("""SELECT bin, count(*) AS n, round(avg(value), 6) AS confidence, round(avg(ok), 6) AS accuracy
FROM (SELECT value, (event_type = 'click')::INT AS ok, ntile(10) OVER (ORDER BY value, event_id) AS bin FROM events WHERE value IS NOT NULL) GROUP BY 1""")
def reliability_bins(t: Tables) -> DataFrame:
    """AGG-19: bins of equal counts in order of confidence."""
    return _rounded(metrics.reliability(t.events, "value", F.col("event_type") == "click", "event_id"), "confidence", "accuracy")


@query("""WITH b AS (SELECT bin, count(*) AS n, avg(c) AS c, avg(ok) AS a FROM (SELECT value / 500 AS c, (event_type = 'click')::INT AS ok, ntile(10) OVER (ORDER BY value / 500, event_id) AS bin FROM events WHERE value IS NOT NULL) GROUP BY 1)
SELECT round(sum(n * abs(a - c)) / sum(n), 6) AS ece, round(max(abs(a - c)), 6) AS largest FROM b""")
def calibration_error(t: Tables) -> DataFrame:
    """AGG-19: the expected and the largest gap of accuracy and confidence."""
    table = metrics.reliability(t.events.withColumn("c", F.col("value") / 500), "c", F.col("event_type") == "click", "event_id")
    return _rounded(metrics.calibration_error(table), "ece", "largest")


@query("""SELECT decile, count(*) AS n, min(value) AS low, max(value) AS high FROM (SELECT value, greatest(1, ceil(10 * (row_number() OVER (ORDER BY value, event_id) - 1)::DOUBLE / (count(*) OVER () - 1)))::INT AS decile FROM events WHERE value IS NOT NULL) GROUP BY 1""")
def first_rank_deciles(t: Tables) -> DataFrame:
    """AGG-20, WIN-05, WIN-06: deciles by place, edges linear quantiles of places."""
    return metrics.deciles(t.events, "value", "event_id").groupBy("decile").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("""WITH g AS (SELECT l_discount AS confidence, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS "right" FROM lineitem GROUP BY 1)
SELECT confidence, n, "right", (sum(n) OVER (ORDER BY confidence DESC))::BIGINT AS covered, (sum("right") OVER (ORDER BY confidence DESC))::BIGINT AS right_so_far FROM g""")
def risk_coverage(t: Tables) -> DataFrame:
    """WIN-07, HYB-04: right answers so far as coverage grows, equal confidences at once."""
    return metrics.risk_coverage(t.lineitem, "l_discount", F.col("l_returnflag") == "R")


@query("""WITH d AS (SELECT o_custkey % 10 AS item, o_orderpriority AS rater, avg(o_totalprice) AS v FROM orders GROUP BY ALL),
g AS (SELECT avg(v) AS g, count(DISTINCT item)::DOUBLE AS n, count(DISTINCT rater)::DOUBLE AS k, var_pop(v) * count(*) AS sst FROM d),
r AS (SELECT var_pop(m) AS v FROM (SELECT avg(v) AS m FROM d GROUP BY item)), c AS (SELECT var_pop(m) AS v FROM (SELECT avg(v) AS m FROM d GROUP BY rater)),
s AS (SELECT n, k, n * k * r.v AS ssr, n * k * c.v AS ssc, sst FROM g, r, c), m AS (SELECT n, k, ssr / (n - 1) AS msr, ssc / (k - 1) AS msc, (sst - ssr - ssc) / ((n - 1) * (k - 1)) AS mse FROM s)
SELECT n::BIGINT AS n, k::BIGINT AS k, round((msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n), 6) AS icc FROM m""")
def intraclass(t: Tables) -> DataFrame:
    """AGG-43: ICC(2,1) from the sums of squares of a two-way layout."""
    d = t.orders.groupBy((F.col("o_custkey") % 10).alias("item"), F.col("o_orderpriority").alias("rater")).agg(F.avg("o_totalprice").alias("v"))
    return _rounded(metrics.intraclass(d, "item", "rater", "v"), "icc")


@query("""WITH f AS (SELECT l_orderkey, l_returnflag FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey) >= 2),
p AS (SELECT l_orderkey, l_returnflag, count(*)::DOUBLE AS c FROM f GROUP BY ALL), i AS (SELECT sum(c) AS r, sum(c * c) AS s FROM p GROUP BY l_orderkey),
a AS (SELECT avg((s - r) / (r * (r - 1))) AS seen, sum(r) AS total FROM i), q AS (SELECT sum(c * c) AS sq FROM (SELECT sum(c) AS c FROM p GROUP BY l_returnflag))
SELECT round((seen - sq / (total * total)) / (1 - sq / (total * total)), 9) AS kappa FROM a, q""")
def fleiss_kappa(t: Tables) -> DataFrame:
    """AGG-44: agreement of several answers on each item."""
    enough = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n")).where("n >= 2").select("l_orderkey")
    rows = t.lineitem.select("l_orderkey", "l_returnflag").join(enough, "l_orderkey", "left_semi")
    return _rounded(metrics.fleiss(rows, "l_orderkey", "l_returnflag"), "kappa", digits=9)


@query("""SELECT round(sqrt(avg(v)), 6) AS pooled_sd, count(v) AS items FROM (SELECT var_samp(value) AS v FROM events GROUP BY user_id)""")
def pooled_spread(t: Tables) -> DataFrame:
    """AGG-42: the spread within items, pooled."""
    return _rounded(metrics.pooled_spread(t.events, "user_id", "value"), "pooled_sd")


@query("""SELECT l_returnflag, round(sum(l_quantity * l_discount) / sum(l_discount * l_discount), 6) AS slope FROM lineitem GROUP BY 1""")
def origin_slope(t: Tables) -> DataFrame:
    """AGG-26, AGG-27: slopes through the origin."""
    return _rounded(metrics.origin_slope(t.lineitem, "l_returnflag", "l_quantity", "l_discount"), "slope")


@query("""SELECT round(corr(a, b), 9) AS spearman FROM (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS b FROM lineitem)""")
def spearman(t: Tables) -> DataFrame:
    """AGG-39, AGG-70: the correlation of midranks."""
    return _rounded(metrics.rank_correlation(t.lineitem.select("l_quantity", "l_discount"), "l_quantity", "l_discount"), "spearman", digits=9)


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, event_type, n FROM c WHERE n >= 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1""")
def majority_answer(t: Tables) -> DataFrame:
    """AGG-66: each item's commonest answer, if it comes often enough."""
    return metrics.most_common(t.events, "user_id", "event_type", 2)


@query("""SELECT count(*) FILTER (y AND coalesce(f, false)) AS tp, count(*) FILTER (y AND NOT coalesce(f, false)) AS fn, count(*) FILTER (NOT y AND coalesce(NOT f, false)) AS tn, count(*) FILTER (NOT y AND NOT coalesce(NOT f, false)) AS fp,
round(count(*) FILTER (y AND coalesce(f, false))::DOUBLE / count(*) FILTER (y), 9) AS sensitivity, round(count(*) FILTER (NOT y AND coalesce(NOT f, false))::DOUBLE / count(*) FILTER (NOT y), 9) AS specificity
FROM (SELECT l_returnflag = 'R' AS y, CASE WHEN l_tax > 0 THEN l_discount >= 0.05 END AS f FROM lineitem)""")
def sensitivity_specificity(t: Tables) -> DataFrame:
    """AGG-51: a binary endpoint, unusable answers counted against the system."""
    out = metrics.sensitivity(t.lineitem, F.col("l_returnflag") == "R", F.when(F.col("l_tax") > 0, F.col("l_discount") >= 0.05))
    return _rounded(out, "sensitivity", "specificity", digits=9)


@query("""SELECT c AS clip, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS log_loss FROM (SELECT c, (l_returnflag = 'R')::INT AS y, least(greatest(l_discount * 10, c), 1 - c) AS q FROM lineitem CROSS JOIN (SELECT unnest([0.001, 0.01, 0.05])::DOUBLE AS c)) GROUP BY 1""")
def log_loss_clips(t: Tables) -> DataFrame:
    """AGG-46, PRJ-31: the mean log-loss at several clips, in one pass."""
    rows = t.lineitem.select((F.col("l_discount") * 10).alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return _rounded(metrics.log_loss_table(rows, "p", "y", [0.001, 0.01, 0.05]), "log_loss")


@query("""WITH v AS (SELECT l_linenumber % 3 AS y, a / (a + b + c) AS a, b / (a + b + c) AS b, c / (a + b + c) AS c FROM (SELECT l_linenumber, l_quantity AS a, l_discount * 100 + 1 AS b, l_tax * 100 + 1 AS c FROM lineitem))
SELECT round(avg((a - (y = 0)::INT) ** 2 + (b - (y = 1)::INT) ** 2 + (c - (y = 2)::INT) ** 2), 6) AS brier, round(avg(((a - (0 >= y)::INT) ** 2 + (a + b - (1 >= y)::INT) ** 2 + (a + b + c - 1) ** 2) / 2), 6) AS rps,
round(avg(a * 0 + b * 1 + c * 2), 6) AS expected, round(avg(abs(b + 2 * c - y)), 6) AS mae FROM v""")
def probability_scores(t: Tables) -> DataFrame:
    """AGG-14, AGG-15, AGG-16: Brier and ranked scores, expected level and its error."""
    a, b, c = F.col("l_quantity"), F.col("l_discount") * 100 + 1, F.col("l_tax") * 100 + 1
    rows = t.lineitem.select((F.col("l_linenumber") % 3).alias("y"), F.transform(F.array(a, b, c), lambda x: x / (a + b + c)).alias("p"))
    expected = F.aggregate(F.transform("p", lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x)
    mean = lambda x, name: F.round(F.avg(x), 6).alias(name)
    return rows.agg(mean(values.brier(F.col("p"), F.col("y")), "brier"), mean(values.ranked_score(F.col("p"), F.col("y")), "rps"), mean(expected, "expected"), mean(F.abs(expected - F.col("y")), "mae"))


@query("""WITH g AS (SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F')::DOUBLE AS k, count(*)::DOUBLE AS n FROM orders GROUP BY 1), z AS (SELECT 1.959963984540054::DOUBLE AS z)
SELECT o_orderpriority, k::BIGINT AS k, n::BIGINT AS n, round((k / n + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n)) / (1 + z * z / n), 9) AS low,
round((k / n + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n)) / (1 + z * z / n), 9) AS high FROM g, z""")
def wilson_interval(t: Tables) -> DataFrame:
    """AGG-53: the Wilson interval of a share."""
    per = t.orders.groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("k"), F.count("*").alias("n"))
    low, high = values.wilson(F.col("k"), F.col("n"))
    return per.select("o_orderpriority", "k", "n", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query("""WITH g AS (SELECT l_linestatus, l_returnflag, sum((l_quantity > 25)::INT)::DOUBLE / sum(l_discount * 10) AS oe FROM lineitem GROUP BY ALL)
SELECT f.l_linestatus, round(a.oe, 6) AS oe_a, round(f.oe, 6) AS oe_n, round(a.oe / f.oe, 6) AS ratio FROM g f JOIN g a USING (l_linestatus) WHERE f.l_returnflag = 'N' AND a.l_returnflag = 'A'""")
def observed_expected(t: Tables) -> DataFrame:
    """AGG-24, AGG-65: observed over expected by group, and the ratio of two groups'."""
    at = lambda f: F.sum(F.when(F.col("l_returnflag") == f, (F.col("l_quantity") > 25).cast("double"))) / F.sum(F.when(F.col("l_returnflag") == f, F.col("l_discount") * 10))
    per = t.lineitem.groupBy("l_linestatus").agg(at("A").alias("oe_a"), at("N").alias("oe_n"))
    return _rounded(per.withColumn("ratio", F.col("oe_a") / F.col("oe_n")), "oe_a", "oe_n", "ratio")


@query("""SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 9) AS r2 FROM lineitem GROUP BY 1""")
def regression_slope(t: Tables) -> DataFrame:
    """AGG-33: least squares as aggregates."""
    y, x = "l_extendedprice", "l_quantity"
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 4).alias("intercept"), F.round(F.regr_r2(y, x), 9).alias("r2"))


@query("""WITH m AS (SELECT l_partkey, l_returnflag AS s, avg(l_discount) AS v FROM lineitem GROUP BY ALL)
SELECT a.s AS first, b.s AS second, count(*) AS pairs, round(avg(a.v - b.v), 9) AS difference, round(avg((sign(a.v - 0.05) = sign(b.v - 0.05))::INT), 6) AS same_direction FROM m a JOIN m b USING (l_partkey) WHERE a.s < b.s GROUP BY ALL""")
def system_differences(t: Tables) -> DataFrame:
    """AGG-29, AGG-40, AGG-41: differences of pairs of systems on their common records."""
    systems = ["A", "N", "R"]
    per = t.lineitem.groupBy("l_partkey").agg(*[F.avg(F.when(F.col("l_returnflag") == s, F.col("l_discount"))).alias(s) for s in systems])
    pairs = [F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(a).alias("x"), F.col(b).alias("y")) for i, a in enumerate(systems) for b in systems[i + 1 :]]
    long = per.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").where("x is not null and y is not null")
    same = (F.signum(F.col("x") - 0.05) == F.signum(F.col("y") - 0.05)).cast("int")
    return long.groupBy("first", "second").agg(F.count("*").alias("pairs"), F.round(F.avg(F.col("x") - F.col("y")), 9).alias("difference"), F.round(F.avg(same), 6).alias("same_direction"))


@query("""SELECT round(avg((abs(round(value / 0.05) * 0.05 - value) < 1e-9)::INT), 6) AS on_grid, count(DISTINCT round(value, 1)) AS kinds FROM events""")
def output_grid(t: Tables) -> DataFrame:
    """AGG-30: how many values lie on a grid, and how many differ when rounded."""
    grid = F.abs(F.round(F.col("value") / 0.05) * 0.05 - F.col("value")) < 1e-9
    return t.events.agg(F.round(F.avg(grid.cast("int")), 6).alias("on_grid"), F.count_distinct(F.round("value", 1)).alias("kinds"))


@query("""SELECT count(*) AS items, round(avg((kinds = 1)::INT), 6) AS identical FROM (SELECT l_orderkey, count(DISTINCT l_returnflag) AS kinds FROM lineitem GROUP BY 1 HAVING count(*) = 4)""")
def repeatability(t: Tables) -> DataFrame:
    """AGG-45, JON-11: complete items and the share answered alike each time."""
    per = t.lineitem.groupBy("l_orderkey").agg(F.count_distinct("l_returnflag").alias("kinds"), F.count("*").alias("n")).where("n = 4")
    return per.agg(F.count("*").alias("items"), F.round(F.avg((F.col("kinds") == 1).cast("int")), 6).alias("identical"))


@query("""WITH p AS (SELECT l_partkey, avg(l_discount) FILTER (l_returnflag = 'N') AS q0, avg(l_discount) FILTER (l_returnflag = 'A') AS q1 FROM lineitem GROUP BY 1)
SELECT count(*) AS pairs, round(avg(((q0 >= 0.05) <> (q1 >= 0.05))::INT), 6) AS reclassified, round(avg((q1 >= 0.05 AND q0 < 0.05)::INT), 6) AS "up", round(avg(abs(q1 - q0)), 9) AS drift, round(avg(q1) / avg(q0), 6) AS dose FROM p WHERE q0 IS NOT NULL AND q1 IS NOT NULL""")
def reclassified(t: Tables) -> DataFrame:
    """AGG-28, AGG-36, AGG-37: changes of category, drift and ratio of means of paired records."""
    pick = lambda f: F.avg(F.when(F.col("l_returnflag") == f, F.col("l_discount")))
    p = t.lineitem.groupBy("l_partkey").agg(pick("N").alias("q0"), pick("A").alias("q1")).where("q0 is not null and q1 is not null")
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    high0, high1 = F.col("q0") >= 0.05, F.col("q1") >= 0.05
    return p.agg(F.count("*").alias("pairs"), share(high0 != high1).alias("reclassified"), share(high1 & ~high0).alias("up"), F.round(F.avg(F.abs(F.col("q1") - F.col("q0"))), 9).alias("drift"), F.round(F.avg("q1") / F.avg("q0"), 6).alias("dose"))


@query("""SELECT c_custkey, round(coalesce(w / avg(w) OVER (), 1), 9) AS weight FROM (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS w FROM customer)""")
def scaled_weights(t: Tables) -> DataFrame:
    """AGG-69: weights scaled to mean 1, missing ones 1."""
    w = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    mean = t.customer.agg(F.avg(w).alias("mean"))
    return t.customer.join(F.broadcast(mean)).select("c_custkey", F.round(F.coalesce(w / F.col("mean"), F.lit(1.0)), 9).alias("weight"))


@query("""WITH s AS (SELECT percent, c, y FROM (SELECT unnest([0, 5, 8]) AS percent), (SELECT l_discount * 100 AS c, (l_returnflag = 'R')::INT AS y FROM lineitem))
SELECT percent::INT AS cut, count(*) FILTER (c >= percent - 1e-9) AS kept, round(avg(y) FILTER (c >= percent - 1e-9), 6) AS kept_accuracy, round(avg(y) FILTER (c < percent - 1e-9), 6) AS passed_accuracy FROM s GROUP BY 1""")
def cutoff_table(t: Tables) -> DataFrame:
    """CMP-37, HYB-17: what each cut keeps and passes on, in one pass."""
    y, cells = (F.col("l_returnflag") == "R").cast("int"), []
    for cut in (0, 5, 8):
        keeps = routing.certain(F.col("l_discount") * 100, float(cut))
        cells.append(F.struct(F.lit(cut).alias("cut"), F.count_if(keeps).alias("kept"), F.round(F.avg(F.when(keeps, y)), 6).alias("kept_accuracy"), F.round(F.avg(F.when(~keeps, y)), 6).alias("passed_accuracy")))
    return t.lineitem.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


@query("""SELECT o_orderpriority, count(*) AS n, count(*) FILTER (ok IS NOT NULL) AS answered, count(*) FILTER (ok) AS correct, round(avg(ok::INT), 6) AS accuracy_answered, round(avg(coalesce(ok, false)::INT), 6) AS accuracy
FROM (SELECT o_orderpriority, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice > 150000 END AS ok FROM orders) GROUP BY 1""")
def answer_accounting(t: Tables) -> DataFrame:
    """CMP-12, CMP-14, AGG-54: asked, answered and right answers, unusable ones in and out."""
    ok = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") > 150000)
    return t.orders.groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), F.count(ok).alias("answered"), F.count_if(ok).alias("correct"), F.round(F.avg(ok.cast("int")), 6).alias("accuracy_answered"), F.round(F.avg(F.coalesce(ok, F.lit(False)).cast("int")), 6).alias("accuracy")
    )


# --- resampling -------------------------------------------------------------


def _drawn(t: Tables, draws: int, group: list[str] | None = None) -> DataFrame:
    rows = t.orders.withColumn("ok", (F.col("o_totalprice") > 150000).cast("double"))
    return resampling.drawn_means(rows, "o_custkey", F.col("ok"), draws, resampling.digest_weight, group)


_WEIGHTS = f"""weights AS (SELECT draw, unit, {digest_weight_sql("unit")} AS w FROM (SELECT DISTINCT o_custkey AS unit FROM orders) CROSS JOIN (SELECT unnest(range({DRAWS})) AS draw))"""
_UNITS = _WEIGHTS + """, u AS (SELECT o_custkey AS unit, o_orderpriority, sum((o_totalprice > 150000)::INT) AS s, count(*) AS n FROM orders GROUP BY ALL)"""
_DRAWN = _UNITS + """, d AS (SELECT draw, sum(w * s)::DOUBLE / sum(w * n) AS mean FROM u JOIN weights USING (unit) GROUP BY 1)"""
_DRAWN_BY = _UNITS + """, d AS (SELECT draw, o_orderpriority, sum(w * s)::DOUBLE / sum(w * n) AS mean FROM u JOIN weights USING (unit) WHERE w > 0 GROUP BY ALL)"""


@query(f"""WITH {_DRAWN} SELECT round(quantile_cont(mean, 0.025), 9) AS low, round(quantile_cont(mean, 0.975), 9) AS high, round(stddev_samp(mean), 9) AS se FROM d""")
def bootstrap_interval(t: Tables, draws: int = DRAWS) -> DataFrame:
    """BOOT-01, BOOT-03, BOOT-04, BOOT-10: whole customers resampled, percentile interval and error."""
    return _rounded(resampling.interval(_drawn(t, draws), "mean"), "low", "high", "se", digits=9)


@query(f"""WITH {_DRAWN_BY} SELECT o_orderpriority, round(quantile_cont(mean, 0.025), 9) AS low, round(quantile_cont(mean, 0.975), 9) AS high, round(stddev_samp(mean), 9) AS se FROM d GROUP BY 1""")
def bootstrap_by_stratum(t: Tables, draws: int = DRAWS) -> DataFrame:
    """BOOT-12: intervals of each stratum from the same draws."""
    return _rounded(resampling.interval(_drawn(t, draws, ["o_orderpriority"]), "mean", ["o_orderpriority"]), "low", "high", "se", digits=9)


@query(f"""WITH {_DRAWN} SELECT round(least(1.0, 2 * (least(count(*) FILTER (mean - 0.5 <= 0), count(*) FILTER (mean - 0.5 >= 0)) + 1)::DOUBLE / (count(*) + 1)), 9) AS p FROM d""")
def bootstrap_p(t: Tables, draws: int = DRAWS) -> DataFrame:
    """BOOT-05, BOOT-13: a two-sided p value of a difference from one half."""
    return _rounded(resampling.two_sided_p(_drawn(t, draws).withColumn("difference", F.col("mean") - 0.5), "difference"), "p", digits=9)


@query(f"""WITH {_DRAWN_BY}, p AS (SELECT o_orderpriority, avg((o_totalprice > 150000)::INT) AS mean FROM orders GROUP BY 1), s AS (SELECT o_orderpriority, stddev_samp(mean) AS se, avg(mean) AS centre FROM d GROUP BY 1),
m AS (SELECT max(abs(mean - centre) / se) AS t FROM d JOIN s USING (o_orderpriority) WHERE se > 0 GROUP BY draw), c AS (SELECT quantile_cont(t, 0.95) AS c FROM m)
SELECT o_orderpriority, round(mean, 9) AS mean, round(mean - c * se, 6) AS low, round(mean + c * se, 6) AS high FROM p JOIN s USING (o_orderpriority) CROSS JOIN c""")
def simultaneous_intervals(t: Tables, draws: int = DRAWS) -> DataFrame:
    """BOOT-06: intervals that hold for a whole family."""
    point = t.orders.groupBy("o_orderpriority").agg(F.avg((F.col("o_totalprice") > 150000).cast("double")).alias("mean"))
    out = resampling.simultaneous(_drawn(t, draws, ["o_orderpriority"]), point, "o_orderpriority", "mean")
    return out.select("o_orderpriority", F.round("mean", 9).alias("mean"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("""WITH f AS (SELECT n_name, count(*) AS n, avg(c_acctbal) / 10000 AS p FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1)
SELECT n_name, round(p, 9) AS p, round(max(s) OVER (ORDER BY p, n_name ROWS UNBOUNDED PRECEDING), 6) AS holm_p FROM (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, n_name) + 1) * p) AS s FROM f)""")
def holm_adjusted(t: Tables) -> DataFrame:
    """BOOT-08: Holm's step-down of a family of at most a few hundred tests."""
    family = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg((F.avg("c_acctbal") / 10000).alias("p"))
    return resampling.holm(family, "p", "n_name").select("n_name", F.round("p", 9).alias("p"), F.round("holm_p", 6).alias("holm_p"))


@query(f"""WITH {_DRAWN_BY}, b AS (SELECT o_orderpriority, quantile_cont(0.5 - mean, 0.025) AS low, quantile_cont(0.5 - mean, 0.975) AS high, quantile_cont(0.5 - mean, 0.005) AS bonferroni FROM d GROUP BY 1)
SELECT o_orderpriority, round(bonferroni, 9) AS bonferroni, CASE WHEN high < 0.02 THEN CASE WHEN high < 0 THEN 'better' ELSE 'non-inferior' END WHEN low > 0.02 THEN 'worse' ELSE 'inconclusive' END AS verdict FROM b""")
def margin_verdict(t: Tables, draws: int = DRAWS) -> DataFrame:
    """BOOT-09, BOOT-15: bounds for a family of five and verdicts at a margin."""
    drawn = _drawn(t, draws, ["o_orderpriority"]).withColumn("difference", 0.5 - F.col("mean"))
    bounds = drawn.groupBy("o_orderpriority").agg(F.percentile("difference", 0.025).alias("low"), F.percentile("difference", 0.975).alias("high"), F.percentile("difference", 0.025 / 5).alias("bonferroni"))
    return bounds.select("o_orderpriority", F.round("bonferroni", 9).alias("bonferroni"), resampling.verdict(F.col("low"), F.col("high"), 0.02).alias("verdict"))


# --- event timelines --------------------------------------------------------


def _minutes() -> Column:
    """Whole minutes since 1970 of a timestamp without zone."""
    return (F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 1440 + F.hour("ts") * 60 + F.minute("ts")).cast("long")


_TIMELINE = """e AS (SELECT event_id, user_id, epoch_us(ts) // 60000000 AS t, value::DECIMAL(10,2) AS v FROM events),
w AS (SELECT *, min(v) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 2880 PRECEDING AND 1 PRECEDING) AS short, min(v) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 10080 PRECEDING AND 1 PRECEDING) AS long,
min(v) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 1 FOLLOWING AND 10080 FOLLOWING) AS later FROM e),
s AS (SELECT *, coalesce(v >= 3.0::DECIMAL(4,1) * long, false) AS r3, coalesce(v >= 2.0::DECIMAL(4,1) * long, false) AS r2, coalesce(v >= 1.5::DECIMAL(4,1) * long, false) OR coalesce(v - short >= 0.30::DECIMAL(4,2), false) AS rise FROM w),
staged AS (SELECT *, CASE WHEN r3 OR (rise AND v >= 4.0) THEN 3 WHEN r2 THEN 2 WHEN rise THEN 1 ELSE 0 END AS stage FROM s)"""


def _timeline(t: Tables, frames: dict[str, tuple[int, int]]) -> DataFrame:
    e = t.events.select("event_id", "user_id", _minutes().alias("t"), F.col("value").cast("decimal(10,2)").alias("v"))
    return ranks.range_minima(e, "user_id", "t", "v", frames)


@query(f"""WITH {_TIMELINE} SELECT event_id, short, long, least(long, later) AS either_side FROM staged""")
def range_minima(t: Tables) -> DataFrame:
    """WIN-01, JON-12, JON-13: least values strictly before, and on either side, within a reach."""
    found = _timeline(t, {"short": (-2880, -1), "long": (-10080, -1), "later": (1, 10080)})
    return found.select("event_id", "short", "long", F.least("long", "later").alias("either_side"))


@query(f"""WITH {_TIMELINE} SELECT user_id, stage, t FROM staged QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY stage DESC, t) = 1""")
def rise_stages(t: Tables) -> DataFrame:
    """WIN-02, MTH-01: each entity's highest stage by exact decimals, the earliest time on ties."""
    staged = _timeline(t, {"short": (-2880, -1), "long": (-10080, -1)}).withColumn("stage", ranks.rise_stage(F.col("v"), F.col("short"), F.col("long")))
    return ranks.highest_first(staged, "user_id", "stage", "t")


@query("""WITH c AS (SELECT c_custkey, c_nationkey, 1 + c_custkey % 7 AS n, c_acctbal < 0 AS dead FROM customer), p AS (SELECT *, unnest(range(n)) AS period FROM c),
h AS (SELECT period, count(*) AS at_risk, count(*) FILTER (dead AND period = n - 1) AS events FROM p GROUP BY 1)
SELECT period::INT AS period, at_risk, events, round(1 - exp(sum(ln(1 - events::DOUBLE / at_risk)) OVER (ORDER BY period)), 9) AS risk FROM h""")
def person_periods(t: Tables) -> DataFrame:
    """WIN-10, WIN-11, WIN-12: follow-up by period and the cumulative risk."""
    long = ranks.person_periods(t.customer, F.lit(1) + F.col("c_custkey") % 7, F.col("c_acctbal") < 0)
    hazard = long.groupBy("period").agg(F.count("*").alias("at_risk"), F.sum("event").alias("events"))
    upto = hazard.select(F.col("period").alias("upto"), F.col("at_risk").alias("n"), F.col("events").alias("k"))
    # one row a period: a handful, whatever the table
    both = hazard.join(F.broadcast(upto), F.col("upto") <= F.col("period"))
    return both.groupBy("period", "at_risk", "events").agg(F.round(ranks.cumulative_risk(F.col("k") / F.col("n")), 9).alias("risk"))


# --- routing ----------------------------------------------------------------

_ROUTES = """r AS (SELECT l_returnflag AS grp, l_discount * 10 AS top, (l_linenumber % 4 = 1 OR l_discount > 0.07) AS first_ok, (l_quantity > 10) AS second_ok, 0.04::DOUBLE AS first_cost, l_tax * 100 + 1 AS second_cost FROM lineitem)"""


def _routes(t: Tables) -> DataFrame:
    first_ok = (F.col("l_linenumber") % 4 == 1) | (F.col("l_discount") > 0.07)
    return t.lineitem.select(F.col("l_returnflag").alias("grp"), (F.col("l_discount") * 10).alias("top"), first_ok.alias("first_ok"), (F.col("l_quantity") > 10).alias("second_ok"), F.lit(0.04).alias("first_cost"), (F.col("l_tax") * 100 + 1).alias("second_cost"))


@query(f"""WITH {_ROUTES}, k AS (SELECT *, top >= 0.8 - 1e-9 AS keeps FROM r)
SELECT grp, count(*) AS n, count(*) FILTER (keeps) AS kept, count(*) FILTER (keeps AND NOT first_ok) AS kept_wrong, round(avg(second_ok::INT), 6) AS alone, round(avg((CASE WHEN keeps THEN first_ok ELSE second_ok END)::INT), 6) AS paired,
round(sum(first_cost + CASE WHEN keeps THEN 0 ELSE second_cost END) / sum(second_cost), 6) AS cost_share FROM k GROUP BY 1""")
def route_pairing(t: Tables) -> DataFrame:
    """HYB-02, HYB-10, HYB-11, CMP-33: two systems paired at a certainty threshold, by group."""
    r = _routes(t)
    out = routing.pairing(r, "grp", routing.certain(F.col("top"), 0.8), *[F.col(c) for c in ("first_ok", "second_ok", "first_cost", "second_cost")])
    return _rounded(out, "alone", "paired", "cost_share")


@query(f"""WITH {_ROUTES} SELECT threshold, count(*) FILTER (top >= threshold - 1e-9) AS kept, round(avg((CASE WHEN top >= threshold - 1e-9 THEN first_ok ELSE second_ok END)::INT), 6) AS accuracy FROM r CROSS JOIN (SELECT unnest(range(50, 101))::DOUBLE / 100 AS threshold) GROUP BY 1""")
def threshold_grid(t: Tables) -> DataFrame:
    """HYB-08: accuracy over the 51 thresholds from 0.50 to 1.00, in one pass."""
    return _rounded(routing.threshold_grid(_routes(t), "top", F.col("first_ok"), F.col("second_ok"), [k / 100 for k in range(50, 101)]), "accuracy")


_PRICED = """o AS (SELECT o_orderkey, o_totalprice, o_orderstatus = 'F' AS ok, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS k, count(*) OVER () AS n FROM orders)"""


@query(f"""WITH {_PRICED} SELECT share, count(*) FILTER (k <= floor(share * n + 1e-9)) AS kept, count(*) FILTER (k <= floor(share * n + 1e-9) AND ok) AS "right" FROM o CROSS JOIN (SELECT unnest([0.1, 0.25, 0.5, 1.0])::DOUBLE AS share) GROUP BY 1""")
def coverage_curve(t: Tables) -> DataFrame:
    """HYB-03, HYB-04, TOP-03, TOP-11: right answers among the most confident shares."""
    return routing.coverage_curve(t.orders, "o_totalprice", "o_orderkey", F.col("o_orderstatus") == "F", [0.1, 0.25, 0.5, 1.0])


@query("""WITH a AS (SELECT o_orderkey, o_totalprice, o_custkey + 0.5 AS second, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) <= floor(count(*) OVER () * 0.5 + 1e-9) AS one FROM orders),
b AS (SELECT *, row_number() OVER (ORDER BY second DESC, o_orderkey) <= floor(count(*) OVER () * 0.5 + 1e-9) AS two FROM a WHERE NOT one)
SELECT step::INT AS step, count(*) AS n, max(o_orderkey) AS last FROM (SELECT 1 AS step, o_orderkey FROM a WHERE one UNION ALL SELECT CASE WHEN two THEN 2 ELSE 3 END, o_orderkey FROM b) GROUP BY 1""")
def three_step_chain(t: Tables) -> DataFrame:
    """HYB-06, TOP-04, HYB-15: halves by confidence, twice."""
    rows = t.orders.select("o_orderkey", "o_totalprice", (F.col("o_custkey") + 0.5).alias("second"))
    return routing.three_step(rows, "o_totalprice", "second", "o_orderkey").groupBy("step").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))


@query("""WITH c AS (SELECT l_linenumber % 3 AS a, l_quantity::INT % 3 AS b, l_partkey % 3 AS c, l_suppkey % 3 AS truth FROM lineitem)
SELECT (a <> b) AS asked, count(*) AS n, round(avg(((CASE WHEN a = b THEN a ELSE c END) = truth)::INT), 6) AS accuracy FROM c GROUP BY 1""")
def agreement_cascade(t: Tables) -> DataFrame:
    """HYB-07, AGG-61: two systems' common answer stands, else a third is asked."""
    a, b, c = F.col("l_linenumber") % 3, F.col("l_quantity").cast("int") % 3, F.col("l_partkey") % 3
    answer, asked = routing.cascade(a, b, c)
    right = (answer == F.col("l_suppkey") % 3).cast("int")
    return t.lineitem.groupBy(asked.alias("asked")).agg(F.count("*").alias("n"), F.round(F.avg(right), 6).alias("accuracy"))


@query("""WITH g AS (SELECT l_discount AS threshold, avg((l_quantity > 5)::INT) >= 0.85 AS ok FROM lineitem GROUP BY 1) SELECT min(threshold) FILTER (held) AS lowest FROM (SELECT threshold, bool_and(ok) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS held FROM g)""")
def lowest_threshold(t: Tables) -> DataFrame:
    """WIN-14, TOP-12: the least threshold from which on all are acceptable."""
    g = t.lineitem.groupBy(F.col("l_discount").alias("threshold")).agg((F.avg((F.col("l_quantity") > 5).cast("int")) >= 0.85).alias("ok"))
    return routing.lowest_safe(g, "threshold", F.col("ok"))


# --- models -----------------------------------------------------------------


def _pages_of_risk(t: Tables) -> DataFrame:
    spent = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spent"), F.count("*").alias("orders"))
    rows = t.customer.join(spent, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select("c_custkey", "c_mktsegment", "c_acctbal", (F.coalesce("spent", F.lit(0.0)) / 1e6).alias("spent"), F.coalesce("orders", F.lit(0)).alias("orders"), (F.coalesce("orders", F.lit(0)) > 10).cast("int").alias("y"))


@query("""WITH RECURSIVE c AS (SELECT ln(q / (1 - q)) AS x, count(*)::DOUBLE AS n, sum((l_returnflag = 'R')::INT)::DOUBLE AS y FROM (SELECT least(greatest(l_discount * 10, 0.005), 0.995)::DOUBLE AS q, l_returnflag FROM lineitem) GROUP BY q),
it(k, a, b) AS (SELECT 0, 0::DOUBLE, 0::DOUBLE UNION ALL
SELECT k + 1, a + (sxx * r0 - sx * r1) / (s * sxx - sx * sx), b + (s * r1 - sx * r0) / (s * sxx - sx * sx) FROM (
SELECT k, a, b, sum(v) AS s, sum(v * x) AS sx, sum(v * x * x) AS sxx, sum(r) AS r0, sum(r * x) AS r1 FROM (
SELECT k, a, b, x, n * p * (1 - p) AS v, y - n * p AS r FROM (SELECT *, 1 / (1 + exp(-(a + b * x))) AS p FROM it CROSS JOIN c WHERE k < 15)) GROUP BY k, a, b))
SELECT round(a, 6) AS intercept, round(b, 6) AS slope FROM it WHERE k = 15""")
def recalibrated(t: Tables) -> DataFrame:
    """AGG-21, AGG-22: intercept and slope of outcomes on clipped log-odds."""
    p = values.clipped(F.col("l_discount") * 10)
    a, b = models.logistic_line(t.lineitem, values.log_odds(p), (F.col("l_returnflag") == "R").cast("int"), F.lit(1.0))
    return t.region.sparkSession.createDataFrame([(round(a, 6), round(b, 6))], "intercept double, slope double")


@query()
def crossfit_logistic(t: Tables) -> DataFrame:
    """MDL-01, MDL-02, MDL-05, MDL-07: predictions out of ten folds of a penalised spline fit."""
    return models.crossfitted(_pages_of_risk(t), "c_custkey", "y", ["c_acctbal", "spent"], ["c_mktsegment"], skewed=("spent",)).select("c_custkey", "y", "fold", F.round("p", 4).alias("p"))


@query()
def boosted_contrast(t: Tables) -> DataFrame:
    """MDL-03, MDL-08, PRJ-29: log-odds with one field edited minus without, by record."""
    rows = models.spread(_pages_of_risk(t).withColumn("y", F.col("y").cast("double")))
    fitted = models.boosted(["c_acctbal", "spent"], ["c_mktsegment"], "y").fit(rows)
    before = models.predicted(fitted, rows, ["c_custkey"])
    after = models.predicted(fitted, rows.withColumn("spent", F.col("spent") * 1.1), ["c_custkey"]).withColumnRenamed("p", "q")
    return before.join(after, "c_custkey").select("c_custkey", F.round(values.log_odds(F.col("q")) - values.log_odds(F.col("p")), 6).alias("contrast"))
