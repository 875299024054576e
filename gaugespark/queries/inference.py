"""Queries of step-down bounds, stratified draws, exact intervals, cross-fits, support and imputation."""

from __future__ import annotations

from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugespark.functions import values
from gaugespark.operators import keys, models, ranks, resampling, routing
from gaugespark.queries.base import Tables, digest_weight_sql, query
from gaugespark.queries.statistics import _DRAWN_BY, _ROUTES, DRAWS, _drawn, _routes

MARGIN = 0.01


def _bounds_sql(name: str, x: str, margin: float) -> str:
    """operators.resampling.holm_bounds of the CTE e (g, x) in DuckDB's SQL, as CTEs ending in name."""
    at = lambda step: f"v[floor(0.025::DOUBLE / (m - {step}) * (len(v) - 1))::INT + 1]"
    return f"""{name}_v AS (SELECT g, list_sort(list({x})) AS v, count(*) FILTER ({x} <= {-margin}::DOUBLE) AS k, quantile_cont({x}, 0.5) AS med FROM e GROUP BY g),
{name}_r AS (SELECT *, row_number() OVER (ORDER BY k, -med, g) - 1 AS i, count(*) OVER () AS m FROM {name}_v),
{name}_f AS (SELECT *, min(CASE WHEN {at("i")} <= {-margin}::DOUBLE THEN i END) OVER () AS fail FROM {name}_r),
{name} AS (SELECT g, {at("least(i, coalesce(fail, i))")} AS bound, fail IS NULL OR i < fail AS ok FROM {name}_f)"""


@query(f"""WITH {_DRAWN_BY}, e AS (SELECT o_orderpriority AS g, mean - 0.7::DOUBLE AS x FROM d), {_bounds_sql("low", "x", MARGIN)}, {_bounds_sql("high", "-x", -MARGIN)}
SELECT low.g AS o_orderpriority, round(low.bound, 9) AS lower, round(-high.bound, 9) AS "upper", CASE WHEN low.ok THEN 'non-inferior' WHEN high.ok THEN 'worse' ELSE 'inconclusive' END AS outcome FROM low JOIN high USING (g)""")
def holm_bounds(t: Tables) -> DataFrame:
    """BOOT-07, BOOT-08: step-down lower and upper bounds of a family's differences and three outcomes."""
    e = _drawn(t, DRAWS, ["o_orderpriority"]).withColumn("x", F.col("mean") - 0.7)
    out = resampling.holm_outcomes(e, "o_orderpriority", "x", MARGIN)
    return out.select("o_orderpriority", F.round("lower", 9).alias("lower"), F.round("upper", 9).alias("upper"), "outcome")


@query(f"""WITH u AS (SELECT c_custkey AS unit, c_mktsegment AS g, (c_acctbal > 5000)::INT AS y FROM customer), w AS (SELECT *, {digest_weight_sql("unit")} AS w FROM u CROSS JOIN (SELECT unnest(range({DRAWS})) AS draw)),
s AS (SELECT draw, g, sum(w * y)::DOUBLE / sum(w) AS mean FROM w GROUP BY ALL HAVING sum(w) > 0), n AS (SELECT g, count(*)::DOUBLE / (SELECT count(*) FROM u) AS share FROM u GROUP BY 1),
d AS (SELECT draw, sum(share * mean) / sum(share) AS mean FROM s JOIN n USING (g) GROUP BY 1)
SELECT round(quantile_cont(mean, 0.025), 9) AS low, round(quantile_cont(mean, 0.975), 9) AS high, round(stddev_samp(mean), 9) AS se FROM d""")
def bootstrap_stratified(t: Tables) -> DataFrame:
    """BOOT-02: units resampled within their stratum, strata at their own shares in every draw."""
    units = t.customer.select("c_custkey", "c_mktsegment", (F.col("c_acctbal") > 5000).cast("int").alias("y"))
    d = resampling.stratified_means(units, "c_custkey", "c_mktsegment", F.col("y"), DRAWS, resampling.digest_weight)
    return resampling.interval(d, "mean").select(*[F.round(c, 9).alias(c) for c in ("low", "high", "se")])


@query()
def clopper_pearson(t: Tables) -> DataFrame:
    """AGG-53: exact binomial intervals; the inverse beta is worked out for a row of each group only."""
    per = t.lineitem.groupBy("l_returnflag").agg(F.count_if(F.col("l_discount") > 0.05).alias("k"), F.count("*").alias("n"))
    return values.exact_intervals(per, "k", "n").select("l_returnflag", "k", "n", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query(f"""WITH {_ROUTES}, x AS (SELECT *, coalesce(first_ok, false)::INT AS a, coalesce(second_ok, false)::INT AS b FROM r), q AS (SELECT DISTINCT unnest(quantile_cont(top, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS th FROM x UNION SELECT 'infinity'::DOUBLE),
g AS (SELECT th, avg((top >= th)::INT) AS share, avg(CASE WHEN top >= th THEN a ELSE b END) AS accuracy, avg(first_cost + CASE WHEN top >= th THEN 0 ELSE second_cost END) AS cost, avg(a) AS a, avg(b) AS b FROM x CROSS JOIN q GROUP BY 1)
SELECT CASE WHEN th < 'infinity' THEN round(th, 9) END AS threshold, round(share, 6) AS share, round(accuracy, 6) AS accuracy, round(cost, 6) AS cost, round(share * a + (1 - share) * b, 6) AS random_line, accuracy >= b - 0.02 - 1e-12 AS within_margin FROM g""")
def decile_hybrid(t: Tables) -> DataFrame:
    """HYB-01: a hybrid at the deciles of certainty and at none, beside random routing, and whether it stays within a margin."""
    out = routing.decile_grid(_routes(t), "top", F.col("first_ok"), F.col("second_ok"), F.col("first_cost"), F.col("second_cost"), 0.02)
    return out.select(F.round("threshold", 9).alias("threshold"), *[F.round(c, 6).alias(c) for c in ("share", "accuracy", "cost", "random_line")], "within_margin")


PARTNERS = {"first": ("l_quantity", 10), "second": ("l_quantity", 5), "third": ("l_tax", 0.02)} | {f"partner_{q}": ("l_quantity", q) for q in (15, 20, 25, 30, 35, 40, 45)}
_GAIN = ", ".join(f"sum(CASE WHEN top >= th - 1e-9 THEN w * a ELSE w * {p} END - w * {p})::DOUBLE / sum(w * n) AS {p}" for p in PARTNERS)


@query(f"""WITH u AS (SELECT l_suppkey, l_discount * 10 AS top, count(*) AS n, count(*) FILTER (l_linenumber % 4 = 1 OR l_discount > 0.07) AS a, {", ".join(f"count(*) FILTER ({c} > {x}) AS {p}" for p, (c, x) in PARTNERS.items())} FROM lineitem GROUP BY ALL),
w AS (SELECT l_suppkey, draw, {digest_weight_sql("l_suppkey")} AS w FROM (SELECT DISTINCT l_suppkey FROM lineitem) CROSS JOIN (SELECT unnest(range({DRAWS})) AS draw)),
c AS (SELECT draw, top, 1 AS w, sum(w * n) AS n, sum(w * a) AS a, {", ".join(f"sum(w * {p}) AS {p}" for p in PARTNERS)} FROM u JOIN w USING (l_suppkey) GROUP BY ALL),
g AS (SELECT draw, th, {_GAIN} FROM c CROSS JOIN (SELECT unnest(range(50, 101))::DOUBLE / 100 AS th) GROUP BY ALL HAVING sum(n) > 0),
l AS (UNPIVOT g ON {", ".join(PARTNERS)} INTO NAME partner VALUE gain), b AS (SELECT partner, th, quantile_cont(gain, 0.025) AS low FROM l GROUP BY ALL), f AS (SELECT partner, max(th) FILTER (low <= -0.3) AS refused FROM b GROUP BY 1)
SELECT partner, min(th) FILTER (refused IS NULL OR th > refused) AS lowest, round(max(low), 6) AS best FROM b JOIN f USING (partner) GROUP BY 1""")
def lowest_noninferior(t: Tables) -> DataFrame:
    """HYB-09: of 51 thresholds, the lowest from which on a hybrid isn't worse than each partner alone by a
    margin, by bootstrap bounds over suppliers."""
    first_ok = (F.col("l_linenumber") % 4 == 1) | (F.col("l_discount") > 0.07)
    cells = t.lineitem.groupBy("l_suppkey", (F.col("l_discount") * 10).alias("top")).agg(F.count("*").alias("n"), F.count_if(first_ok).alias("a"), *[F.count_if(F.col(c) > x).alias(p) for p, (c, x) in PARTNERS.items()])
    gains = routing.drawn_gains(cells, "l_suppkey", "top", "n", "a", list(PARTNERS), [k / 100 for k in range(50, 101)], DRAWS)
    bounds = gains.groupBy("partner", "threshold").agg(F.percentile("gain", 0.025).alias("low"))
    lowest = routing.lowest_safe(bounds, "threshold", F.col("low") > -0.3, ["partner"])
    return lowest.join(bounds.groupBy("partner").agg(F.round(F.max("low"), 6).alias("best")), "partner")


def _stages_sql(k: int) -> str:
    steps = ["""WITH o AS (SELECT o_orderkey, o_custkey, o_orderpriority AS level, md5(o_orderkey::VARCHAR) AS h FROM orders), lv AS (SELECT level, row_number() OVER (ORDER BY count(*), level) AS r FROM o GROUP BY 1),
s0 AS (SELECT NULL::BIGINT AS o_orderkey, NULL::BIGINT AS o_custkey, NULL::VARCHAR AS level WHERE false)"""]
    for i in range(1, 6):
        steps.append(f"""c{i} AS (SELECT o.* FROM o JOIN lv USING (level) WHERE r = {i} AND o_custkey NOT IN (SELECT o_custkey FROM s{i - 1}) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY h, o_orderkey) = 1),
s{i} AS (SELECT * FROM s{i - 1} UNION ALL (SELECT o_orderkey, o_custkey, level FROM c{i} ORDER BY h, o_orderkey LIMIT {k}))""")
    return ", ".join(steps) + " SELECT * FROM s5"


@query(_stages_sql(12))
def staged_sample(t: Tables) -> DataFrame:
    """TOP-07: a seeded sample of each level, the rarest first, no customer twice (the sample is the feature)."""
    rows = t.orders.select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("level"), F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("h"))
    return keys.staged_sample(rows, "level", "o_custkey", ["h", "o_orderkey"], 12).select("o_orderkey", "o_custkey", "level")


@query("""WITH f AS (SELECT n_name, c_custkey % 2 AS version, count(*)::DOUBLE AS n, avg((c_acctbal > 4500)::INT) AS share FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL),
p AS (SELECT *, exp(-2 * n * (share - 0.5) * (share - 0.5)) AS p FROM f), s AS (SELECT *, least(1.0, (count(*) OVER v - row_number() OVER (PARTITION BY version ORDER BY p, n_name) + 1) * p) AS step FROM p WINDOW v AS (PARTITION BY version)),
h AS (SELECT n_name, version, max(step) OVER (PARTITION BY version ORDER BY p, n_name ROWS UNBOUNDED PRECEDING) AS holm_p FROM s)
SELECT n_name, round(max(holm_p) FILTER (version = 0), 6) AS first_p, round(max(holm_p) FILTER (version = 1), 6) AS second_p, max(holm_p) < 0.5 AS reproduced FROM h GROUP BY 1""")
def reproduced_family(t: Tables) -> DataFrame:
    """CMP-35: a family's adjusted p in each of two item orders, and what holds in both."""
    f = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", (F.col("c_custkey") % 2).alias("version"))
    f = f.agg(F.count("*").cast("double").alias("n"), F.avg((F.col("c_acctbal") > 4500).cast("int")).alias("share"))
    p = f.withColumn("p", F.exp(-2 * F.col("n") * (F.col("share") - 0.5) * (F.col("share") - 0.5)))
    h = resampling.holm(p, "p", "n_name", ["version"])
    of = lambda v: F.max(F.when(F.col("version") == v, F.col("holm_p")))
    return h.groupBy("n_name").agg(F.round(of(0), 6).alias("first_p"), F.round(of(1), 6).alias("second_p"), (F.max("holm_p") < 0.5).alias("reproduced"))


@query("""WITH a AS (SELECT l_returnflag AS arm, l_linestatus AS version, l_partkey, round(l_extendedprice / l_quantity, 4) AS unit, l_quantity FROM lineitem),
i AS (SELECT l_partkey, count(DISTINCT unit) AS units, count(DISTINCT arm) AS arms FROM a GROUP BY 1), b AS (SELECT a.*, units FROM a JOIN i USING (l_partkey) WHERE arms = 3)
SELECT arm, version, count(*) AS n, round(avg(l_quantity), 6) AS quantity, count(DISTINCT l_partkey) AS items, count(DISTINCT CASE WHEN units > 1 THEN l_partkey END) AS varying FROM b GROUP BY ALL""")
def arm_invariance(t: Tables) -> DataFrame:
    """CMP-27: arms and versions side by side, and the shared items whose fixed value isn't the same in all."""
    a = t.lineitem.select(F.col("l_returnflag").alias("arm"), F.col("l_linestatus").alias("version"), "l_partkey", F.round(F.col("l_extendedprice") / F.col("l_quantity"), 4).alias("unit"), "l_quantity")
    i = a.groupBy("l_partkey").agg(F.count_distinct("unit").alias("units"), F.count_distinct("arm").alias("arms")).where("arms = 3")
    b = a.join(i, "l_partkey")
    return b.groupBy("arm", "version").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("quantity"), F.count_distinct("l_partkey").alias("items"), F.count_distinct(F.when(F.col("units") > 1, F.col("l_partkey"))).alias("varying"))


def _risk(t: Tables) -> DataFrame:
    x = values.log_odds(values.clipped(F.col("l_discount") * 10))
    return t.lineitem.select("l_suppkey", "l_orderkey", x.alias("x"), (F.col("l_returnflag") == "R").cast("int").alias("y"))


@query()
def recalibrated_halves(t: Tables) -> DataFrame:
    """BOOT-11: intercept and slope fitted on each half of the orders, and the loss on the other half."""
    rows = _risk(t).withColumn("half", F.pmod(F.xxhash64("l_orderkey"), F.lit(2)).cast("int"))
    lines = models.logistic_lines(rows, "half", "x", "y")
    p = 1 / (1 + F.exp(-(F.col("intercept") + F.col("slope") * F.col("x"))))
    scored = rows.join(F.broadcast(lines), rows["half"] == 1 - lines["half"]).select(lines["half"].alias("fitted_on"), "intercept", "slope", values.log_loss(p, F.col("y"), 1e-9).alias("loss"))
    return scored.groupBy("fitted_on", "intercept", "slope").agg(F.count("*").alias("n"), F.round(F.avg("loss"), 6).alias("log_loss")).withColumns({c: F.round(c, 6) for c in ("intercept", "slope")})


@query()
def leave_group_logistic(t: Tables) -> DataFrame:
    """MDL-09, CMP-54: each nation scored by a logistic fit of all the others (25 fits in one aggregation a round)."""
    spent = t.orders.groupBy("o_custkey").agg(F.count("*").alias("orders"))
    rows = t.customer.join(spent, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_nationkey", (F.coalesce("orders", F.lit(0)) / 10.0).alias("x"), (F.col("c_acctbal") > 5000).cast("int").alias("y"))
    # equal rows are counted first, so that leaving each group out in turn repeats counts, not rows
    counted = rows.groupBy("c_nationkey", "x", "y").agg(F.count("*").alias("w"))
    groups = rows.select("c_nationkey").distinct().withColumnRenamed("c_nationkey", "left_out")
    others = counted.join(F.broadcast(groups), F.col("left_out") != F.col("c_nationkey"))
    lines = models.logistic_lines(others, "left_out", "x", "y", F.col("w"))
    p = 1 / (1 + F.exp(-(F.col("intercept") + F.col("slope") * F.col("x"))))
    own = counted.join(F.broadcast(lines), F.col("left_out") == F.col("c_nationkey"))
    loss = F.sum(F.col("w") * values.log_loss(p, F.col("y"), 1e-9)) / F.sum("w")
    return own.groupBy("c_nationkey", "intercept", "slope").agg(F.sum("w").alias("n"), F.round(loss, 6).alias("log_loss")).withColumns({c: F.round(c, 6) for c in ("intercept", "slope")})


@query()
def survival_logit(t: Tables) -> DataFrame:
    """MDL-04: a discrete-time survival logistic on person-periods, and each customer's cumulative risk."""
    people = t.customer.select("c_custkey", (F.col("c_acctbal") / 1e4).alias("x"), (F.lit(1) + F.col("c_custkey") % 7).alias("periods"), (F.col("c_acctbal") < 0).alias("dead"))
    long = ranks.person_periods(people, F.col("periods"), F.col("dead"))
    fitted = models.hazard_logistic(["x"], "period", "event").fit(long)
    # every customer over all periods that any has, a handful
    last = long.agg(F.max("period").alias("last"))
    every = people.join(F.broadcast(last)).withColumn("period", F.explode(F.sequence(F.lit(0), F.col("last"))))
    hazard = models.predicted(fitted, every, ["c_custkey", "period"])
    return hazard.groupBy("c_custkey").agg(F.round(ranks.cumulative_risk(F.col("p")), 6).alias("risk"))


@query()
def category_support(t: Tables) -> DataFrame:
    """FLT-09, FLT-11: whether a customer would be at home in another segment: its probability there by a
    multinomial fit, against the 0.025 quantile of that segment's own members."""
    spent = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spent"), F.count("*").alias("orders"))
    rows = t.customer.join(spent, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_mktsegment", "c_acctbal", F.log1p(F.coalesce("spent", F.lit(0.0))).alias("spent"), F.coalesce("orders", F.lit(0)).alias("orders"))
    p = models.category_probabilities(rows, ["c_acctbal", "spent", "orders"], "c_mktsegment", least=20).select("c_custkey", "c_mktsegment", F.explode("p").alias("segment", "p"))
    own = ranks.percentiles(p.where("segment = c_mktsegment"), "p", (0.025,), ["segment"]).select("segment", F.col("p")[0].alias("limit"))
    return p.where("segment <> c_mktsegment").join(F.broadcast(own), "segment").select("c_custkey", "segment", F.round("p", 6).alias("p"), (F.col("p") >= F.col("limit")).alias("supported"))


@query()
def imputed_values(t: Tables) -> DataFrame:
    """MDL-10: a masked field (the length of a text) imputed from the others by boosted regression, fitted on half of the rows and
    scored on the other, beside the median of the fitting half."""
    parts = lambda by: F.size(F.split("text", by, -1)).cast("double")
    rows = t.documents.select(parts(" ").alias("words"), parts("\n").alias("lines"), F.col("n_chars").cast("double").alias("truth"), (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).alias("fit"))
    fitted = models.regression(["words", "lines"], GBTRegressor(labelCol="truth", maxIter=20, maxDepth=4, stepSize=0.3, seed=7)).fit(rows.where("fit"))
    median = ranks.percentiles(rows.where("fit"), "truth", (0.5,)).select(F.col("p")[0].alias("median"))
    scored = fitted.transform(rows.where("not fit")).join(F.broadcast(median))
    gap = lambda c: F.avg(F.abs(F.col(c) - F.col("truth")))
    return scored.agg(F.count("*").alias("n"), F.round(gap("prediction"), 2).alias("error"), F.round(gap("median"), 2).alias("median_error"), F.round(F.avg((F.abs(F.col("prediction") - F.col("truth")) < 0.005).cast("int")), 6).alias("exact"))
