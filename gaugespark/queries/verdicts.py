"""Queries of whole workflows: accuracy, cost, verdicts with costs, hybrids by log-loss, effects in units of another field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugespark.functions import values
from gaugespark.operators import resampling
from gaugespark.queries.base import Tables, digest_weight_sql, query
from gaugespark.queries.composites import FIRST, _first
from gaugespark.queries.statistics import DRAWS
from gaugespark.sources.kept import kept

#: Each workflow: whether it is right, and what it costs, of three systems a, b, c with a certainty `top` of the first.
WORKFLOWS = {
    "first": ("a", "0.04"),
    "second": ("b", "second_cost"),
    "third": ("c", "0.5"),
    "paired_80": ("CASE WHEN top >= 0.8 - 1e-9 THEN a ELSE b END", "0.04 + CASE WHEN top >= 0.8 - 1e-9 THEN 0 ELSE second_cost END"),
    "paired_50": ("CASE WHEN top >= 0.5 - 1e-9 THEN a ELSE b END", "0.04 + CASE WHEN top >= 0.5 - 1e-9 THEN 0 ELSE second_cost END"),
    "agreed": ("CASE WHEN a = b THEN a ELSE c END", "0.04 + second_cost + CASE WHEN a = b THEN 0 ELSE 0.5 END"),
    "majority": ("CASE WHEN a + b + c >= 2 THEN 1 ELSE 0 END", "0.54 + second_cost"),
    "chain": ("CASE WHEN top >= 0.8 - 1e-9 THEN a WHEN top >= 0.4 - 1e-9 THEN c ELSE b END", "0.04 + CASE WHEN top >= 0.8 - 1e-9 THEN 0 WHEN top >= 0.4 - 1e-9 THEN 0.5 ELSE second_cost END"),
}
MARGIN = 0.05
_ITEMS = """i AS (SELECT l_suppkey, (l_discount * 10)::DOUBLE AS top, (l_linenumber % 4 = 1 OR l_discount > 0.07)::INT AS a, (l_quantity > 10)::INT AS b, (l_tax > 0.02)::INT AS c, (l_tax * 100 + 1)::DOUBLE AS second_cost FROM lineitem)"""
_SUMS = ", ".join(f"sum({right})::DOUBLE AS r_{name}, sum({cost})::DOUBLE AS c_{name}" for name, (right, cost) in WORKFLOWS.items())
_LONG = " UNION ALL ".join(f"SELECT '{name}' AS workflow, draw, sum(w * (r_{name} - r_second)) / sum(w * n) AS d FROM x GROUP BY draw HAVING sum(w * n) > 0" for name in WORKFLOWS)
_POINT = " UNION ALL ".join(f"SELECT '{name}' AS workflow, sum(n)::BIGINT AS n, sum(r_{name}) / sum(n) AS accuracy, sum(c_{name}) / sum(n) AS cost, sum(r_{name} - r_second) / sum(n) AS difference, sum(c_{name}) / sum(c_second) AS cost_ratio, (sum(c_{name}) - sum(c_first)) / nullif(sum(r_{name}) - sum(r_first), 0) AS extra_cost FROM u" for name in WORKFLOWS)


@query(f"""WITH {_ITEMS}, u AS (SELECT l_suppkey, count(*)::DOUBLE AS n, {_SUMS} FROM i GROUP BY 1), x AS (SELECT *, {digest_weight_sql("l_suppkey")} AS w FROM u CROSS JOIN (SELECT unnest(range({DRAWS})) AS draw)),
d AS ({_LONG}), b AS (SELECT workflow, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high FROM d GROUP BY 1), p AS ({_POINT})
SELECT workflow, n, round(accuracy, 6) AS accuracy, round(cost, 6) AS cost, round(difference, 6) AS difference, round(low, 6) AS low, round(high, 6) AS high, round(cost_ratio, 6) AS cost_ratio, round(extra_cost, 6) AS extra_cost,
CASE WHEN low > 0 AND cost_ratio < 1 THEN 'dominates' WHEN low > {-MARGIN} AND cost_ratio < 1 THEN 'acceptable cheaper' WHEN low > {-MARGIN} THEN 'acceptable' ELSE 'not acceptable' END AS verdict FROM p JOIN b USING (workflow)""")
def workflow_verdicts(t: Tables) -> DataFrame:
    """CMP-31, CMP-39, BOOT-16, HYB-12: eight workflows' accuracy and cost, their difference from the second system alone by draws of
    whole suppliers, the cost of one more right answer than the first alone gives, and a verdict by bound and cost."""
    items = t.lineitem.select(
        "l_suppkey", (F.col("l_discount") * 10).cast("double").alias("top"), ((F.col("l_linenumber") % 4 == 1) | (F.col("l_discount") > 0.07)).cast("int").alias("a"),
        (F.col("l_quantity") > 10).cast("int").alias("b"), (F.col("l_tax") > 0.02).cast("int").alias("c"), (F.col("l_tax") * 100 + 1).cast("double").alias("second_cost"),
    )
    sums = [F.sum(F.expr(e).cast("double")).alias(f"{k}_{name}") for name, (right, cost) in WORKFLOWS.items() for k, e in (("r", right), ("c", cost))]
    units = items.groupBy("l_suppkey").agg(F.count("*").cast("double").alias("n"), *sums)
    drawn = resampling.drawn_sums(units, "l_suppkey", [], ["n", *[f"r_{w}" for w in WORKFLOWS]], DRAWS, resampling.digest_weight).where("n > 0")
    weighed = drawn.select("draw", "n", *[(F.col(f"r_{w}") - F.col("r_second")).alias(w) for w in WORKFLOWS])
    long = weighed.select(F.explode(F.array(*[F.struct(F.lit(w).alias("workflow"), (F.col(w) / F.col("n")).alias("d")) for w in WORKFLOWS])).alias("x")).select("x.*")
    bounds = long.groupBy("workflow").agg(F.percentile("d", 0.025).alias("low"), F.percentile("d", 0.975).alias("high"))
    n, of = F.sum("n"), lambda c: F.sum(c)
    point = units.agg(n.cast("long").alias("n"), F.array(*[
        F.struct(F.lit(w).alias("workflow"), F.try_divide(of(f"r_{w}"), n).alias("accuracy"), F.try_divide(of(f"c_{w}"), n).alias("cost"), F.try_divide(of(f"r_{w}") - of("r_second"), n).alias("difference"),
                 F.try_divide(of(f"c_{w}"), of("c_second")).alias("cost_ratio"), F.try_divide(of(f"c_{w}") - of("c_first"), of(f"r_{w}") - of("r_first")).alias("extra_cost"))
        for w in WORKFLOWS]).alias("x")).select("n", F.inline("x"))
    both = point.join(bounds, "workflow")
    cheaper = F.col("cost_ratio") < 1
    verdict = F.when((F.col("low") > 0) & cheaper, "dominates").when((F.col("low") > -MARGIN) & cheaper, "acceptable cheaper").when(F.col("low") > -MARGIN, "acceptable").otherwise("not acceptable")
    return both.select("workflow", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "cost", "difference", "low", "high", "cost_ratio", "extra_cost")], verdict.alias("verdict"))


#: Certainties from which a hybrid stays with the first system.
STAYS = (0.1, 0.2, 0.3, 0.4)
_LOSS = "-(y * ln({q}) + (1 - y) * ln(1 - {q}))"
_HYBRIDS = " UNION ALL ".join(f"SELECT {s}::DOUBLE AS stays, item, CASE WHEN abs(n - 0.5) >= {s} - 1e-9 THEN ln_n - ln_a ELSE 0 END AS d FROM l" for s in STAYS)


@query(f"""WITH {FIRST}, w AS (SELECT item, max(p) FILTER (system = 'N') AS n, max(p) FILTER (system = 'A') AS a, max(truth) AS truth FROM first WHERE item IN (SELECT item FROM common) GROUP BY 1),
m AS (SELECT *, (truth = 1)::INT AS y, least(greatest(n, 0.01), 0.99)::DOUBLE AS qn, least(greatest(a, 0.01), 0.99)::DOUBLE AS qa FROM w), l AS (SELECT item, n, {_LOSS.format(q="qn")} AS ln_n, {_LOSS.format(q="qa")} AS ln_a FROM m),
h AS ({_HYBRIDS}), z AS (SELECT item, draw, {digest_weight_sql("item")} AS w FROM (SELECT item FROM l) CROSS JOIN (SELECT unnest(range({DRAWS})) AS draw)),
e AS (SELECT stays, draw, sum(w * d) / sum(w) AS mean FROM h JOIN z USING (item) GROUP BY ALL HAVING sum(w) > 0), s AS (SELECT stays, stddev_samp(mean) AS se, avg(mean) AS centre FROM e GROUP BY 1),
t AS (SELECT quantile_cont(t, 0.95) AS c FROM (SELECT max(abs(mean - centre) / se) AS t FROM e JOIN s USING (stays) WHERE se > 0 GROUP BY draw)), p AS (SELECT stays, avg(d) AS d FROM h GROUP BY 1)
SELECT stays, round(d, 6) AS difference, round(d - c * se, 6) AS low, round(d + c * se, 6) AS high FROM p JOIN s USING (stays) CROSS JOIN t""")
def loss_hybrids(t: Tables) -> DataFrame:
    """HYB-05: hybrids' log-loss less the second system's alone, with intervals that hold for all thresholds together (max-t over draws of items)."""
    pick = lambda s: F.max(F.when(F.col("system") == s, F.col("p")))
    w = _first(t).groupBy("item").agg(pick("N").alias("n"), pick("A").alias("a"), pick("R").alias("r"), F.max("truth").alias("truth")).where("n is not null and a is not null and r is not null")
    y = (F.col("truth") == 1).cast("int")
    gap = values.log_loss(F.col("n").cast("double"), y, 0.01) - values.log_loss(F.col("a").cast("double"), y, 0.01)
    wide = w.select("item", *[F.when(F.abs(F.col("n") - 0.5) >= s - 1e-9, gap).otherwise(0.0).alias(f"d{i}") for i, s in enumerate(STAYS)])
    long = lambda df, *also: df.select(*also, F.explode(F.array(*[F.struct(F.lit(s).alias("stays"), F.col(f"d{i}").alias("d")) for i, s in enumerate(STAYS)])).alias("x")).select(*also, "x.*")
    drawn = resampling.drawn_sums(wide, "item", [], [f"d{i}" for i in range(len(STAYS))], DRAWS, resampling.digest_weight).where("_t > 0")
    drawn = kept(long(drawn.select("draw", *[(F.col(f"d{i}") / F.col("_t")).alias(f"d{i}") for i in range(len(STAYS))]), "draw"), "draws")
    point = long(wide.agg(*[F.avg(f"d{i}").alias(f"d{i}") for i in range(len(STAYS))]))
    out = resampling.simultaneous(drawn, point, "stays", "d")
    return out.select("stays", F.round("d", 6).alias("difference"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(f"""WITH u AS (SELECT l_suppkey, l_linenumber, sum(l_extendedprice) FILTER (l_discount > 0.05)::DOUBLE AS a, count(*) FILTER (l_discount > 0.05) AS na, sum(l_extendedprice) FILTER (l_discount <= 0.05)::DOUBLE AS b, count(*) FILTER (l_discount <= 0.05) AS nb FROM lineitem GROUP BY ALL),
w AS (SELECT l_suppkey, draw, {digest_weight_sql("l_suppkey")} AS w FROM (SELECT DISTINCT l_suppkey FROM lineitem) CROSS JOIN (SELECT unnest(range({DRAWS})) AS draw)),
d AS (SELECT l_linenumber, draw, sum(w * coalesce(a, 0)) / sum(w * na) - sum(w * coalesce(b, 0)) / sum(w * nb) AS d FROM u JOIN w USING (l_suppkey) GROUP BY ALL HAVING sum(w * na) > 0 AND sum(w * nb) > 0),
e AS (SELECT l_linenumber, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high FROM d GROUP BY 1), p AS (SELECT l_linenumber, sum(a) / sum(na) - sum(b) / sum(nb) AS effect FROM u GROUP BY 1), s AS (SELECT regr_slope(l_extendedprice, l_quantity) AS slope FROM lineitem)
SELECT l_linenumber, round(effect, 4) AS effect, round(low, 4) AS low, round(high, 4) AS high, round(CASE WHEN NOT (low <= 0 AND high >= 0) THEN effect / slope END, 6) AS equivalent FROM p JOIN e USING (l_linenumber) CROSS JOIN s""")
def unit_equivalents(t: Tables) -> DataFrame:
    """AGG-38: an effect in units of another field (how much more quantity has it), left out where its interval spans 0."""
    high = F.col("l_discount") > 0.05
    price = F.col("l_extendedprice").cast("double")
    units = t.lineitem.groupBy("l_suppkey", "l_linenumber").agg(F.sum(F.when(high, price).otherwise(0.0)).alias("a"), F.count_if(high).alias("na"), F.sum(F.when(~high, price).otherwise(0.0)).alias("b"), F.count_if(~high).alias("nb"))
    drawn = resampling.drawn_sums(units, "l_suppkey", ["l_linenumber"], ["a", "na", "b", "nb"], DRAWS, resampling.digest_weight).where("na > 0 and nb > 0")
    gap = F.col("a") / F.col("na") - F.col("b") / F.col("nb")
    ends = drawn.withColumn("d", gap).groupBy("l_linenumber").agg(F.percentile("d", 0.025).alias("low"), F.percentile("d", 0.975).alias("high"))
    point = units.groupBy("l_linenumber").agg((F.try_divide(F.sum("a"), F.sum("na")) - F.try_divide(F.sum("b"), F.sum("nb"))).alias("effect"))
    slope = t.lineitem.agg(F.regr_slope("l_extendedprice", "l_quantity").alias("slope"))
    spans = (F.col("low") <= 0) & (F.col("high") >= 0)
    both = point.join(ends, "l_linenumber").join(F.broadcast(slope))
    return both.select("l_linenumber", *[F.round(c, 4).alias(c) for c in ("effect", "low", "high")], F.round(F.when(~spans, F.try_divide("effect", "slope")), 6).alias("equivalent"))
