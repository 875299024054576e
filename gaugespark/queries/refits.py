"""Queries of exact draws, recalibration and refits of each draw, joint least squares and support against a fitting set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugespark.functions import values
from gaugespark.operators import distributions, documents, exact_draws, least_squares, metrics, models, provenance, resampling, slopes
from gaugespark.queries.base import Tables, digest_weight_sql, query
from gaugespark.queries.statistics import DRAWS
from gaugespark.sources.kept import kept

_INTERVAL = "round(quantile_cont(mean, 0.025), 9) AS low, round(quantile_cont(mean, 0.975), 9) AS high, round(stddev_samp(mean), 9) AS se"


@query(f"""WITH RECURSIVE u AS (SELECT o_custkey AS unit, '' AS stratum, sum((o_totalprice > 150000)::INT)::BIGINT AS s, count(*)::BIGINT AS k FROM orders GROUP BY 1),
{exact_draws.exact_sums_sql("u", ["s", "k"], DRAWS)}, d AS (SELECT s::DOUBLE / k AS mean, taken FROM drawn)
SELECT {_INTERVAL}, min(taken)::BIGINT AS least_taken, max(taken)::BIGINT AS most_taken FROM d""")
def exact_bootstrap(t: Tables) -> DataFrame:
    """BOOT-01, BOOT-03, BOOT-04: whole customers resampled by exact counts; every draw takes as many as there are."""
    units = t.orders.groupBy("o_custkey").agg(F.count_if(F.col("o_totalprice") > 150000).alias("s"), F.count("*").alias("k"))
    drawn = exact_draws.exact_sums(units, "o_custkey", ["s", "k"], DRAWS)
    d = drawn.select((F.col("s").cast("double") / F.col("k")).alias("mean"), "taken")
    low, high = F.percentile("mean", 0.025), F.percentile("mean", 0.975)
    return d.agg(F.round(low, 9).alias("low"), F.round(high, 9).alias("high"), F.round(F.stddev_samp("mean"), 9).alias("se"), F.min("taken").alias("least_taken"), F.max("taken").alias("most_taken"))


@query(f"""WITH RECURSIVE u AS (SELECT c_custkey AS unit, c_mktsegment AS stratum, (c_acctbal > 5000)::BIGINT AS y FROM customer),
{exact_draws.exact_sums_sql("u", ["y"], DRAWS)}, e AS (SELECT draw, stratum, taken, y::DOUBLE / taken AS mean FROM drawn), n AS (SELECT stratum, count(*) AS n FROM u GROUP BY 1),
every AS (SELECT draw, '' AS stratum, sum(mean * n) / sum(n) AS mean, sum(taken) AS taken, sum(n) AS n FROM e JOIN n USING (stratum) GROUP BY 1 UNION ALL SELECT draw, stratum, mean, taken, n FROM e JOIN n USING (stratum))
SELECT stratum, {_INTERVAL}, max(n)::BIGINT AS n, count(*) FILTER (taken = n) AS exact_draws FROM every GROUP BY 1""")
def exact_bootstrap_strata(t: Tables) -> DataFrame:
    """BOOT-02, BOOT-12: customers resampled within their segment by exact counts; each segment's interval, and (no name) that of all."""
    units = t.customer.select("c_custkey", "c_mktsegment", (F.col("c_acctbal") > 5000).cast("long").alias("y"))
    drawn = exact_draws.exact_sums(units, "c_custkey", ["y"], DRAWS, "c_mktsegment")
    e = kept(drawn.select("draw", "stratum", "n", "taken", (F.col("y").cast("double") / F.col("taken")).alias("mean")), "draws")
    every = e.groupBy("draw").agg(F.lit("").alias("stratum"), F.sum("n").alias("n"), F.sum("taken").alias("taken"), (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("mean"))
    both = e.unionByName(every)
    low, high = F.percentile("mean", 0.025), F.percentile("mean", 0.975)
    return both.groupBy("stratum").agg(F.round(low, 9).alias("low"), F.round(high, 9).alias("high"), F.round(F.stddev_samp("mean"), 9).alias("se"), F.max("n").alias("n"), F.count_if(F.col("taken") == F.col("n")).alias("exact_draws"))


_RISK = """r AS (SELECT l_suppkey AS unit, l_suppkey % 2 AS half, ln(q / (1 - q)) AS x, n, y FROM (SELECT l_suppkey, least(greatest(l_discount * 10, 0.005), 0.995)::DOUBLE AS q, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS y FROM lineitem GROUP BY ALL))"""


@query(f"""WITH RECURSIVE {_RISK}, w AS (SELECT unit, draw, {digest_weight_sql("unit")} AS w FROM (SELECT DISTINCT unit FROM r) CROSS JOIN (SELECT unnest(range({DRAWS})) AS draw)),
c AS (SELECT draw, half, x, sum(w * n)::DOUBLE AS n, sum(w * y)::DOUBLE AS y FROM r JOIN w USING (unit) GROUP BY ALL HAVING sum(w * n) > 0),
it(k, draw, half, a, b) AS (SELECT DISTINCT 0, draw, half, 0::DOUBLE, 0::DOUBLE FROM c UNION ALL
SELECT k + 1, draw, half, a + (sxx * r0 - sx * r1) / (s * sxx - sx * sx), b + (s * r1 - sx * r0) / (s * sxx - sx * sx) FROM (
SELECT k, draw, half, a, b, sum(v) AS s, sum(v * x) AS sx, sum(v * x * x) AS sxx, sum(r) AS r0, sum(r * x) AS r1 FROM (
SELECT k, draw, half, a, b, x, n * p * (1 - p) AS v, y - n * p AS r FROM (SELECT it.*, x, n, y, 1 / (1 + exp(-(a + b * x))) AS p FROM it JOIN c USING (draw, half) WHERE k < 9)) GROUP BY ALL)),
l AS (SELECT draw, half, a, b FROM it WHERE k = 9),
s AS (SELECT draw, l.half AS half, a, b, sum(-(y * ln(p) + (n - y) * ln(1 - p))) / sum(n) AS loss FROM (SELECT l.draw, l.half, a, b, n, y, least(greatest(1 / (1 + exp(-(a + b * x))), 1e-9), 1 - 1e-9) AS p FROM l JOIN c ON c.draw = l.draw AND c.half = 1 - l.half) l GROUP BY ALL)
SELECT half::INT AS fitted_on, count(*) AS draws, {", ".join(f"round(quantile_cont({c}, {q}), 6) AS {n}_{side}" for n, c in (("intercept", "a"), ("slope", "b"), ("loss", "loss")) for side, q in (("low", 0.025), ("high", 0.975)))} FROM s GROUP BY 1""")
def recalibrated_draws(t: Tables) -> DataFrame:
    """BOOT-11: intercept and slope fitted on each half of the suppliers in every draw, and the loss on the other half: intervals over draws."""
    p = values.clipped(F.col("l_discount") * 10)
    lines = t.lineitem.select("l_suppkey", (F.col("l_suppkey") % 2).alias("half"), values.log_odds(p).alias("x"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    units = lines.groupBy("l_suppkey", "half", "x").agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    cells = kept(resampling.drawn_sums(units, "l_suppkey", ["half", "x"], ["n", "y"], DRAWS, resampling.digest_weight).where("_t > 0").drop("_t"), "recalibration")
    fits = least_squares.logistic_draws(cells, ["draw", "half"], "x", "n", "y").select("draw", (1 - F.col("half")).alias("half"), F.col("half").alias("fitted_on"), "intercept", "slope")
    q = values.clipped(1 / (1 + F.exp(-(F.col("intercept") + F.col("slope") * F.col("x")))), 1e-9)
    loss = -(F.col("y") * F.log(q) + (F.col("n") - F.col("y")) * F.log(1 - q))
    scored = cells.join(fits, ["draw", "half"]).groupBy("draw", "fitted_on", "intercept", "slope").agg((F.sum(loss) / F.sum("n")).alias("loss"))
    ends = [F.round(F.percentile(c, q), 6).alias(f"{c}_{side}") for c in ("intercept", "slope", "loss") for side, q in (("low", 0.025), ("high", 0.975))]
    return scored.groupBy(F.col("fitted_on").cast("int").alias("fitted_on")).agg(F.count("*").alias("draws"), *ends)


_TERMS = """x AS (SELECT l_linenumber AS g, l_quantity::DOUBLE / 10 AS a, CASE WHEN l_linenumber % 3 = 0 THEN l_quantity::DOUBLE / 20 + 1 ELSE l_discount::DOUBLE * 10 END AS b, l_tax::DOUBLE * 10 AS c, l_extendedprice::DOUBLE / 1e4 AS y FROM lineitem)"""


@query(f"""WITH {_TERMS}, m AS (SELECT *, a - avg(a) OVER w AS a1, b - avg(b) OVER w AS b1, c - avg(c) OVER w AS c1, y - avg(y) OVER w AS y1 FROM x WINDOW w AS (PARTITION BY g)),
k AS (SELECT g, count(*) AS n, sum(a1 * b1) / sum(a1 * a1) AS ab, sum(a1 * c1) / sum(a1 * a1) AS ac, sum(a1 * y1) / sum(a1 * a1) AS ay FROM m GROUP BY 1),
r AS (SELECT g, n, ab, ac, ay, b1 - ab * a1 AS b2, c1 - ac * a1 AS c2, y1 - ay * a1 AS y2, b1 FROM m JOIN k USING (g)),
s AS (SELECT g, n, ab, ac, ay, sum(b2 * b2) > 1e-9 * sum(b1 * b1) AS full_rank, sum(b2 * b2) AS bb, sum(b2 * c2) AS bc, sum(c2 * c2) AS cc, sum(b2 * y2) AS yb, sum(c2 * y2) AS yc FROM r GROUP BY ALL),
t AS (SELECT *, CASE WHEN full_rank THEN (yc * bb - bc * yb) / (cc * bb - bc * bc) ELSE yc / cc END AS tax FROM s),
u AS (SELECT *, CASE WHEN full_rank THEN (yb - bc * tax) / bb END AS other FROM t)
SELECT g AS l_linenumber, n, round(ay - coalesce(ab * other, 0) - ac * tax, 6) AS quantity, round(other, 6) AS other, round(tax, 6) AS tax FROM u""")
def joint_least_squares(t: Tables) -> DataFrame:
    """AGG-34: three terms fitted together in each group; a term that the others determine is left out and null."""
    fixed = F.col("l_linenumber") % 3 == 0
    terms = {"quantity": F.col("l_quantity") / 10, "tax": F.col("l_tax") * 10, "other": F.when(fixed, F.col("l_quantity").cast("double") / 20 + 1).otherwise(F.col("l_discount").cast("double") * 10)}
    fits = least_squares.joint_slopes(t.lineitem, ["l_linenumber"], terms, F.col("l_extendedprice") / 1e4)
    return fits.select("l_linenumber", F.col("n").cast("long").alias("n"), *[F.round(c, 6).alias(c) for c in ("quantity", "other", "tax")])


#: Draws of refits, and the penalty of their slopes.
REFITS, RIDGE = 300, 1.0


@query()
def spline_refits(t: Tables, draws: int = REFITS) -> DataFrame:
    """BOOT-14, CMP-52: a penalised spline fit of each draw from its units' normal matrices; medians and knots are those of a subset."""
    rows = t.orders.select("o_custkey", F.log1p("o_totalprice").alias("price"), F.when(F.col("o_orderkey") % 7 > 0, F.col("o_custkey").cast("double")).alias("account"), (F.col("o_orderstatus") == "F").cast("double").alias("y"))
    subset = rows.where(F.xxhash64("o_custkey") % 3 != 0)
    basis, names, _ = models.spline_design(subset, ["price", "account"])
    designed = rows.select("o_custkey", "y", *basis)
    sums = least_squares.products([F.col(c) for c in names], F.col("y"))
    units = designed.groupBy("o_custkey").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    drawn = resampling.drawn_sums(units, "o_custkey", [], list(sums), draws, resampling.digest_weight)
    fits = least_squares.solved(drawn, ["draw"], names, RIDGE)
    return fits.select("draw", F.round("n").cast("long").alias("n"), *[F.round(c, 6).alias(c) for c in ("intercept", *names)])


_DOCUMENTS = """d AS (SELECT event_id, '{"type": "' || event_type || '", "props": ' || props || ', "history": [' || user_id || ', {"seen": null, "odd name": []}, ' || CASE WHEN event_id % 3 = 0 THEN 'true' ELSE '"' || event_type || '"' END || ']}' AS doc FROM events),
x AS (SELECT event_id, fullkey AS path, CASE type WHEN 'VARCHAR' THEN 'text' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS kind,
CASE WHEN type = 'VARCHAR' THEN atom ->> '$' WHEN type IN ('ARRAY', 'OBJECT') THEN '[]' ELSE nullif(atom::VARCHAR, 'null') END AS value
FROM (SELECT event_id, t.fullkey, t.type, t.atom, json_array_length(doc, t.fullkey) AS n FROM d, json_tree(d.doc) t) WHERE type <> 'OBJECT' AND (type <> 'ARRAY' OR n = 0))"""


def _documents(t: Tables) -> DataFrame:
    """A nested document of each event, as text."""
    last = F.when(F.col("event_id") % 3 == 0, "true").otherwise(F.concat(F.lit('"'), "event_type", F.lit('"')))
    parts = (F.lit('{"type": "'), F.col("event_type"), F.lit('", "props": '), F.col("props"), F.lit(', "history": ['), F.col("user_id"), F.lit(', {"seen": null, "odd name": []}, '), last, F.lit("]}"))
    return t.events.select("event_id", F.concat(*parts).alias("doc"))


@query(f"""WITH {_DOCUMENTS} SELECT path, kind, count(*) AS n, count(DISTINCT value) AS n_values, min(value) AS least FROM x GROUP BY path, kind""")
def document_leaves(t: Tables) -> DataFrame:
    """ARR-01, STR-23: the leaf paths of nested documents at any depth, with kinds and values."""
    found = documents.leaves(_documents(t), ["event_id"], "doc")
    return found.groupBy("path", "kind").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_values"), F.min("value").alias("least"))


@query(f"""WITH {_DOCUMENTS}, l AS (SELECT * FROM x), r AS (SELECT event_id - 1 AS event_id, path, kind, value FROM x),
b AS (SELECT coalesce(l.event_id, r.event_id) AS event_id, coalesce(l.path, r.path) AS path, CASE WHEN l.event_id IS NULL THEN 'added' WHEN r.event_id IS NULL THEN 'removed' WHEN l.kind <> r.kind OR l.value IS DISTINCT FROM r.value THEN 'changed' END AS change
FROM l FULL JOIN r ON l.event_id = r.event_id AND l.path = r.path)
SELECT path, change, CASE WHEN path LIKE '$.type%' THEN 'blocking' WHEN path LIKE '$.props%' THEN 'harmless' ELSE 'notable' END AS severity, count(*) AS n, min(event_id) AS first FROM b WHERE change IS NOT NULL GROUP BY ALL""")
def document_differences(t: Tables) -> DataFrame:
    """STR-22: the structural differences of every event's document and the next one's, with those that block; the first is added to nothing, the last removed."""
    docs = _documents(t)
    later = docs.withColumn("event_id", F.col("event_id") - 1)
    found = documents.differences(docs, later, ["event_id"], "doc", blocking=[r"^\$\.type"], harmless=[r"^\$\.props"])
    return found.groupBy("path", "change", "severity").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


_PART = "SELECT l_suppkey, {c}::VARCHAR AS label, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY l_suppkey) AS p FROM lineitem GROUP BY l_suppkey, {c}"


@query(f"""WITH a AS ({_PART.format(c="l_returnflag")}), b AS ({_PART.format(c="l_linestatus")}), c AS ({_PART.format(c="(l_linenumber % 3)")}),
j AS (SELECT l_suppkey, CASE WHEN a.label = 'N' AND c.label = '0' THEN NULL WHEN b.label = 'O' THEN 'open ' || c.label ELSE a.label || c.label END AS level, a.p * b.p * c.p AS p FROM a JOIN b USING (l_suppkey) JOIN c USING (l_suppkey)),
s AS (SELECT l_suppkey, level, sum(p) AS p FROM j WHERE level IS NOT NULL GROUP BY ALL)
SELECT l_suppkey, level, round(p / sum(p) OVER (PARTITION BY l_suppkey), 9) AS p FROM s""")
def joint_levels(t: Tables) -> DataFrame:
    """STR-09: the product of three parts' distributions folded to levels, given that there is a level."""

    def part(c, name: str) -> DataFrame:
        counted = t.lineitem.groupBy("l_suppkey", c.cast("string").alias("label")).agg(F.count("*").alias("n"))
        listed = counted.groupBy("l_suppkey").agg(F.collect_list(F.struct("label", "n")).alias("x"), F.sum("n").alias("all"))
        return listed.select("l_suppkey", F.transform("x", lambda x: F.struct(x["label"].alias("label"), (x["n"].cast("double") / F.col("all")).alias("p"))).alias(name))

    parts = part(F.col("l_returnflag"), "a").join(part(F.col("l_linestatus"), "b"), "l_suppkey").join(part(F.col("l_linenumber") % 3, "c"), "l_suppkey")
    one, two, three = (lambda x: F.get(x, F.lit(0))), (lambda x: F.get(x, F.lit(1))), (lambda x: F.get(x, F.lit(2)))
    level = lambda x: F.when((one(x) == "N") & (three(x) == "0"), F.lit(None).cast("string")).when(two(x) == "O", F.concat(F.lit("open "), three(x))).otherwise(F.concat(one(x), three(x)))
    told = parts.select("l_suppkey", distributions.level_distribution(distributions.joint([F.col(c) for c in "abc"]), level).alias("levels"))
    return told.select("l_suppkey", F.explode("levels").alias("level", "p")).withColumn("p", F.round("p", 9))


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, round(sum(l_quantity), 2) AS quantity, max(l_linestatus) AS mode FROM lineitem GROUP BY ALL), b AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 997 = 5 THEN quantity + 1 ELSE quantity END AS quantity, CASE WHEN l_orderkey % 1499 = 3 THEN NULL ELSE mode END AS mode FROM a WHERE l_orderkey % 1999 <> 7),
j AS (SELECT a.l_orderkey, a.l_linenumber, b.l_orderkey IS NULL AS gone, a.quantity AS q1, b.quantity AS q2, a.mode AS m1, b.mode AS m2 FROM a LEFT JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber)
SELECT l_orderkey, l_linenumber, 'quantity' AS "column", CASE WHEN gone THEN 'removed' ELSE 'changed' END AS change FROM j WHERE gone OR q1 <> q2
UNION ALL SELECT l_orderkey, l_linenumber, 'mode', CASE WHEN gone THEN 'removed' ELSE 'changed' END FROM j WHERE (gone AND m1 IS NOT NULL) OR (NOT gone AND m1 IS DISTINCT FROM m2)""")
def changed_cells(t: Tables) -> DataFrame:
    """CMP-27: the cells in which two result sets differ, found by descent from digests of blocks of them."""
    a = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.max("l_linestatus").alias("mode"))
    key = F.col("l_orderkey")
    b = a.where(key % 1999 != 7).withColumn("quantity", F.when(key % 997 == 5, F.col("quantity") + 1).otherwise(F.col("quantity"))).withColumn("mode", F.when(key % 1499 != 3, F.col("mode")))
    return provenance.changed(a, b, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "column", "change")


@query(f"""WITH r AS (SELECT l_suppkey AS unit, l_returnflag AS system, l_linenumber::VARCHAR AS edit, sum(l_discount - 0.02::DOUBLE) AS y, sum(l_tax) AS x, count(*) AS n FROM lineitem GROUP BY ALL),
w AS (SELECT unit, draw, {digest_weight_sql("unit")} AS w FROM (SELECT DISTINCT unit FROM r) CROSS JOIN (SELECT unnest(range({DRAWS})) AS draw)),
m AS (SELECT draw, system, edit, sum(w * y) / sum(w * n) AS y, sum(w * x) / sum(w * n) AS x FROM r JOIN w USING (unit) GROUP BY ALL HAVING sum(w * n) > 0 UNION ALL SELECT -1, system, edit, sum(y) / sum(n), sum(x) / sum(n) FROM r GROUP BY ALL),
o AS (SELECT DISTINCT system, edit AS without FROM r UNION ALL SELECT DISTINCT system, '' FROM r),
s AS (SELECT draw, system, without, sum(y * x) / nullif(sum(x * x), 0) AS slope FROM m JOIN o USING (system) WHERE edit <> without GROUP BY ALL),
e AS (SELECT system, without, stddev_samp(slope) AS se, avg(slope) AS centre FROM s WHERE draw >= 0 GROUP BY ALL),
c AS (SELECT without, quantile_cont(t, 0.95) AS c FROM (SELECT without, draw, max(abs(slope - centre) / se) AS t FROM s JOIN e USING (system, without) WHERE draw >= 0 AND se > 0 GROUP BY ALL) GROUP BY 1)
SELECT without, system, round(slope, 9) AS slope, round(slope - c * se, 6) AS low, round(slope + c * se, 6) AS high FROM s JOIN e USING (system, without) JOIN c USING (without) WHERE draw = -1""")
def slopes_without(t: Tables) -> DataFrame:
    """CMP-54, AGG-26, BOOT-06: each system's slope over edits with each edit left out, after the slopes kept of another path (means of edits, then sums) have come out again."""
    means = t.lineitem.groupBy("l_returnflag", "l_linenumber").agg(F.avg(F.col("l_discount") - 0.02).alias("y"), F.avg("l_tax").alias("x"))
    stored = kept(metrics.origin_slope(means, "l_returnflag", "y", "x").withColumnRenamed("l_returnflag", "system"), "reported-slopes")
    out = slopes.slopes_without(t.lineitem, "l_suppkey", "l_returnflag", "l_linenumber", F.col("l_discount") - 0.02, F.col("l_tax"), stored, DRAWS, resampling.digest_weight)
    return out.select("without", "system", F.round("slope", 9).alias("slope"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))
