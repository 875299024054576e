"""Queries of whole analysis blocks over one long table of calls.

The calls are the lines: the system is l_returnflag, the item l_partkey, the
variant l_linestatus; a call is usable where l_tax is over 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugespark.functions import values
from gaugespark.operators import keys, neighbours, ranks, resampling
from gaugespark.queries.base import Tables, digest_weight_sql, query
from gaugespark.queries.statistics import DRAWS

SYSTEMS = ["A", "N", "R"]
CALLS = """calls AS (SELECT l_returnflag AS system, l_partkey AS item, l_linestatus AS variant, l_linenumber % 4 AS answer, l_partkey % 4 AS truth, l_discount * 10 AS p, l_tax > 0 AS valid, l_quantity AS tokens,
l_orderkey, l_linenumber, l_suppkey, l_extendedprice FROM lineitem)"""
FIRST = (
    CALLS
    + """, first AS (SELECT * FROM calls WHERE valid QUALIFY row_number() OVER (PARTITION BY system, item ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) = 1),
common AS (SELECT item FROM first GROUP BY item HAVING count(*) = 3)"""
)
ORDER = ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]


def _calls(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_returnflag").alias("system"), F.col("l_partkey").alias("item"), F.col("l_linestatus").alias("variant"), (F.col("l_linenumber") % 4).alias("answer"), (F.col("l_partkey") % 4).alias("truth"), (F.col("l_discount") * 10).alias("p"),
        (F.col("l_tax") > 0).alias("valid"), F.col("l_quantity").alias("tokens"), *ORDER,
    )


def _first(t: Tables) -> DataFrame:
    """Each system's first usable call of an item: one aggregation, no sort of a hot item."""
    columns = F.struct(*ORDER, "answer", "truth", "p", "tokens", "variant")
    return _calls(t).where("valid").groupBy("system", "item").agg(F.min(columns).alias("c")).select("system", "item", "c.*")


def _wide(t: Tables) -> DataFrame:
    """One row for each item that every system answered: p and right of each system."""
    per = _first(t).groupBy("item").agg(*[F.max(F.when(F.col("system") == s, F.struct("p", (F.col("answer") == F.col("truth")).cast("int").alias("ok"), "tokens"))).alias(s) for s in SYSTEMS])
    return per.where(" and ".join(f"{s} is not null" for s in SYSTEMS))


def _mean(c: Column, name: str, digits: int = 6) -> Column:
    return F.round(F.avg(c), digits).alias(name)


@query(f"""WITH {FIRST} SELECT p_partkey AS item, s AS system, p FROM part CROSS JOIN (SELECT unnest(['A', 'N', 'R']) AS s) LEFT JOIN first ON item = p_partkey AND system = s""")
def first_valid(t: Tables) -> DataFrame:
    """CMP-03, FLT-06, JON-10: each system's first usable answer, aligned to the list of items."""
    grid = t.part.select(F.col("p_partkey").alias("item"), F.explode(F.array(*[F.lit(s) for s in SYSTEMS])).alias("system"))
    return keys.aligned(grid, _first(t).select("item", "system", "p"), ["item", "system"], {}).select("item", "system", "p")


@query(f"""WITH {FIRST} SELECT system, count(*) AS n, round(avg(p), 6) AS mean, round(avg(-((truth = 1)::INT * ln(least(greatest(p, 0.01), 0.99)) + (truth <> 1)::INT * ln(1 - least(greatest(p, 0.01), 0.99)))), 6) AS log_loss FROM first WHERE item IN (SELECT item FROM common) GROUP BY 1""")
def common_records(t: Tables) -> DataFrame:
    """CMP-11, CMP-29, CMP-41: every system on the records that all of them scored."""
    first = _first(t)
    common = keys.in_all(first, "item", "system", len(SYSTEMS))
    loss = values.log_loss(F.col("p"), (F.col("truth") == 1).cast("int"), 0.01)
    return first.join(common, "item", "left_semi").groupBy("system").agg(F.count("*").alias("n"), _mean(F.col("p"), "mean"), _mean(loss, "log_loss"))


@query(f"""WITH {CALLS}, s AS (SELECT system, truth, avg((valid AND answer = truth)::INT) AS a FROM calls GROUP BY ALL), b AS (SELECT system, avg(a) AS balanced FROM s GROUP BY 1)
SELECT system, count(*) AS n, count(*) FILTER (valid) AS usable, round(avg((valid AND answer = truth)::INT), 6) AS accuracy, round(balanced, 6) AS balanced, round(avg(abs(answer - truth)) FILTER (valid), 6) AS mae, round(sum(tokens) * 1000 / count(*), 4) AS per_1000,
round(sum(tokens) / count(*) FILTER (valid AND answer = truth), 6) AS per_correct FROM calls JOIN b USING (system) GROUP BY system, balanced""")
def system_block(t: Tables) -> DataFrame:
    """CMP-01, CMP-13, CMP-15, CMP-17, CMP-18, AGG-48: a system's block, from one pass by stratum."""
    right = F.col("valid") & (F.col("answer") == F.col("truth"))
    strata = _calls(t).groupBy("system", "truth").agg(F.count("*").alias("n"), F.count_if("valid").alias("usable"), F.count_if(right).alias("right"), F.sum(F.when(F.col("valid"), F.abs(F.col("answer") - F.col("truth")))).alias("off"), F.sum("tokens").alias("tokens"))
    total = {c: F.sum(c) for c in ("n", "usable", "right", "off", "tokens")}
    return strata.groupBy("system").agg(
        total["n"].alias("n"), total["usable"].alias("usable"), F.round(total["right"] / total["n"], 6).alias("accuracy"), _mean(F.col("right") / F.col("n"), "balanced"), F.round(total["off"] / total["usable"], 6).alias("mae"),
        F.round(total["tokens"] * 1000 / total["n"], 4).alias("per_1000"), F.round(total["tokens"] / total["right"], 6).alias("per_correct"),
    )


@query(f"""WITH {FIRST}, w AS (SELECT item, max((answer = truth)::INT) FILTER (system = 'N') AS n, max((answer = truth)::INT) FILTER (system = 'A') AS a, max((answer = truth)::INT) FILTER (system = 'R') AS r FROM first WHERE item IN (SELECT item FROM common) GROUP BY 1),
l AS (SELECT 'A' AS other, n, a AS o FROM w UNION ALL SELECT 'R', n, r FROM w)
SELECT other, count(*) AS n, count(*) FILTER (n = 1 AND o = 1) AS both, count(*) FILTER (n = 1 AND o = 0) AS only_focal, count(*) FILTER (n = 0 AND o = 1) AS only_other, round(avg(n - o), 6) AS difference FROM l GROUP BY 1""")
def focal_comparison(t: Tables) -> DataFrame:
    """CMP-16, CMP-06, CMP-28: one system against the others on common items, with the 2 x 2 counts."""
    long = _wide(t).select(F.col("N.ok").alias("f"), F.explode(F.array(*[F.struct(F.lit(s).alias("other"), F.col(s)["ok"].alias("o")) for s in ("A", "R")])).alias("x")).select("f", "x.*")
    cell = lambda f, o, name: F.count_if((F.col("f") == f) & (F.col("o") == o)).alias(name)
    return long.groupBy("other").agg(F.count("*").alias("n"), cell(1, 1, "both"), cell(1, 0, "only_focal"), cell(0, 1, "only_other"), _mean(F.col("f") - F.col("o"), "difference"))


@query(f"""WITH {FIRST}, d(system, tier, pair_with) AS (VALUES ('A', 'free', 'N'), ('R', 'high', 'N'))
SELECT d.system, tier, count(*) AS n, round(avg(x.p - y.p), 6) AS contrast FROM d JOIN first x ON x.system = d.system JOIN first y ON y.system = pair_with AND y.item = x.item GROUP BY ALL""")
def tier_contrast(t: Tables) -> DataFrame:
    """CMP-04, CMP-07, CMP-08: contrasts of each system with its pair in a small table of tiers."""
    spark = t.lineitem.sparkSession
    tiers = spark.createDataFrame([("A", "free", "N"), ("R", "high", "N")], "system string, tier string, pair_with string")
    first = _first(t).select("system", "item", "p")
    pairs = first.join(F.broadcast(tiers), "system").join(first.select(F.col("system").alias("pair_with"), "item", F.col("p").alias("q")), ["pair_with", "item"])
    return pairs.groupBy("system", "tier").agg(F.count("*").alias("n"), _mean(F.col("p") - F.col("q"), "contrast"))


@query(f"""WITH {CALLS}, m AS (SELECT system, item, avg(p) FILTER (variant = 'F') AS f, avg(p) FILTER (variant = 'O') AS o FROM calls WHERE valid GROUP BY ALL)
SELECT system, count(*) AS n, round(avg(f - o), 6) AS shift, round(avg(f + o), 6) AS total, round(stddev_samp(f + o), 6) AS spread, round(min(f + o), 6) AS least, round(max(f + o), 6) AS most, round(avg((abs(f - o) > 0.1)::INT), 6) AS moved FROM m WHERE f IS NOT NULL AND o IS NOT NULL GROUP BY 1""")
def variant_shift(t: Tables) -> DataFrame:
    """CMP-02, CMP-05, CMP-09, JON-20, AGG-31, AGG-32: paired variants: shift, complement and spread."""
    side = lambda v: F.avg(F.when(F.col("variant") == v, F.col("p")))
    m = _calls(t).where("valid").groupBy("system", "item").agg(side("F").alias("f"), side("O").alias("o")).where("f is not null and o is not null")
    both = F.col("f") + F.col("o")
    return m.groupBy("system").agg(F.count("*").alias("n"), _mean(F.col("f") - F.col("o"), "shift"), _mean(both, "total"), F.round(F.stddev_samp(both), 6).alias("spread"), F.round(F.min(both), 6).alias("least"), F.round(F.max(both), 6).alias("most"), _mean((F.abs(F.col("f") - F.col("o")) > 0.1).cast("int"), "moved"))


@query("""WITH v AS (SELECT l_returnflag AS system, l_quantity AS a, l_discount * 200 AS b, l_tax * 300 + 1 AS c, l_linenumber % 3 <= 1 AS y FROM lineitem),
e AS (SELECT *, (a + b) / (a + b + c) >= 0.5 AS by_sum, NOT (c > a AND c > b) AS by_top FROM v)
SELECT system, count(*) FILTER (by_sum) AS flagged_sum, count(*) FILTER (by_top) AS flagged_top, count(*) FILTER (by_sum <> by_top) AS disagree, round(avg((by_sum = y)::INT), 6) AS accuracy_sum, round(avg((by_top = y)::INT), 6) AS accuracy_top FROM e GROUP BY 1""")
def grouped_endpoint(t: Tables) -> DataFrame:
    """AGG-52, CMP-30, CMP-32: levels summed into an endpoint, or the top level's; ties to the lower."""
    p = F.array(F.col("l_quantity"), F.col("l_discount") * 200, F.col("l_tax") * 300 + 1)
    total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
    by_sum, by_top = (p[0] + p[1]) / total >= 0.5, F.array_position(p, F.array_max(p)) <= 2
    y = F.col("l_linenumber") % 3 <= 1
    rows = t.lineitem.select(F.col("l_returnflag").alias("system"), by_sum.alias("s"), by_top.alias("m"), y.alias("y"))
    same = lambda c: (F.col(c) == F.col("y")).cast("int")
    return rows.groupBy("system").agg(F.count_if("s").alias("flagged_sum"), F.count_if("m").alias("flagged_top"), F.count_if(F.col("s") != F.col("m")).alias("disagree"), _mean(same("s"), "accuracy_sum"), _mean(same("m"), "accuracy_top"))


@query(f"""WITH {CALLS} SELECT system, variant, CASE WHEN NOT valid THEN 'unusable' WHEN answer = truth THEN 'correct' WHEN answer = (truth + 1) % 4 THEN 'misread' ELSE 'other' END AS outcome, count(*) AS n FROM calls GROUP BY ALL""")
def misreads(t: Tables) -> DataFrame:
    """AGG-56, CMP-26: right answers, a given wrong one, others and unusable ones by site."""
    outcome = F.when(~F.col("valid"), "unusable").when(F.col("answer") == F.col("truth"), "correct").when(F.col("answer") == (F.col("truth") + 1) % 4, "misread").otherwise("other")
    return _calls(t).groupBy("system", "variant", outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query(f"""WITH {CALLS} SELECT system, round(avg((answer = truth)::INT) FILTER (variant = 'F'), 6) AS narrative, round(avg((answer = truth)::INT) FILTER (variant = 'O'), 6) AS synoptic,
round(avg((answer = truth)::INT) FILTER (variant = 'F') - avg((answer = truth)::INT) FILTER (variant = 'O'), 6) AS difference FROM calls GROUP BY 1""")
def format_difference(t: Tables) -> DataFrame:
    """AGG-58, AGG-64, HYB-16: accuracy by format and its difference, in one pass."""
    right = (F.col("answer") == F.col("truth")).cast("int")
    at = lambda v: F.avg(F.when(F.col("variant") == v, right))
    return _calls(t).groupBy("system").agg(F.round(at("F"), 6).alias("narrative"), F.round(at("O"), 6).alias("synoptic"), F.round(at("F") - at("O"), 6).alias("difference"))


@query(f"""WITH {CALLS}, g AS (SELECT system, avg((abs(p - truth * 0.1) < 0.05 - 1e-9)::INT) AS exact, avg(abs(p - truth * 0.1)) AS mae FROM calls GROUP BY 1)
SELECT g.system, round(g.exact, 6) AS exact, round(g.mae, 6) AS mae, round(g.mae / b.mae, 6) AS ratio, g.mae < 0.5 * b.mae AS flagged FROM g JOIN g b ON b.system = 'N'""")
def exposure_summary(t: Tables) -> DataFrame:
    """AGG-60: exact matches at a precision, error and its ratio to a baseline system's."""
    off = F.abs(F.col("p") - F.col("truth") * 0.1)
    g = _calls(t).groupBy("system").agg(F.avg((off < 0.05 - 1e-9).cast("int")).alias("exact"), F.avg(off).alias("mae"))
    base = g.where("system = 'N'").select(F.col("mae").alias("base"))
    out = g.join(F.broadcast(base))
    return out.select("system", F.round("exact", 6).alias("exact"), F.round("mae", 6).alias("mae"), F.round(F.col("mae") / F.col("base"), 6).alias("ratio"), (F.col("mae") < 0.5 * F.col("base")).alias("flagged"))


@query("""WITH r AS (SELECT l_linenumber % 4 AS a, l_quantity::INT % 3 AS b, l_linestatus AS c, l_partkey % 4 AS ta, l_partkey % 3 AS tb, 'F' AS tc, CASE WHEN l_tax > 0 THEN l_discount * 10 END AS pa, 0.5::DOUBLE AS pb FROM lineitem)
SELECT part, count(*) AS n, round(avg(ok), 6) AS accuracy, round(avg(wrong), 6) AS wrong_parts, round(avg(joint), 6) AS joint
FROM (SELECT unnest(['a', 'b', 'c']) AS part, unnest([(a = ta)::INT, (b = tb)::INT, (c = tc)::INT]) AS ok, 3 - (a = ta)::INT - (b = tb)::INT - (c = tc)::INT AS wrong, pa * pb AS joint FROM r) GROUP BY 1""")
def part_accuracy(t: Tables) -> DataFrame:
    """CMP-24, CMP-25: parts of an answer, wrong parts per row, joint confidence if all are known."""
    right = {"a": F.col("l_linenumber") % 4 == F.col("l_partkey") % 4, "b": F.col("l_quantity").cast("int") % 3 == F.col("l_partkey") % 3, "c": F.col("l_linestatus") == "F"}
    joint = F.when(F.col("l_tax") > 0, F.col("l_discount") * 10) * 0.5
    rows = t.lineitem.select(*[c.cast("int").alias(k) for k, c in right.items()], joint.alias("joint")).withColumn("wrong", 3 - F.col("a") - F.col("b") - F.col("c"))
    long = rows.select("wrong", "joint", F.explode(F.array(*[F.struct(F.lit(k).alias("part"), F.col(k).alias("ok")) for k in right])).alias("x")).select("wrong", "joint", "x.*")
    return long.groupBy("part").agg(F.count("*").alias("n"), _mean(F.col("ok"), "accuracy"), _mean(F.col("wrong"), "wrong_parts"), _mean(F.col("joint"), "joint"))


@query(f"""WITH {CALLS}, g AS (SELECT system, variant, CASE WHEN truth < 2 THEN 'early' ELSE 'late' END AS tg, CASE WHEN answer < 2 THEN 'early' ELSE 'late' END AS ag, answer = truth AS ok FROM calls)
SELECT system, grp, count(*) FILTER (tg = 'late' AND ag = 'early') AS down, count(*) FILTER (tg = 'early' AND ag = 'late') AS "up", count(*) FILTER (tg = ag AND NOT ok) AS within FROM (SELECT *, unnest(['all', variant]) AS grp FROM g) GROUP BY ALL""")
def stage_crossings(t: Tables) -> DataFrame:
    """CMP-34, CMP-38, PRJ-38: errors that cross a border and errors within; a row is in several groups."""
    group = lambda c: F.when(F.col(c) < 2, "early").otherwise("late")
    g = _calls(t).select("system", F.explode(F.array(F.lit("all"), "variant")).alias("grp"), group("truth").alias("t"), group("answer").alias("a"), (F.col("answer") == F.col("truth")).alias("ok"))
    return g.groupBy("system", "grp").agg(F.count_if((F.col("t") == "late") & (F.col("a") == "early")).alias("down"), F.count_if((F.col("t") == "early") & (F.col("a") == "late")).alias("up"), F.count_if((F.col("t") == F.col("a")) & ~F.col("ok")).alias("within"))


@query(f"""WITH {CALLS} SELECT system, CASE WHEN p >= 1 - 1e-9 THEN 'full' WHEN p >= 0.9 - 1e-9 THEN '0.9' WHEN p >= 0.5 - 1e-9 THEN '0.5' ELSE 'low' END AS band, count(*) FILTER (valid AND answer = truth) AS "right", count(*) FILTER (NOT (valid AND answer = truth)) AS wrong FROM calls GROUP BY ALL""")
def confidence_bands(t: Tables) -> DataFrame:
    """PRJ-34, PRJ-35, FLT-17, AGG-54: right and wrong answers by band, with a tolerance."""
    at = lambda x: F.col("p") >= x - 1e-9
    band = F.when(at(1.0), "full").when(at(0.9), "0.9").when(at(0.5), "0.5").otherwise("low")
    right = F.col("valid") & (F.col("answer") == F.col("truth"))
    return _calls(t).groupBy("system", band.alias("band")).agg(F.count_if(right).alias("right"), F.count_if(~right).alias("wrong"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber >= 1 AND l_tax > 0 THEN l_linenumber + l_quantity::INT % 5 + 1 END AS total,
concat_ws('; ', CASE WHEN l_quantity < 20 THEN 'few' WHEN l_quantity < 40 THEN 'some' ELSE 'many' END, CASE WHEN l_tax > 0 THEN CASE WHEN l_discount / l_tax < 1 THEN 'under' ELSE 'over' END END) AS state FROM lineitem""")
def guarded_scores(t: Tables) -> DataFrame:
    """PRJ-09, PRJ-17, PRJ-18: a sum that needs all its parts, and bands gated on a flag."""
    on = F.col("l_tax") > 0
    total = F.when((F.col("l_linenumber") >= 1) & on, F.col("l_linenumber") + F.col("l_quantity").cast("int") % 5 + 1)
    few = values.ladder(F.col("l_quantity"), [(20, "few"), (40, "some")], "many")
    ratio = F.when(on, values.ladder(F.try_divide("l_discount", "l_tax"), [(1, "under")], "over"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", total.alias("total"), F.concat_ws("; ", few, ratio).alias("state"))


@query("""WITH r AS (SELECT CASE WHEN a = 3 THEN 'IV' WHEN a + b >= 3 THEN 'III' WHEN b > 0 THEN 'II' ELSE 'I' END AS stage, 'T' || a || ' N' || b AS cell, a, b FROM (SELECT unnest(range(4)) AS a) CROSS JOIN (SELECT unnest(range(2)) AS b))
SELECT stage, string_agg(cell, '; ' ORDER BY cell) AS definition, count(*) AS cells FROM r GROUP BY 1""")
def level_definitions(t: Tables) -> DataFrame:
    """PRJ-41: each level's definition as text, from the rules; eight cells, whatever the tables."""
    cells = t.region.sparkSession.range(8).select(F.floor(F.col("id") / 2).cast("int").alias("a"), (F.col("id") % 2).cast("int").alias("b"))
    stage = F.when(F.col("a") == 3, "IV").when(F.col("a") + F.col("b") >= 3, "III").when(F.col("b") > 0, "II").otherwise("I")
    return cells.groupBy(stage.alias("stage")).agg(F.array_join(F.array_sort(F.collect_list(F.format_string("T%d N%d", "a", "b"))), "; ").alias("definition"), F.count("*").alias("cells"))


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE lower((o_totalprice > 150000)::VARCHAR) = 'true' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def variant_rows(t: Tables) -> DataFrame:
    """FLT-14, DFL-02: rows whose value, as text, is the asked one, narrowed to a subset."""
    chosen = t.orders.where(F.lower((F.col("o_totalprice") > 150000).cast("string")) == "true")
    return chosen.join(t.lineitem.where("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_custkey")


@query("""SELECT a.vec_id, a.label, round(sqrt(min(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2)))), 4) AS distance
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY a.vec_id, a.label, a.embedding""")
def nearest_distance(t: Tables) -> DataFrame:
    """FLT-08: each vector's distance to the nearest of all others, in cells of pivots that bounds leave open."""
    found = neighbours.nearest(t.embeddings, t.embeddings, "vec_id", "embedding").select("vec_id", F.round("distance", 4).alias("distance"))
    return t.embeddings.select("vec_id", "label").join(found, "vec_id")


@query()
def nearest_support(t: Tables) -> DataFrame:
    """FLT-08, FLT-11: each vector's distance to the nearest of all others, supported up to the 0.95 quantile."""
    found = neighbours.supported(t.embeddings, t.embeddings, "vec_id", "embedding")
    return t.embeddings.select("vec_id", "label").join(found, "vec_id").select("vec_id", "label", F.round("distance", 4).alias("distance"), "supported")


_DRAWS = f"(SELECT unnest(range({DRAWS})) AS draw)"


@query(f"""WITH u AS (SELECT o_custkey, count(*)::DOUBLE AS n, sum(o_totalprice / 1e5) AS x, sum(o_totalprice / 1e5 * (o_orderstatus = 'F')::INT) AS xy, sum((o_totalprice / 1e5) ** 2) AS xx, sum((o_orderstatus = 'F')::INT)::DOUBLE AS y FROM orders GROUP BY 1),
w AS (SELECT *, {digest_weight_sql("o_custkey")} AS w FROM u CROSS JOIN {_DRAWS})
SELECT draw::INT AS draw, round((sum(w * n) * sum(w * xy) - sum(w * x) * sum(w * y)) / (sum(w * n) * sum(w * xx) - sum(w * x) ** 2), 6) AS slope FROM w GROUP BY 1""")
def refit_slopes(t: Tables, draws: int = DRAWS) -> DataFrame:
    """BOOT-14: a straight line refitted on each draw, from sums of its resampling units."""
    x, y = F.col("o_totalprice") / 1e5, (F.col("o_orderstatus") == "F").cast("double")
    units = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(x).alias("x"), F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"), F.sum(y).alias("y"))
    s = resampling.drawn_sums(units, "o_custkey", [], ["n", "x", "xy", "xx", "y"], draws, resampling.digest_weight).where("n > 0")
    n, x, xy, xx, y = (F.col(c) for c in ("n", "x", "xy", "xx", "y"))
    return s.select("draw", F.round((n * xy - x * y) / (n * xx - x * x), 6).alias("slope"))


@query(f"""WITH u AS (SELECT l_suppkey, l_quantity AS s, count(*) FILTER (l_returnflag = 'R') AS p, count(*) FILTER (l_returnflag <> 'R') AS q FROM lineitem GROUP BY ALL),
w AS (SELECT l_suppkey, draw, {digest_weight_sql("l_suppkey")} AS w FROM (SELECT DISTINCT l_suppkey FROM lineitem) CROSS JOIN {_DRAWS}),
c AS (SELECT draw, s, sum(w * p)::DOUBLE AS p, sum(w * q)::DOUBLE AS q FROM u JOIN w USING (l_suppkey) GROUP BY ALL),
b AS (SELECT *, sum(q) OVER (PARTITION BY draw ORDER BY s) - q / 2 AS under FROM c)
SELECT draw::INT AS draw, round(sum(p * under) / nullif(sum(p) * sum(q), 0), 6) AS auroc FROM b GROUP BY 1""")
def auroc_by_draw(t: Tables, draws: int = DRAWS) -> DataFrame:
    """CMP-53: the weighted AUROC of each draw, null for one class.

    Whole suppliers are resampled; lines are first summed by supplier and
    score, so draws multiply sums, not lines.
    """
    pos = F.col("l_returnflag") == "R"
    units = t.lineitem.groupBy("l_suppkey", F.col("l_quantity").alias("s")).agg(F.count_if(pos).alias("p"), F.count_if(~pos).alias("q"))
    c = resampling.drawn_sums(units, "l_suppkey", ["s"], ["p", "q"], draws, resampling.digest_weight)
    upto = Window.partitionBy("draw").orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    b = c.withColumn("under", F.sum("q").over(upto) - F.col("q") / 2)
    return b.groupBy("draw").agg(F.round(F.sum(F.col("p") * F.col("under")) / F.nullif(F.sum("p") * F.sum("q"), F.lit(0.0)), 6).alias("auroc"))


@query("""WITH p AS (SELECT rep, test, ('0x' || substr(md5(rep || ':' || test), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS p FROM (SELECT unnest(range(400)) AS rep) CROSS JOIN (SELECT unnest(range(5)) AS test))
SELECT round(avg((least <= 0.05 / 5)::INT), 6) AS family_error, round(avg((least <= 0.05)::INT), 6) AS uncorrected FROM (SELECT min(p) AS least FROM p GROUP BY rep)""")
def family_error(t: Tables) -> DataFrame:
    """BOOT-18: the family-wise error of simulated tests, corrected and not."""
    p = t.region.sparkSession.range(400).select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("test"))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("rep").cast("string"), F.col("test").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") / 4294967296.0
    least = p.groupBy("rep").agg(F.min(u).alias("least"))
    return least.agg(_mean((F.col("least") <= 0.05 / 5).cast("int"), "family_error"), _mean((F.col("least") <= 0.05).cast("int"), "uncorrected"))


@query(f"""WITH {FIRST}, w AS (SELECT item, max(p) FILTER (system = 'N') AS n, max(p) FILTER (system = 'A') AS a, max(tokens) FILTER (system = 'A') AS ta, max(truth) AS truth FROM first WHERE item IN (SELECT item FROM common) GROUP BY 1),
l AS (SELECT *, (truth = 1)::INT AS y, abs(n - 0.5) >= 0.3 - 1e-9 AS keeps FROM w), m AS (SELECT *, least(greatest(n, 0.01), 0.99) AS qn, least(greatest(a, 0.01), 0.99) AS qa FROM l)
SELECT count(*) AS n, count(*) FILTER (keeps) AS kept, round(avg(-(y * ln(qn) + (1 - y) * ln(1 - qn))), 6) AS first_loss, round(avg(-(y * ln(qa) + (1 - y) * ln(1 - qa))), 6) AS second_loss,
round(avg(-(y * ln(CASE WHEN keeps THEN qn ELSE qa END) + (1 - y) * ln(1 - CASE WHEN keeps THEN qn ELSE qa END))), 6) AS paired_loss, round(coalesce(sum(least(ta / 3, ta)) FILTER (NOT keeps), 0), 4) AS tokens FROM m""")
def hybrid_log_loss(t: Tables) -> DataFrame:
    """HYB-14, CMP-29: a hybrid scored by log-loss on common records, and its tokens."""
    first = _first(t)
    pick = lambda s, c: F.max(F.when(F.col("system") == s, F.col(c)))
    w = first.groupBy("item").agg(pick("N", "p").alias("n"), pick("A", "p").alias("a"), pick("R", "p").alias("r"), pick("A", "tokens").alias("ta"), F.max("truth").alias("truth")).where("n is not null and a is not null and r is not null")
    keeps, y = F.abs(F.col("n") - 0.5) >= 0.3 - 1e-9, (F.col("truth") == 1).cast("int")
    loss = lambda p: values.log_loss(p, y, 0.01)
    spent = F.sum(F.when(~keeps, F.least(F.col("ta") / 3, F.col("ta"))))
    return w.agg(F.count("*").alias("n"), F.count_if(keeps).alias("kept"), _mean(loss(F.col("n")), "first_loss"), _mean(loss(F.col("a")), "second_loss"), _mean(loss(F.when(keeps, F.col("n")).otherwise(F.col("a"))), "paired_loss"), F.round(F.coalesce(spent, F.lit(0.0)), 4).alias("tokens"))


@query("""SELECT props AS request, count(*) AS n, count(DISTINCT event_type) AS kinds, count(DISTINCT event_type) = 1 AS consistent, sha256(props) AS digest, regexp_full_match(props, '\\{"k": [0-9]+\\}') AS well_formed, min(event_id) AS first FROM events GROUP BY props""")
def stored_request_index(t: Tables) -> DataFrame:
    """CMP-43, CMP-44, CMP-46, DFL-09: stored requests with their digests and whether they agree."""
    kinds = F.count_distinct("event_type")
    return t.events.groupBy(F.col("props").alias("request")).agg(F.count("*").alias("n"), kinds.alias("kinds"), (kinds == 1).alias("consistent"), F.min("event_id").alias("first")).select(
        "*", F.sha2(F.col("request").cast("binary"), 256).alias("digest"), F.col("request").rlike(r'^\{"k": [0-9]+\}$').alias("well_formed")
    )


@query("""WITH a AS (SELECT user_id, count(*) FILTER (event_type = 'error' AND value < 20) AS failures, count(*) FILTER (event_type = 'purchase') AS done, count(*) FILTER (event_type = 'error' AND value >= 20) AS rejected FROM events GROUP BY 1)
SELECT CASE WHEN done > 0 THEN 'collected' WHEN failures >= 12 THEN 'dropped' WHEN failures > 0 THEN 'retry' ELSE 'submitted' END AS status, count(*) AS n, sum(rejected)::BIGINT AS rejected FROM a GROUP BY 1""")
def batch_states(t: Tables) -> DataFrame:
    """DFL-05, CMP-50, DFL-08: the state of each batch from its events; rejections aren't attempts."""
    of = lambda c, name: F.count_if(c).alias(name)
    kind, value = F.col("event_type"), F.col("value")
    a = t.events.groupBy("user_id").agg(of((kind == "error") & (value < 20), "failures"), of(kind == "purchase", "done"), of((kind == "error") & (value >= 20), "rejected"))
    status = F.when(F.col("done") > 0, "collected").when(F.col("failures") >= 12, "dropped").when(F.col("failures") > 0, "retry").otherwise("submitted")
    return a.groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.sum("rejected").alias("rejected"))


@query(f"""WITH {CALLS}, f AS (SELECT unnest(['short', 'long']) AS form, unnest([1, 2]) AS factor)
SELECT form, system, count(item) AS calls, round(coalesce(sum(tokens * factor), 0), 4) AS tokens, count(*) - count(item) AS missing FROM f CROSS JOIN (SELECT unnest(['A', 'N', 'R', 'Z']) AS system) LEFT JOIN calls USING (system) GROUP BY ALL""")
def forms_by_system(t: Tables) -> DataFrame:
    """DFL-11, CMP-40, CMP-55, PIV-06: calls of every form and system, systems without any included."""
    per = _calls(t).groupBy("system").agg(F.count("*").alias("calls"), F.sum("tokens").alias("sum"))
    spark = t.lineitem.sparkSession
    grid = spark.createDataFrame([(f, k, s) for f, k in (("short", 1), ("long", 2)) for s in [*SYSTEMS, "Z"]], "form string, factor int, system string")
    out = grid.join(F.broadcast(per), "system", "left")
    return out.select("form", "system", F.coalesce("calls", F.lit(0)).alias("calls"), F.round(F.coalesce(F.col("sum") * F.col("factor"), F.lit(0.0)), 4).alias("tokens"), F.col("calls").isNull().cast("long").alias("missing"))


@query("""WITH k AS (SELECT c_custkey, ('0x' || substr(md5(c_custkey::VARCHAR), 1, 12))::BIGINT AS h FROM customer), n AS (SELECT c_custkey, (row_number() OVER (ORDER BY h, c_custkey) - 1) // 50 AS block FROM k)
SELECT block::INT AS block, count(*) AS n, min(c_custkey) AS first FROM n GROUP BY 1""")
def seeded_blocks(t: Tables) -> DataFrame:
    """WIN-08, TOP-06, TOP-10: blocks of 50 in a seeded order."""
    h = F.conv(F.substring(F.md5(F.col("c_custkey").cast("string").cast("binary")), 1, 12), 16, 10).cast("long")
    placed = ranks.numbered(t.customer.select("c_custkey", h.alias("h")), "h", "c_custkey")
    return placed.groupBy(ranks.block_number(F.col("_nth"), 50).alias("block")).agg(F.count("*").alias("n"), F.min("c_custkey").alias("first"))


@query("""WITH g AS (SELECT c_nationkey, count(*)::DOUBLE AS n, sum((c_acctbal > 5000)::INT)::DOUBLE AS k FROM customer GROUP BY 1), o AS (SELECT *, (sum(k) OVER () - k) / (sum(n) OVER () - n) AS p FROM g)
SELECT c_nationkey, round(p, 9) AS p, round(-(k * ln(p) + (n - k) * ln(1 - p)) / n, 6) AS log_loss FROM o""")
def leave_group_out(t: Tables) -> DataFrame:
    """AGG-57: each group scored by what the other groups say, from totals less its own."""
    g = t.customer.groupBy("c_nationkey").agg(F.count("*").cast("double").alias("n"), F.sum((F.col("c_acctbal") > 5000).cast("double")).alias("k"))
    total = g.agg(F.sum("n").alias("tn"), F.sum("k").alias("tk"))
    p = (F.col("tk") - F.col("k")) / (F.col("tn") - F.col("n"))
    o = g.join(F.broadcast(total)).withColumn("p", p)
    loss = -(F.col("k") * F.ln("p") + (F.col("n") - F.col("k")) * F.ln(1 - F.col("p"))) / F.col("n")
    return o.select("c_nationkey", F.round("p", 9).alias("p"), F.round(loss, 6).alias("log_loss"))


@query("""WITH m AS (SELECT l_partkey, l_linestatus AS edit, avg(l_quantity) AS v FROM lineitem GROUP BY ALL), d AS (SELECT f.v - o.v AS d FROM m f JOIN m o USING (l_partkey) WHERE f.edit = 'F' AND o.edit = 'O')
SELECT count(*) AS n, round(avg(d), 6) AS mean, round(quantile_cont(d, 0.5), 6) AS median, round(quantile_cont(d, 0.25), 6) AS q1, round(quantile_cont(d, 0.75), 6) AS q3, round(quantile_cont(d, 0.05), 6) AS p05, round(quantile_cont(d, 0.95), 6) AS p95 FROM d""")
def reference_change(t: Tables) -> DataFrame:
    """CMP-10: the distribution of a reference's change under an edit."""
    side = lambda v: F.avg(F.when(F.col("l_linestatus") == v, F.col("l_quantity")))
    d = t.lineitem.groupBy("l_partkey").agg(side("F").alias("f"), side("O").alias("o")).where("f is not null and o is not null").select((F.col("f") - F.col("o")).alias("d"))
    p = ranks.percentiles(d, "d", (0.5, 0.25, 0.75, 0.05, 0.95)).join(F.broadcast(d.agg(_mean(F.col("d"), "mean"))))
    return p.select("n", "mean", *[F.round(F.col("p")[i], 6).alias(c) for i, c in enumerate(("median", "q1", "q3", "p05", "p95"))])


@query("""WITH a AS (SELECT o_custkey, o_orderkey, o_orderstatus, 1.0::DOUBLE AS w FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_custkey, o_orderkey, o_orderstatus, 0.25 FROM orders WHERE o_orderstatus = 'P')
SELECT o_custkey % 10 AS grp, round(sum(w), 4) AS weight, round(sum(w * (o_orderstatus = 'F')::INT) / sum(w), 6) AS share FROM a GROUP BY 1""")
def power_prior(t: Tables) -> DataFrame:
    """MDL-06, AGG-69: a weighted union of own and prior rows."""
    prior = F.col("o_orderstatus") == "P"
    own = t.orders.where(~prior).select("o_custkey", "o_orderstatus", F.lit(1.0).alias("w"))
    a = keys.stacked(own, t.orders.where(prior).select("o_custkey", "o_orderstatus", F.lit(0.25).alias("w")))
    hit = (F.col("o_orderstatus") == "F").cast("int")
    return a.groupBy((F.col("o_custkey") % 10).alias("grp")).agg(F.round(F.sum("w"), 4).alias("weight"), F.round(F.sum(F.col("w") * hit) / F.sum("w"), 6).alias("share"))


@query("""WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN ['a', 'b', 'c'] WHEN o_orderkey % 3 = 1 THEN ['c', 'a', 'b'] ELSE ['b', 'c', 'a'] END AS shown, (o_custkey % 3 + 1)::INT AS pick FROM orders)
SELECT o_orderkey, shown[pick] AS answer, list_position(['a', 'b', 'c'], shown[pick]) = pick AS in_place FROM v""")
def canonical_answers(t: Tables) -> DataFrame:
    """CMP-22, CMP-23, CMP-45: answers by place in a permuted list of options, told in the canonical one."""
    options = lambda *xs: F.array(*[F.lit(x) for x in xs])
    k = F.col("o_orderkey") % 3
    shown = F.when(k == 0, options("a", "b", "c")).when(k == 1, options("c", "a", "b")).otherwise(options("b", "c", "a"))
    v = t.orders.select("o_orderkey", shown.alias("shown"), (F.col("o_custkey") % 3 + 1).cast("int").alias("pick"))
    answer = F.element_at("shown", F.col("pick"))
    return v.select("o_orderkey", answer.alias("answer"), (F.array_position(options("a", "b", "c"), answer) == F.col("pick")).alias("in_place"))
