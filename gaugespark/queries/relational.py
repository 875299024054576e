"""Queries of scans, projections, filters, joins, sets and reshapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugespark.functions import texts, values
from gaugespark.operators import keys, ranks
from gaugespark.plans import calls
from gaugespark.queries.base import Tables, query


@query("""SELECT 0 AS position, 'all' AS step, count(*) AS n FROM orders
UNION ALL SELECT 1, 'priced', count(*) FILTER (o_totalprice BETWEEN 50000 AND 250000) FROM orders
UNION ALL SELECT 2, 'finished', count(*) FILTER (o_totalprice BETWEEN 50000 AND 250000 AND o_orderstatus <> 'O') FROM orders
UNION ALL SELECT 3, 'urgent', count(*) FILTER (o_totalprice BETWEEN 50000 AND 250000 AND o_orderstatus <> 'O' AND o_orderpriority LIKE '1%') FROM orders""")
def flow_counts(t: Tables) -> DataFrame:
    """SNK-10, FLT-01, FLT-02: how many rows each step leaves, in one pass."""
    steps = [("all", F.lit(True)), ("priced", F.col("o_totalprice").between(50000, 250000)), ("finished", F.col("o_orderstatus") != "O"), ("urgent", F.col("o_orderpriority").startswith("1"))]
    return keys.flow(t.orders, steps)


@query("""SELECT user_id, event_type, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""")
def dedupe_first(t: Tables) -> DataFrame:
    """TOP-02: the first row of each key."""
    return keys.keep_one(t.events, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("""SELECT user_id, event_type, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def dedupe_last(t: Tables) -> DataFrame:
    """TOP-02, WIN-13: the latest revision of each key."""
    return keys.keep_one(t.events, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("""WITH o AS (SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1)
SELECT o_custkey, o_orderkey, l_linenumber, l_quantity FROM o JOIN lineitem ON l_orderkey = o_orderkey
QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) = 1""")
def first_of_first(t: Tables) -> DataFrame:
    """FLT-04, WIN-03, JON-02: the first line of each customer's first order."""
    first = keys.keep_one(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    met = first.join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    return keys.keep_one(met, ["o_orderkey"], [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]).select("o_custkey", "o_orderkey", "l_linenumber", "l_quantity")


@query("""SELECT n_name, c_mktsegment, count(*) AS lines, round(sum(l_extendedprice), 2) AS price, count(DISTINCT o_orderkey) AS orders
FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
GROUP BY n_name, c_mktsegment""")
def multi_left_join(t: Tables) -> DataFrame:
    """JON-01, JON-03: a star of left joins, reduced before the small side comes in."""
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("p"))
    o = t.orders.select("o_orderkey", "o_custkey")
    c = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
    n = t.nation.select("n_nationkey", "n_name")
    star = lines.join(o, lines.l_orderkey == o.o_orderkey, "left").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return star.groupBy("n_name", "c_mktsegment").agg(F.sum("n").alias("lines"), F.round(F.sum("p"), 2).alias("price"), F.count_if(F.col("o_orderkey").isNotNull()).alias("orders"))


@query("""WITH m AS (SELECT l_partkey, l_returnflag, avg(l_quantity) AS q FROM lineitem GROUP BY ALL)
SELECT e.l_returnflag AS edit, count(*) AS pairs, round(avg(e.q - b.q), 6) AS contrast
FROM m e JOIN m b ON e.l_partkey = b.l_partkey AND b.l_returnflag = 'N' AND e.l_returnflag <> 'N' GROUP BY 1""")
def baseline_contrast(t: Tables) -> DataFrame:
    """JON-04, JON-05, AGG-25: edits against the baseline of the same record, by conditional aggregates."""
    flags = ["A", "R"]
    per = t.lineitem.groupBy("l_partkey").agg(*[F.avg(F.when(F.col("l_returnflag") == f, F.col("l_quantity"))).alias(f) for f in ["N", *flags]])
    long = per.where("N is not null").select("N", F.explode(F.array(*[F.struct(F.lit(f).alias("edit"), F.col(f).alias("q")) for f in flags])).alias("e")).where("e.q is not null")
    return long.groupBy("e.edit").agg(F.count("*").alias("pairs"), F.round(F.avg(F.col("e.q") - F.col("N")), 6).alias("contrast"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_exclude(t: Tables) -> DataFrame:
    """JON-08, SET-03."""
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def semi_subset(t: Tables) -> DataFrame:
    """JON-07, FLT-18."""
    return t.customer.join(t.orders.where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)")
def common_keys(t: Tables) -> DataFrame:
    """JON-09, SET-02: users with every kind of event."""
    kinds = t.events.agg(F.count_distinct("event_type").alias("k"))
    return t.events.groupBy("user_id").agg(F.count_distinct("event_type").alias("n")).join(F.broadcast(kinds), F.col("n") == F.col("k")).select("user_id")


@query("""SELECT r_name, s AS segment, count(c_custkey) AS n, coalesce(round(sum(c_acctbal), 2), 0) AS balance
FROM region CROSS JOIN (SELECT DISTINCT c_mktsegment AS s FROM customer) LEFT JOIN nation ON n_regionkey = r_regionkey
LEFT JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment = s GROUP BY ALL""")
def align_grid(t: Tables) -> DataFrame:
    """JON-10, AGG-67, PIV-06: counts over the full grid of regions and segments."""
    grid = t.region.select("r_regionkey", "r_name").join(t.customer.select(F.col("c_mktsegment").alias("segment")).distinct())
    cells = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("r_regionkey"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    return keys.aligned(grid, cells, ["r_regionkey", "segment"], {"n": 0, "balance": 0.0}).drop("r_regionkey")


@query("""SELECT band, count(*) AS n FROM (SELECT CASE WHEN c_acctbal < 0 THEN 'negative' WHEN c_acctbal < 1000 THEN 'low' WHEN c_acctbal < 5000 THEN 'middle' ELSE 'high' END AS band FROM customer) GROUP BY 1""")
def band_ladder(t: Tables) -> DataFrame:
    """PRJ-05, PRJ-13: ordered bands, lower bound inside."""
    return t.customer.groupBy(values.ladder(F.col("c_acctbal"), [(0, "negative"), (1000, "low"), (5000, "middle")], "high").alias("band")).agg(F.count("*").alias("n"))


@query("""SELECT p_brand, band, count(*) AS n FROM (SELECT p_brand, CASE WHEN p_brand = 'Brand#11' THEN CASE WHEN p_size < 10 THEN 'small' ELSE 'large' END
WHEN p_brand = 'Brand#12' THEN CASE WHEN p_size < 25 THEN 'small' ELSE 'large' END END AS band FROM part) GROUP BY ALL""")
def band_by_group(t: Tables) -> DataFrame:
    """PRJ-14: a ladder for each group, null for other groups."""
    by = {b: values.ladder(F.col("p_size"), [(k, "small")], "large") for b, k in (("Brand#11", 10), ("Brand#12", 25))}
    return t.part.groupBy("p_brand", values.ladder_by(F.col("p_brand"), by).alias("band")).agg(F.count("*").alias("n"))


@query("""SELECT bin, count(*) AS n, min(p_retailprice) AS low, max(p_retailprice) AS high FROM (SELECT p_retailprice,
CASE WHEN p_retailprice <= 1000 THEN '(0,1000]' WHEN p_retailprice <= 1500 THEN '(1000,1500]' ELSE 'over' END AS bin FROM part) GROUP BY 1""")
def cut_right_closed(t: Tables) -> DataFrame:
    """PRJ-12: bins closed on the right."""
    bin_ = values.ladder(F.col("p_retailprice"), [(1000, "(0,1000]"), (1500, "(1000,1500]")], "over", inclusive=True)
    return t.part.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"))


@query("""SELECT CASE WHEN l_discount < 0.02 THEN 0 WHEN l_discount < 0.05 THEN 1 ELSE 2 END AS risk, count(*) AS n FROM lineitem GROUP BY 1""")
def risk_category(t: Tables) -> DataFrame:
    """PRJ-33: categories by cut points, a value at a cut in the upper one."""
    return t.lineitem.groupBy(F.when(F.col("l_discount") < 0.02, 0).when(F.col("l_discount") < 0.05, 1).otherwise(2).alias("risk")).agg(F.count("*").alias("n"))


@query("""SELECT category, count(*) AS n FROM (SELECT CASE WHEN l_quantity >= 45 OR l_discount >= 0.09 THEN 'very high' WHEN l_quantity >= 30 OR l_discount >= 0.06 THEN 'high' ELSE 'normal' END AS category FROM lineitem) GROUP BY 1""")
def two_input_category(t: Tables) -> DataFrame:
    """PRJ-15: the highest category that either reading reaches."""
    c = values.highest_of(F.col("l_quantity"), F.col("l_discount"), [(45, 0.09, "very high"), (30, 0.06, "high")], "normal")
    return t.lineitem.groupBy(c.alias("category")).agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(142 * pow(least(c / k, 1), a) * pow(greatest(c / k, 1), -1.2) * pow(0.9938, age) * f, 6) AS egfr
FROM (SELECT *, l_quantity / 20 AS c, 20 + l_linenumber * 8 AS age, CASE WHEN l_returnflag = 'N' THEN 0.7 ELSE 0.9 END AS k,
CASE WHEN l_returnflag = 'N' THEN -0.241 ELSE -0.302 END AS a, CASE WHEN l_returnflag = 'N' THEN 1.012 ELSE 1.0 END AS f FROM lineitem)""")
def nonlinear_value(t: Tables) -> DataFrame:
    """PRJ-16: a published nonlinear formula as one expression."""
    sex = F.when(F.col("l_returnflag") == "N", "female").otherwise("male")
    v = values.filtration_rate(F.col("l_quantity") / 20, 20 + F.col("l_linenumber") * 8, sex)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(v, 6).alias("egfr"))


@query("""SELECT p_partkey, p_size, p_retailprice FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b
WHERE b.p_retailprice <= a.p_retailprice AND b.p_size <= a.p_size AND (b.p_retailprice < a.p_retailprice OR b.p_size < a.p_size))""")
def dominance_frontier(t: Tables) -> DataFrame:
    """JON-21, HYB-13: the cost frontier, by a running minimum."""
    return keys.on_frontier(t.part.select("p_partkey", "p_size", "p_retailprice"), "p_partkey", "p_retailprice", "p_size")


@query("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p FROM orders GROUP BY 1""")
def crosstab(t: Tables) -> DataFrame:
    """PIV-03, PIV-04, AGG-10: counts over the full grid of levels."""
    return keys.crosstab(t.orders, "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("""SELECT l_orderkey, first(l_quantity ORDER BY l_partkey, l_suppkey) FILTER (l_linenumber = 1) AS line_1, first(l_quantity ORDER BY l_partkey, l_suppkey) FILTER (l_linenumber = 2) AS line_2 FROM lineitem GROUP BY 1""")
def pivot_first(t: Tables) -> DataFrame:
    """PIV-01, PIV-02: values of given levels as columns."""
    pick = lambda k: F.min(F.when(F.col("l_linenumber") == k, F.struct("l_partkey", "l_suppkey", "l_quantity")))["l_quantity"].alias(f"line_{k}")
    return t.lineitem.groupBy("l_orderkey").agg(pick(1), pick(2))


@query("""SELECT o_custkey, count(*) AS orders, array_to_string(list_sort(list(DISTINCT o_orderpriority)), '; ') AS priorities, count(DISTINCT o_orderstatus) AS statuses FROM orders GROUP BY 1""")
def distinct_listed(t: Tables) -> DataFrame:
    """AGG-02, AGG-61: distinct counts and sorted distinct texts."""
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "; ").alias("priorities"), F.count_distinct("o_orderstatus").alias("statuses"))


@query("""SELECT o_orderpriority, round(avg((o_totalprice > 100000)::INT), 6) AS dear, max(o_totalprice) AS most, min(o_totalprice) AS least, round(avg((o_orderstatus IS NOT NULL)::INT), 6) AS known FROM orders GROUP BY 1""")
def grouped_shares(t: Tables) -> DataFrame:
    """AGG-01, AGG-03, AGG-04, AGG-05, AGG-09."""
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return t.orders.groupBy("o_orderpriority").agg(share(F.col("o_totalprice") > 100000).alias("dear"), F.max("o_totalprice").alias("most"), F.min("o_totalprice").alias("least"), share(F.col("o_orderstatus").isNotNull()).alias("known"))


@query("""SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, round(quantile_cont(value, 0.9), 6) AS p90, count(*) AS n FROM events GROUP BY 1""")
def quartiles(t: Tables) -> DataFrame:
    """AGG-06, AGG-49: exact linear quantiles."""
    per = ranks.percentiles(t.events, "value", (0.25, 0.5, 0.75, 0.9), ["event_type"])
    return per.select("event_type", *[F.round(F.col("p")[i], 6).alias(c) for i, c in enumerate(("q1", "median", "q3", "p90"))], "n")


@query("""SELECT lang, quantile_cont(n_chars, 0.5) AS p50, quantile_cont(n_chars, 0.9) AS p90, count(*) FILTER (n_chars >= 8192) AS capped FROM documents GROUP BY 1""")
def output_cap(t: Tables) -> DataFrame:
    """AGG-47: shares at a cap and length percentiles."""
    capped = t.documents.groupBy("lang").agg(F.count_if(F.col("n_chars") >= 8192).alias("capped"))
    p = ranks.percentiles(t.documents, "n_chars", (0.5, 0.9), ["lang"]).select("lang", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p90"))
    return p.join(capped, "lang")


@query("""WITH c AS (SELECT l_orderkey, l_returnflag, l_linestatus, l_quantity AS tokens, CASE l_returnflag WHEN 'A' THEN 2.0 WHEN 'N' THEN 1.0 ELSE 4.0 END AS price FROM lineitem)
SELECT l_returnflag AS system, l_linestatus AS route, count(*) AS answers, round(sum(tokens * price * CASE WHEN l_linestatus = 'F' THEN 0.5 ELSE 1.0 END), 4) AS billed, round(sum(tokens * price), 4) AS listed,
round(1000 * sum(tokens * price) / count(*), 4) AS per_1000 FROM c GROUP BY ALL""")
def cost_by_route(t: Tables) -> DataFrame:
    """PRJ-36, AGG-48: billed and list cost by system and route; prices are a small joined table."""
    prices = t.lineitem.sparkSession.createDataFrame([("A", 2.0), ("N", 1.0), ("R", 4.0)], "system string, price double")
    rows = t.lineitem.select(F.col("l_returnflag").alias("system"), F.col("l_linestatus").alias("route"), "l_quantity").join(F.broadcast(prices), "system")
    listed = F.col("l_quantity") * F.col("price")
    billed = listed * F.when(F.col("route") == "F", 0.5).otherwise(1.0)
    return rows.groupBy("system", "route").agg(F.count("*").alias("answers"), F.round(F.sum(billed), 4).alias("billed"), F.round(F.sum(listed), 4).alias("listed"), F.round(1000 * F.sum(listed) / F.count("*"), 4).alias("per_1000"))


@query("""SELECT r_name, s.system, r.repeat FROM region CROSS JOIN (SELECT unnest(['a', 'b', 'c']) AS system) s CROSS JOIN (SELECT unnest(range(0, 3)) AS repeat) r WHERE r.repeat = 0 OR r_regionkey < 2""")
def plan_expand(t: Tables) -> DataFrame:
    """DFL-01, JON-14: calls for items, systems and repeats, by explode."""
    return calls.expanded(t.region, ["a", "b", "c"], 3, F.col("r_regionkey") < 2).select("r_name", "system", F.col("repeat").cast("long").alias("repeat"))


@query("""SELECT o_custkey, o_orderkey, round(spent, 2) AS spent FROM (SELECT *, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS spent FROM orders) WHERE spent <= 400000""")
def running_budget(t: Tables) -> DataFrame:
    """DFL-06: what a budget pays for, in order."""
    return calls.within_budget(t.orders, "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")], "o_totalprice", 400000).select("o_custkey", "o_orderkey", F.round("spent", 2).alias("spent"))


@query("""SELECT props, event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY props ORDER BY ts, event_id) = 1""")
def first_write_wins(t: Tables) -> DataFrame:
    """SNK-07, SNK-08, SNK-12: the first record of a key stays."""
    return calls.first_written(t.events, "props", [F.col("ts"), F.col("event_id")]).select("props", "event_id", "user_id")


@query("""SELECT substr(sha256(props), 1, 24) AS request_key, count(*) AS n FROM events GROUP BY 1""")
def request_hash(t: Tables) -> DataFrame:
    """STR-19, STR-20, SRC-11: content addressed keys."""
    return t.events.groupBy(texts.request_key(F.col("props")).alias("request_key")).agg(F.count("*").alias("n"))


@query("""SELECT user_id, count(*) AS n FROM events WHERE props NOT IN (SELECT props FROM events WHERE event_type = 'click') GROUP BY 1""")
def pending_calls(t: Tables) -> DataFrame:
    """JON-17, DFL: calls without a stored answer."""
    return calls.pending(t.events, t.events.where("event_type = 'click'"), "props").groupBy("user_id").agg(F.count("*").alias("n"))


@query("""SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING bool_and(o_orderstatus <> 'P')) GROUP BY 1""")
def complete_blocks(t: Tables) -> DataFrame:
    """FLT-15: blocks in which all is done."""
    return calls.complete_blocks(t.orders, "o_custkey", F.col("o_orderstatus") != "P").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("""SELECT 'customer' AS kind, c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer WHERE c_nationkey <> 3
UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier WHERE s_nationkey = 3""")
def substitute_union(t: Tables) -> DataFrame:
    """JON-19, SET-01: one group's rows replaced by another table's."""
    c = t.customer.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("nation"))
    s = t.supplier.where("s_nationkey = 3").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), F.lit("3").alias("nation"))
    return keys.substituted(c, "nation", "3", s).drop("nation")


@query("""SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000""")
def set_intersect(t: Tables) -> DataFrame:
    """SET-02, SET-04."""
    return t.customer.select(F.col("c_nationkey").alias("nation")).intersect(t.supplier.where("s_acctbal > 5000").select("s_nationkey"))


@query("""SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def duplicate_keys(t: Tables) -> DataFrame:
    """SET-06, SRC-08, JON-06: keys that should be unique and aren't."""
    return keys.failing_keys(t.lineitem, ["l_orderkey", "l_partkey"])


@query("""SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY 1""")
def domain_check(t: Tables) -> DataFrame:
    """FLT-07, FLT-13: values outside a declared domain."""
    return keys.outside_domain(t.events, "event_type", ["click", "view"])


@query("""SELECT c_mktsegment, round(avg(v), 6) AS mean, count(v) AS n FROM (SELECT c_mktsegment, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS v FROM customer) GROUP BY 1""")
def sentinel_to_null(t: Tables) -> DataFrame:
    """PRJ-08: values under zero are missing."""
    v = values.missing_if_negative(F.col("c_acctbal"))
    return t.customer.groupBy("c_mktsegment").agg(F.round(F.avg(v), 6).alias("mean"), F.count(v).alias("n"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' END AS meaning FROM lineitem""")
def code_map(t: Tables) -> DataFrame:
    """PRJ-02, PRJ-38: labels of codes, null for others."""
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", values.coded(F.col("l_returnflag"), {"A": "accepted", "R": "returned"}).alias("meaning"))


@query("""SELECT grp, count(*) AS n, round(avg(c_acctbal), 6) AS mean FROM (SELECT c_acctbal, unnest(['all', 'nation ' || c_nationkey, c_mktsegment, CASE WHEN c_acctbal < 0 THEN 'debt' END]) AS grp FROM customer) WHERE grp IS NOT NULL GROUP BY 1 HAVING count(*) >= 10""")
def group_multi_membership(t: Tables) -> DataFrame:
    """AGG-63, AGG-59, FLT-16: a row counts in each of its groups; small groups are left out."""
    groups = F.array(F.lit("all"), F.concat(F.lit("nation "), F.col("c_nationkey")), F.col("c_mktsegment"), F.when(F.col("c_acctbal") < 0, "debt"))
    return t.customer.select("c_acctbal", F.explode(groups).alias("grp")).where("grp is not null").groupBy("grp").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 6).alias("mean")).where("n >= 10")


@query("""SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 3""")
def top_counts(t: Tables) -> DataFrame:
    """AGG-50, TOP-01: the commonest values, ties by name."""
    return t.events.groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(3)


@query("""SELECT c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY md5(c_custkey::VARCHAR), c_custkey) <= 5""")
def stratified_sample(t: Tables) -> DataFrame:
    """TOP-06, TOP-08, TOP-09, TOP-10: a seeded sample of each stratum, by hash order (the sample is the feature)."""
    order = Window.partitionBy("c_nationkey").orderBy(F.md5(F.col("c_custkey").cast("string").cast("binary")), "c_custkey")
    return t.customer.select("c_nationkey", "c_custkey", F.row_number().over(order).alias("k")).where("k <= 5").drop("k")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())""")
def grouping_totals(t: Tables) -> DataFrame:
    """AGG-35, AGG-55, AGG-59: groups and totals in one aggregation."""
    return t.lineitem.groupingSets([["l_returnflag"], ["l_linestatus"], []], "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("""WITH v AS (SELECT c_custkey, c_name, n_name, c_acctbal, (round(c_acctbal * 100)::BIGINT - (round(c_acctbal * 100)::BIGINT % 10 + 10) % 10) // 10 AS q, (round(c_acctbal * 100)::BIGINT % 10 + 10) % 10 AS r FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT c_custkey, '{"name":"' || c_name || '","nation":"' || n_name || '","balance":{"value":' || ((q + CASE WHEN r > 5 OR (r = 5 AND q % 2 <> 0) THEN 1 ELSE 0 END) / 10.0::DOUBLE)::VARCHAR || ',"unit":"USD"}' || CASE WHEN c_acctbal < 0 THEN ',"in_debt":"yes"' ELSE '' END || '}' AS state FROM v""")
def nested_state_json(t: Tables) -> DataFrame:
    """PRJ-20, PRJ-21: a record as nested JSON in a fixed order, nulls left out."""
    both = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    state = F.struct(F.col("c_name").alias("name"), F.col("n_name").alias("nation"), F.struct(F.bround("c_acctbal", 1).alias("value"), F.lit("USD").alias("unit")).alias("balance"), F.when(F.col("c_acctbal") < 0, "yes").alias("in_debt"))
    return both.select("c_custkey", F.to_json(state).alias("state"))
