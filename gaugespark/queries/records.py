"""Queries of record states: cleaning, edits, rules, matches and cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugespark.functions import values
from gaugespark.operators import keys, ranks
from gaugespark.queries.base import Tables, query


@query("""SELECT c_custkey, CASE WHEN c_acctbal > 9000 THEN 9000.0 ELSE c_acctbal END AS capped, CASE c_nationkey WHEN 1 THEN 'yes' WHEN 0 THEN 'no' END AS flag,
CASE WHEN c_mktsegment = 'BUILDING' OR c_nationkey = 1 THEN 'yes' ELSE 'no' END AS any, round(CASE WHEN c_nationkey = 0 THEN c_acctbal ELSE (c_acctbal + c_nationkey) / 2 END, 6) AS mean FROM customer WHERE c_acctbal <> 0""")
def cleaned_values(t: Tables) -> DataFrame:
    """PRJ-03, PRJ-07, PRJ-10, PRJ-11, PRJ-46: readings, flags and top codes."""
    c = t.customer.where("c_acctbal <> 0")
    told = F.when(F.col("c_acctbal") > 9000, "> 9000").otherwise(F.col("c_acctbal").cast("string"))
    yes = lambda x: F.when(x, "yes").otherwise("no")
    return c.select(
        "c_custkey",
        values.top_coded(told, 9000.0).alias("capped"),
        values.tri_state(F.col("c_nationkey")).alias("flag"),
        values.any_of(yes(F.col("c_mktsegment") == "BUILDING"), yes(F.col("c_nationkey") == 1)).alias("any"),
        F.round(values.mean_of_present(F.col("c_acctbal"), F.col("c_nationkey")), 6).alias("mean"),
    )


@query("""SELECT l_linenumber, round(avg(ln(q / (1 - q))), 6) AS odds, round(avg(1 / (1 + exp(-ln(q / (1 - q))))), 6) AS back FROM (SELECT l_linenumber, least(greatest(l_discount * 10, 0.005), 0.995) AS q FROM lineitem) GROUP BY 1""")
def log_odds(t: Tables) -> DataFrame:
    """PRJ-30: clipped log-odds and back."""
    z = values.log_odds(F.col("l_discount") * 10)
    return t.lineitem.groupBy("l_linenumber").agg(F.round(F.avg(z), 6).alias("odds"), F.round(F.avg(values.from_log_odds(z)), 6).alias("back"))


@query("""SELECT half, count(*) AS n FROM (SELECT round_even(l_quantity / 2, 0) AS half FROM lineitem) GROUP BY 1""")
def half_even(t: Tables) -> DataFrame:
    """MTH-02: halves go to the even neighbour."""
    return t.lineitem.groupBy(F.bround(F.col("l_quantity") / 2, 0).alias("half")).agg(F.count("*").alias("n"))


@query("""SELECT l_linenumber, round(avg(1 - exp(-exp(-19.907 - 0.0336 * 42 + 0.0095 * 80 + 0.1953 * l_quantity / 5 + 0.0954 * ln(l_tax + 0.1) - 0.012 * 30 + 0.0268 * 90 + 0.3306 * 13 + 0.00188 * 70 + 0.0554 * 6 + 0.0804 * (40 + l_linenumber))
* (exp(120 * 0.0076927) - 1) / 0.0076927)), 6) AS risk FROM lineitem GROUP BY 1""")
def gompertz_risk(t: Tables) -> DataFrame:
    """PRJ-32, CMP-51: a published risk score as one expression."""
    fixed = {"albumin": 42.0, "creatinine": 80.0, "lymphocytes": 30.0, "mcv": 90.0, "rdw": 13.0, "alk_phos": 70.0, "wbc": 6.0}
    given = {k: F.lit(v) for k, v in fixed.items()} | {"glucose": F.col("l_quantity") / 5, "log_crp": F.ln(F.col("l_tax") + 0.1), "age": 40 + F.col("l_linenumber")}
    return t.lineitem.groupBy("l_linenumber").agg(F.round(F.avg(values.gompertz_risk(given)), 6).alias("risk"))


@query("""WITH e(edit, op, amount, most) AS (VALUES ('larger', 'add', 5.0::DOUBLE, 50.0::DOUBLE), ('double', 'multiply', 2.0, 60.0), ('fixed', 'set', 7.0, 100.0)),
a AS (SELECT p_partkey, p_size, edit, most, CASE op WHEN 'add' THEN p_size + amount WHEN 'multiply' THEN p_size * amount ELSE amount END AS v FROM part CROSS JOIN e)
SELECT p_partkey, edit, CASE WHEN v <= most AND v <> p_size THEN v END AS value, v <= most AND v <> p_size AS applicable, CASE WHEN v > most THEN 'over the maximum' WHEN v = p_size THEN 'no change' END AS reason FROM a""")
def record_edits(t: Tables) -> DataFrame:
    """PRJ-29, JON-14: one-field edits with guards, by explode of a short list."""
    edits = F.array(*[F.struct(F.lit(n).alias("edit"), F.lit(op).alias("op"), F.lit(a).alias("amount"), F.lit(m).alias("most")) for n, op, a, m in (("larger", "add", 5.0, 50.0), ("double", "multiply", 2.0, 60.0), ("fixed", "set", 7.0, 100.0))])
    long = t.part.select("p_partkey", "p_size", F.explode(edits).alias("e")).select("p_partkey", "p_size", "e.*")
    v = values.edited(F.col("p_size").cast("double"), F.col("op"), F.col("amount"))
    ok = (v <= F.col("most")) & (v != F.col("p_size"))
    reason = F.when(v > F.col("most"), "over the maximum").when(v == F.col("p_size"), "no change")
    return long.select("p_partkey", "edit", F.when(ok, v).alias("value"), ok.alias("applicable"), reason.alias("reason"))


@query("""WITH r(code, slope, shift) AS (VALUES ('A', 1.1::DOUBLE, 2.0::DOUBLE), ('R', 0.9, -1.0)) SELECT l_returnflag, round(sum(coalesce(slope, 1) * l_quantity + coalesce(shift, 0)), 4) AS corrected, round(sum(l_quantity * 2.54), 4) AS converted FROM lineitem LEFT JOIN r ON code = l_returnflag GROUP BY 1""")
def group_correction(t: Tables) -> DataFrame:
    """PRJ-04, PRJ-06, PRJ-23: corrections by group from a small table, and unit conversion."""
    rates = t.lineitem.sparkSession.createDataFrame([("A", 1.1, 2.0), ("R", 0.9, -1.0)], "l_returnflag string, slope double, shift double")
    rows = t.lineitem.select("l_returnflag", "l_quantity").join(F.broadcast(rates), "l_returnflag", "left")
    corrected = F.coalesce("slope", F.lit(1.0)) * F.col("l_quantity") + F.coalesce("shift", F.lit(0.0))
    return rows.groupBy("l_returnflag").agg(F.round(F.sum(corrected), 4).alias("corrected"), F.round(F.sum(F.col("l_quantity") * 2.54), 4).alias("converted"))


@query("""SELECT c_custkey, n_name || ' customer in ' || lower(c_mktsegment) || CASE WHEN c_acctbal < 0 THEN ', in debt' ELSE '' END || '.' AS prose, CASE WHEN c_acctbal > 8000 THEN 'very high' WHEN c_acctbal > 5000 THEN 'high' END AS note FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def prose_state(t: Tables) -> DataFrame:
    """PRJ-24, PRJ-25, PRJ-26, PRJ-28: a record in words, with a note where a cut is passed."""
    both = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    prose = F.concat("n_name", F.lit(" customer in "), F.lower("c_mktsegment"), F.when(F.col("c_acctbal") < 0, ", in debt").otherwise(""), F.lit("."))
    return both.select("c_custkey", prose.alias("prose"), F.when(F.col("c_acctbal") > 8000, "very high").when(F.col("c_acctbal") > 5000, "high").alias("note"))


@query("""SELECT o_orderkey, array_to_string(list_transform(list_sort(list_transform(['custkey', 'status', 'price', 'priority'], lambda f: md5(f || ':' || o_orderkey) || f)), lambda x: substr(x, 33)), ',') AS fields FROM orders""")
def shuffled_fields(t: Tables) -> DataFrame:
    """PRJ-22, WIN-09: a seeded order of fields for each record."""
    fields = F.array(*[F.lit(f) for f in ("custkey", "status", "price", "priority")])
    keyed = F.array_sort(F.transform(fields, lambda f: F.concat(F.md5(F.concat(f, F.lit(":"), F.col("o_orderkey").cast("string")).cast("binary")), f)))
    return t.orders.select("o_orderkey", F.array_join(F.transform(keyed, lambda x: F.substring(x, 33, 100)), ",").alias("fields"))


@query("""WITH r AS (SELECT a, b, CASE WHEN a = 3 THEN 'IV' WHEN a + b >= 3 THEN 'III' WHEN b > 0 THEN 'II' ELSE 'I' END AS stage FROM (SELECT unnest(range(4)) AS a) CROSS JOIN (SELECT unnest(range(2)) AS b))
SELECT stage, count(*) AS n FROM (SELECT l_linenumber % 4 AS a, l_quantity::INT % 3 AS b FROM lineitem) LEFT JOIN r USING (a, b) GROUP BY 1""")
def stage_table(t: Tables) -> DataFrame:
    """PRJ-39, PRJ-40, PRJ-42, PRJ-43, JON-15: a class looked up in a table expanded from rules."""
    spark = t.lineitem.sparkSession
    # the product of short lists of codes: eight rows, whatever the table
    codes = spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(3))).alias("a")).select("a", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("b"))
    stage = F.when(F.col("a") == 3, "IV").when(F.col("a") + F.col("b") >= 3, "III").when(F.col("b") > 0, "II").otherwise("I")
    rows = t.lineitem.select((F.col("l_linenumber") % 4).cast("int").alias("a"), (F.col("l_quantity").cast("int") % 3).alias("b"))
    return rows.join(F.broadcast(codes.withColumn("stage", stage)), ["a", "b"], "left").groupBy("stage").agg(F.count("*").alias("n"))


@query("""WITH r(cell, x, y, z) AS (VALUES ('low', 0, 0, 0), ('middle', 1, 1, 0), ('high', 2, 1, 1), ('top', 2, 2, 2)), k AS (SELECT DISTINCT l_linenumber % 3 AS a, l_quantity::INT % 3 AS b, l_partkey % 3 AS c FROM lineitem),
d AS (SELECT a, b, c, cell, (a <> x)::INT + (b <> y)::INT + (c <> z)::INT AS changed FROM k CROSS JOIN r), m AS (SELECT *, min(changed) OVER (PARTITION BY a, b, c) AS least FROM d)
SELECT a::INT AS a, b::INT AS b, c::INT AS c, least::INT AS changed, array_to_string(list_sort(list(cell)), ',') AS cells FROM m WHERE changed = least GROUP BY ALL""")
def nearest_rules(t: Tables) -> DataFrame:
    """JON-16, AGG-57: the rules with the fewest changed parts, ties kept; over distinct codes."""
    k = t.lineitem.select((F.col("l_linenumber") % 3).cast("int").alias("a"), (F.col("l_quantity").cast("int") % 3).alias("b"), (F.col("l_partkey") % 3).cast("int").alias("c")).distinct()
    rules = (("low", 0, 0, 0), ("middle", 1, 1, 0), ("high", 2, 1, 1), ("top", 2, 2, 2))
    changed = lambda x, y, z: (F.col("a") != x).cast("int") + (F.col("b") != y).cast("int") + (F.col("c") != z).cast("int")
    cells = k.withColumn("d", F.array(*[F.struct(changed(x, y, z).alias("n"), F.lit(cell).alias("cell")) for cell, x, y, z in rules]))
    least = F.array_min("d.n")
    return cells.select("a", "b", "c", least.alias("changed"), F.array_join(F.array_sort(F.filter("d", lambda s: s["n"] == least)["cell"]), ",").alias("cells"))


@query("""WITH p AS (SELECT a.o_orderkey AS id, b.o_orderkey AS other, (a.o_orderstatus <> b.o_orderstatus)::INT + (a.o_orderpriority <> b.o_orderpriority)::INT AS differences, b.o_orderdate AS d FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey)
SELECT id, other, differences FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY differences, d, other) = 1""")
def best_match(t: Tables) -> DataFrame:
    """JON-18: the match with the fewest differences, the earliest on ties.

    The candidates of a kind of order (customer, status, priority) are reduced
    to their first two before orders meet them, so a customer's orders are
    never paired with each other.
    """
    kind = ["o_custkey", "o_orderstatus", "o_orderpriority"]
    o = t.orders.select("o_orderkey", *kind, "o_orderdate")
    nth = F.row_number().over(Window.partitionBy(*kind).orderBy("o_orderdate", "o_orderkey"))
    firsts = o.withColumn("_k", nth).where("_k <= 2").groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_orderdate").alias("d"), F.col("o_orderkey").alias("other"), "o_orderstatus", "o_orderpriority")).alias("c"))
    met = o.join(firsts, "o_custkey")
    differences = lambda x: (x["o_orderstatus"] != F.col("o_orderstatus")).cast("int") + (x["o_orderpriority"] != F.col("o_orderpriority")).cast("int")
    ranked = F.transform(F.filter("c", lambda x: x["other"] != F.col("o_orderkey")), lambda x: F.struct(differences(x).alias("differences"), x["d"].alias("d"), x["other"].alias("other")))
    best = met.select(F.col("o_orderkey").alias("id"), F.array_min(ranked).alias("b")).where("b is not null")
    return best.select("id", "b.other", "b.differences")


@query("""WITH v AS (SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal >= 1000 THEN c_acctbal END AS x FROM customer), m AS (SELECT c_nationkey, quantile_cont(x, 0.5) AS median FROM v GROUP BY 1)
SELECT c_custkey, coalesce(x, median) AS filled FROM v JOIN m USING (c_nationkey)""")
def median_fallback(t: Tables) -> DataFrame:
    """JON-24: missing values get their group's median."""
    v = t.customer.select("c_custkey", "c_nationkey", F.when(F.col("c_acctbal") >= 1000, F.col("c_acctbal")).alias("x"))
    m = ranks.percentiles(v, "x", (0.5,), ["c_nationkey"]).select("c_nationkey", F.col("p")[0].alias("median"))
    return v.join(m, "c_nationkey", "left").select("c_custkey", F.coalesce("x", "median").alias("filled"))


#: The most kinds that a full grid may have.
MOST_KINDS = 10_000


@query("""WITH k AS (SELECT DISTINCT user_id, event_type FROM events), u AS (SELECT user_id, event_type FROM (SELECT DISTINCT user_id FROM k) CROSS JOIN (SELECT DISTINCT event_type FROM k))
SELECT user_id, event_type, 'missing' AS status FROM u ANTI JOIN k USING (user_id, event_type) UNION ALL SELECT user_id, event_type, 'present' FROM k""")
def candidate_fill(t: Tables) -> DataFrame:
    """JON-23, PIV-06, CMP-55: keys of the full grid that have no row, and those that have."""
    kinds = t.events.agg(F.array_sort(F.collect_set("event_type")).alias("every"))
    # the grid's second side is a list of kinds, broadcast; a table with more of them is refused
    kinds = kinds.select(F.when(F.size("every") <= MOST_KINDS, F.col("every")).otherwise(F.raise_error(F.lit(f"more than {MOST_KINDS} kinds")).cast("array<string>")).alias("every"))
    per = t.events.groupBy("user_id").agg(F.collect_set("event_type").alias("own")).join(F.broadcast(kinds))
    long = per.select("user_id", "own", F.explode("every").alias("event_type"))
    return long.select("user_id", "event_type", F.when(F.array_contains("own", F.col("event_type")), "present").otherwise("missing").alias("status"))


@query("""WITH m AS (SELECT l_returnflag AS system, l_linestatus AS grp, l_linenumber AS level, avg(l_quantity) AS v FROM lineitem GROUP BY ALL)
SELECT a.system, a.grp, count(*) AS pairs, count(*) FILTER (a.v > b.v) AS inverted FROM m a JOIN m b ON a.system = b.system AND a.grp = b.grp AND a.level < b.level GROUP BY ALL""")
def order_inversions(t: Tables) -> DataFrame:
    """JON-22: pairs of levels whose means stand the wrong way, from a few means a group."""
    m = t.lineitem.groupBy(F.col("l_returnflag").alias("system"), F.col("l_linestatus").alias("grp"), F.col("l_linenumber").alias("level")).agg(F.avg("l_quantity").alias("v"))
    a, b = m.alias("a"), m.alias("b")
    pairs = a.join(b, (F.col("a.system") == F.col("b.system")) & (F.col("a.grp") == F.col("b.grp")) & (F.col("a.level") < F.col("b.level")))
    return pairs.groupBy("a.system", "a.grp").agg(F.count("*").alias("pairs"), F.count_if(F.col("a.v") > F.col("b.v")).alias("inverted"))


@query("""WITH o AS (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price, CASE WHEN o_custkey % 3 > 0 THEN o_custkey END AS customer, o_orderpriority AS priority FROM orders)
SELECT 'price' AS field, round(avg((price IS NULL)::INT), 6) AS missing FROM o UNION ALL SELECT 'customer', round(avg((customer IS NULL)::INT), 6) FROM o UNION ALL SELECT 'priority', round(avg((priority IS NULL)::INT), 6) FROM o""")
def missing_shares(t: Tables) -> DataFrame:
    """CMP-42, AGG-05, AGG-68: the missing share of each field, in one pass."""
    o = t.orders.select(F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey")).alias("customer"), F.col("o_orderpriority").alias("priority"))
    cells = [F.struct(F.lit(c).alias("field"), F.round(F.avg(F.col(c).isNull().cast("int")), 6).alias("missing")) for c in o.columns]
    return o.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


@query("""SELECT c_custkey, (c_acctbal / 1000) * (c_nationkey = 3)::INT AS nation_by_balance, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END * (c_acctbal < 0)::INT AS segment_by_debt FROM customer""")
def design_terms(t: Tables) -> DataFrame:
    """PRJ-44, PRJ-45: interaction columns of a design."""
    flag = lambda c: c.cast("int")
    return t.customer.select("c_custkey", (F.col("c_acctbal") / 1000 * flag(F.col("c_nationkey") == 3)).alias("nation_by_balance"), (flag(F.col("c_mktsegment") == "BUILDING") * flag(F.col("c_acctbal") < 0)).alias("segment_by_debt"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, min(o_orderdate) OVER (PARTITION BY o_custkey) AS first, o_orderdate AS d, o_orderstatus = 'F' AS died FROM orders)
SELECT CASE WHEN died AND d < first + INTERVAL 365 DAY THEN 'early' WHEN died THEN 'event' WHEN d >= first + INTERVAL 1000 DAY THEN 'free' ELSE 'undetermined' END AS outcome, count(*) AS n FROM r GROUP BY 1""")
def horizon_outcome(t: Tables) -> DataFrame:
    """PRJ-19, FLT-03, FLT-05, CMP-47: outcomes at a horizon, undetermined ones apart."""
    first = t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first"))
    days = F.datediff("o_orderdate", "first")
    died = F.col("o_orderstatus") == "F"
    outcome = F.when(died & (days < 365), "early").when(died, "event").when(days >= 1000, "free").otherwise("undetermined")
    return t.orders.join(first, "o_custkey").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT quantile_cont(l_quantity, 0.005) AS low, quantile_cont(l_quantity, 0.995) AS high FROM lineitem WHERE l_returnflag = 'N')
SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_quantity * 1.1 BETWEEN low AND high) AS supported FROM lineitem CROSS JOIN r GROUP BY 1""")
def supported_range(t: Tables) -> DataFrame:
    """FLT-10, FLT-11: edited values within the fitting records' percentiles."""
    bounds = ranks.percentiles(t.lineitem.where("l_returnflag = 'N'"), "l_quantity", (0.005, 0.995)).select(F.col("p")[0].alias("low"), F.col("p")[1].alias("high"))
    inside = (F.col("l_quantity") * 1.1).between(F.col("low"), F.col("high"))
    return t.lineitem.select("l_returnflag", "l_quantity").join(F.broadcast(bounds)).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(inside).alias("supported"))


@query("""WITH a AS (SELECT o_orderpriority AS path, round(avg(o_totalprice), 6) AS v FROM orders GROUP BY 1), b AS (SELECT o_orderpriority AS path, round(avg(o_totalprice) + (o_orderpriority LIKE '1%')::INT, 6) AS v FROM orders WHERE o_orderpriority NOT LIKE '5%' GROUP BY 1)
SELECT path, CASE WHEN b.v IS NULL OR a.v IS NULL THEN 'absent' WHEN abs(a.v - b.v) > 1e-9 * greatest(1, abs(b.v)) THEN 'differs' ELSE 'equal' END AS status FROM a FULL JOIN b USING (path)""")
def reproduction_check(t: Tables) -> DataFrame:
    """BOOT-19, SET-05, JON-06: two result tables compared by path, with a tolerance."""
    mean = lambda df, more: df.groupBy(F.col("o_orderpriority").alias("path")).agg(F.round(F.avg("o_totalprice") + more, 6).alias("v"))
    a = mean(t.orders, F.lit(0))
    b = mean(t.orders.where(~F.col("o_orderpriority").startswith("5")), F.max(F.col("o_orderpriority").startswith("1").cast("int"))).withColumnRenamed("v", "w")
    status = F.when(F.col("v").isNull() | F.col("w").isNull(), "absent").when(F.abs(F.col("v") - F.col("w")) > 1e-9 * F.greatest(F.lit(1.0), F.abs("w")), "differs").otherwise("equal")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


@query("""SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, coalesce(sum(value) FILTER (event_type = 'purchase'), 0) AS spent FROM events GROUP BY 1""")
def wide_counts(t: Tables) -> DataFrame:
    """PIV-04, PIV-05: given levels as columns, absent ones 0."""
    of = lambda k: F.count_if(F.col("event_type") == k).alias(k)
    spent = F.coalesce(F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))), F.lit(0.0))
    return t.events.groupBy("user_id").agg(of("click"), of("view"), spent.alias("spent"))


@query("""SELECT s AS split, count(*) AS n, min(c_custkey) AS first FROM (SELECT c_custkey, CASE WHEN h < 0.2 THEN 'pilot' WHEN h < 0.5 THEN 'eval' ELSE 'fit' END AS s FROM (SELECT c_custkey, ('0x' || substr(md5(c_custkey::VARCHAR), 1, 8))::BIGINT / 4294967296.0 AS h FROM customer)) GROUP BY 1""")
def seeded_split(t: Tables) -> DataFrame:
    """TOP-08, TOP-09, CMP-48: split by hash, the same at every size."""
    h = F.conv(F.substring(F.md5(F.col("c_custkey").cast("string").cast("binary")), 1, 8), 16, 10).cast("long") / 4294967296.0
    split = F.when(h < 0.2, "pilot").when(h < 0.5, "eval").otherwise("fit")
    return t.customer.groupBy(split.alias("split")).agg(F.count("*").alias("n"), F.min("c_custkey").alias("first"))


@query("""WITH s AS (SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F') SELECT o_custkey, o_orderkey, o_totalprice FROM s QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) <= 2""")
def lowest_confidence(t: Tables) -> DataFrame:
    """TOP-05: the k lowest of each group (the limit is the feature)."""
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey"))
    return t.orders.where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey", "o_totalprice", k.alias("k")).where("k <= 2").drop("k")


@query("""SELECT lang AS grp, source AS member, count(*) AS n, round(avg(n_chars), 6) AS chars, count(*) FILTER (quality = 1) AS good FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL""")
def document_profile(t: Tables) -> DataFrame:
    """JON-01, AGG-59, CMP-36: documents by language and source with their labels."""
    rows = t.documents.select("doc_id", "lang", "source", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return rows.groupBy(F.col("lang").alias("grp"), F.col("source").alias("member")).agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("chars"), F.count_if(F.col("quality") == 1).alias("good"))


@query("""SELECT label, count(*) AS n, round(avg(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)))), 6) AS norm FROM embeddings GROUP BY 1""")
def vector_norms(t: Tables) -> DataFrame:
    """SRC-12, PIV-05: arrays of numbers reduced in place."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return t.embeddings.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(norm), 6).alias("norm"))


@query("""SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderpriority) AS kinds FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 480000) GROUP BY 1""")
def excluded_parents(t: Tables) -> DataFrame:
    """JON-08, FLT-16: parents with any failing row go whole."""
    per = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_distinct("o_orderpriority").alias("kinds"), F.max("o_totalprice").alias("most"))
    return per.where("most <= 480000").drop("most")


@query("""SELECT kind, count(*) AS n FROM (SELECT DISTINCT 'c' AS kind, c_nationkey FROM customer UNION ALL SELECT DISTINCT 's', s_nationkey FROM supplier) GROUP BY 1""")
def stacked_keys(t: Tables) -> DataFrame:
    """SET-01, SET-04: tables stacked and their distinct keys."""
    both = keys.stacked(t.customer.select(F.lit("c").alias("kind"), F.col("c_nationkey").alias("k")), t.supplier.select(F.lit("s").alias("kind"), F.col("s_nationkey").alias("k")))
    return both.distinct().groupBy("kind").agg(F.count("*").alias("n"))
