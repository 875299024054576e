"""Queries of replies, labels, texts and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugespark.functions import texts, values
from gaugespark.operators import staging
from gaugespark.queries.base import Tables, query

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_linenumber % 6 <> 5 THEN l_discount END AS p,
CASE l_linenumber % 6 WHEN 0 THEN 'json' WHEN 1 THEN 'bare' WHEN 2 THEN 'named' WHEN 3 THEN 'percent' WHEN 4 THEN 'json' ELSE 'none' END AS how FROM lineitem""")
def stated_probabilities(t: Tables) -> DataFrame:
    """STR-01, STR-03, MTH-03: probabilities from replies of several forms; booleans are none."""
    p, kind = F.col("l_discount").cast("string"), F.col("l_linenumber") % 6
    percent = F.concat(F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit(" %"))
    reply = F.when(kind == 0, F.format_string('{"p": %s}', p)).when(kind == 1, p).when(kind == 2, F.concat(F.lit("p: "), p)).when(kind == 3, percent).when(kind == 4, F.format_string('```json\n{"p": %s}\n```', p)).otherwise(F.lit('{"p": true}'))
    found, how = texts.stated_probability(reply)
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", found.alias("p"), how.alias("how"))


@query("""WITH r AS (SELECT l_linenumber, l_discount * 5 AS low, 0.5::DOUBLE AS high FROM lineitem),
s AS (SELECT *, CASE WHEN l_linenumber % 4 = 3 THEN 'unknown label' WHEN NOT (low + high BETWEEN 0.9 AND 1.1) THEN 'sum' ELSE 'ok' END AS status FROM r)
SELECT status, count(*) AS n, round(avg(CASE WHEN status = 'ok' THEN low / (low + high) END), 6) AS low, round(avg(CASE WHEN status = 'ok' THEN greatest(low, high) / (low + high) END), 6) AS top FROM s GROUP BY 1""")
def probability_lists(t: Tables) -> DataFrame:
    """STR-06, STR-10, STR-11: lists of label probabilities, checked and made to sum to 1."""
    odd = F.when(F.col("l_linenumber") % 4 == 3, ', "odd": 0.1').otherwise("")
    reply = F.concat(F.lit('{"low": '), (F.col("l_discount") * 5).cast("string"), F.lit(', "high": 0.5'), odd, F.lit("}"))
    rows = t.lineitem.select(texts.probability_list(reply, ["low", "middle", "high"]).alias("r")).select("r.p", "r.status")
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg(F.col("p")[0]), 6).alias("low"), F.round(F.avg(F.array_max("p")), 6).alias("top"))


@query("""SELECT event_id, json_extract_string(props, '$.k')::DOUBLE AS last, props AS object FROM events""")
def last_object(t: Tables) -> DataFrame:
    """STR-02, STR-07: the last JSON object of a reply and its number."""
    reply = F.concat(F.lit('First {"k": 0} or '), F.col("props"), F.lit(", so be it"))
    return t.events.select("event_id", texts.last_number_of(reply, "k").alias("last"), texts.embedded_object(reply).alias("object"))


@query("""SELECT o_orderpriority AS label, o_orderkey % 4 AS form, count(*) AS n, count(*) FILTER (o_orderkey % 4 <> 3) AS matched FROM orders GROUP BY ALL""")
def matched_labels(t: Tables) -> DataFrame:
    """STR-04, STR-05, STR-08: labels as given, in other case, in brackets; others unmatched."""
    c, form = F.col("o_orderpriority"), F.col("o_orderkey") % 4
    reply = F.when(form == 0, c).when(form == 1, F.lower(c)).when(form == 2, F.concat(F.lit("["), c, F.lit("]."))).otherwise(F.concat(c, F.lit(" or so")))
    found = texts.matched_label(reply, PRIORITIES)
    return t.orders.groupBy(c.alias("label"), form.alias("form")).agg(F.count("*").alias("n"), F.count_if(F.coalesce(found == c, F.lit(False))).alias("matched"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g'))) AS spaced, len(regexp_extract_all(lower(text), '[a-z0-9]+'))::INT AS words, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')))::INT AS kinds FROM documents""")
def text_words(t: Tables) -> DataFrame:
    """STR-16, STR-17, STR-26: white space normalised, words counted."""
    w = texts.words(F.col("text"))
    return t.documents.select("doc_id", F.md5(texts.one_spaced(F.col("text")).cast("binary")).alias("spaced"), F.size(w).alias("words"), F.size(F.array_distinct(w)).alias("kinds"))


@query(r"""WITH s AS (SELECT conv_id, turn, list_filter(string_split(regexp_replace(text, '([.!?])[ \t\n\x0b\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: length(trim(x)) > 0) AS s FROM conversations)
SELECT conv_id, turn, len(s)::INT AS sentences, coalesce(length(s[1]), 0)::INT AS first_length FROM s""")
def sentence_split(t: Tables) -> DataFrame:
    """STR-12: sentences of each turn."""
    s = t.conversations.select("conv_id", "turn", texts.sentences(F.col("text")).alias("s"))
    return s.select("conv_id", "turn", F.size("s").alias("sentences"), F.coalesce(F.length(F.get("s", F.lit(0))), F.lit(0)).alias("first_length"))


@query(r"""WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM conversations),
r AS (SELECT conv_id, turn, CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) ELSE [] END AS r FROM w)
SELECT a.conv_id, a.turn, len(list_distinct(a.r))::INT AS runs, len(list_intersect(a.r, b.r))::INT AS shared FROM r a JOIN r b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1""")
def shared_runs(t: Tables) -> DataFrame:
    """AGG-62: word runs that a turn shares with the turn before it."""
    # texts are dealt out, and made into runs after they have met: runs are some times as large, and few bytes of text are many runs
    tasks = int(t.conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = t.conversations.select("conv_id", "turn", F.col("text").alias("a"))
    both = a.join(t.conversations.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("b")), ["conv_id", "turn"])
    runs = lambda c: F.array_distinct(texts.word_runs(texts.words(F.col(c)), 3))
    r = both.repartition(tasks, F.xxhash64("conv_id", "turn", "a")).select("conv_id", "turn", runs("a").alias("r"), texts.word_runs(texts.words(F.col("b")), 3).alias("b"))
    return r.select("conv_id", "turn", F.size("r").alias("runs"), F.size(F.array_intersect("r", "b")).alias("shared"))


@query(r"""SELECT lang, CASE WHEN regexp_matches(text, '(?i)licen[cs]e') THEN 'license' WHEN regexp_matches(text, '[0-9]{3}') THEN 'numbers' WHEN contains(text, '?') THEN 'question' ELSE 'prose' END AS kind, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY ALL""")
def first_patterns(t: Tables) -> DataFrame:
    """STR-15, FLT-12: the first of several patterns that a text holds."""
    kind = texts.first_pattern(F.col("text"), [("license", "(?i)licen[cs]e"), ("numbers", "[0-9]{3}"), ("question", r"\?")], "prose")
    return t.documents.where("text is not null").groupBy("lang", kind.alias("kind")).agg(F.count("*").alias("n"))


@query("""SELECT DISTINCT (l_quantity * 13 - 300)::INT AS minutes, printf('%s%d h %02d min', CASE WHEN l_quantity * 13 < 300 THEN '-' ELSE '+' END, abs((l_quantity * 13 - 300)::INT) // 60, abs((l_quantity * 13 - 300)::INT) % 60) AS clock FROM lineitem""")
def clock_texts(t: Tables) -> DataFrame:
    """STR-18: offsets as text."""
    m = t.lineitem.select((F.col("l_quantity") * 13 - 300).cast("int").alias("minutes")).distinct()
    return m.select("minutes", texts.clock(F.col("minutes")).alias("clock"))


@query("""SELECT split_part(o_orderpriority, '-', 1) AS system, split_part(o_orderpriority, '-', 2) AS effort, count(*) AS n FROM orders GROUP BY ALL""")
def system_effort(t: Tables) -> DataFrame:
    """STR-27: the two parts of a name."""
    part = lambda k: F.split_part(F.col("o_orderpriority"), F.lit("-"), F.lit(k))
    return t.orders.groupBy(part(1).alias("system"), part(2).alias("effort")).agg(F.count("*").alias("n"))


@query(r"""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '.*/([^/?#]+)', 1) AS leaf, len(regexp_extract_all(url, '[?&][a-z]+='))::INT AS arguments FROM pages WHERE url IS NOT NULL""")
def path_parts(t: Tables) -> DataFrame:
    """STR-28: parts of paths."""
    u = F.col("url")
    return t.pages.where("url is not null").select("page_id", F.regexp_extract(u, "^[a-z]+://([^/?#]*)", 1).alias("host"), F.regexp_extract(u, ".*/([^/?#]+)", 1).alias("leaf"), F.regexp_count(u, F.lit("[?&][a-z]+=")).alias("arguments"))


@query("""SELECT conv_id, turn, replace('Item {n}: {text}', '{text}', text) AS filled, ((length(text) - length(replace(text, 'the', ''))) / 3)::INT AS times FROM conversations""")
def template_fill(t: Tables) -> DataFrame:
    """STR-24, STR-25, PRJ-27: filled templates and counted parts."""
    return t.conversations.select("conv_id", "turn", F.replace(F.lit("Item {n}: {text}"), F.lit("{text}"), F.col("text")).alias("filled"), texts.occurrences(F.col("text"), "the").alias("times"))


@query("""SELECT '$.k' AS path, json_extract_string(props, '$.k') AS value, count(*) AS n FROM events GROUP BY ALL""")
def json_leaves(t: Tables) -> DataFrame:
    """SET-05: paths and values of flat JSON objects."""
    leaves = t.events.select(F.explode(F.from_json("props", "map<string,string>")).alias("path", "value"))
    return leaves.groupBy(F.concat(F.lit("$."), F.col("path")).alias("path"), "value").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, list_filter(range(1, greatest(length(p_name), length(p_type), 1) + 1), lambda i: substr(p_name, i, 1) <> substr(p_type, i, 1))[1]::INT AS place FROM part""")
def first_difference(t: Tables) -> DataFrame:
    """STR-21: where two texts part."""
    return t.part.select("p_partkey", texts.first_difference(F.col("p_name"), F.col("p_type")).alias("place"))


@query("""SELECT problems, count(*) AS n FROM (SELECT array_to_string(list_filter([CASE WHEN NOT o_totalprice > 1000 THEN 'price' END, CASE WHEN o_orderstatus = 'P' THEN 'pending' END, CASE WHEN o_orderpriority LIKE '5%' THEN 'priority' END], lambda x: x IS NOT NULL), '; ') AS problems FROM orders) GROUP BY 1""")
def request_problems(t: Tables) -> DataFrame:
    """DFL-10: what is wrong with each request, as a list."""
    found = texts.problems((F.col("o_totalprice") > 1000, "price"), (F.col("o_orderstatus") != "P", "pending"), (~F.col("o_orderpriority").startswith("5"), "priority"))
    return t.orders.groupBy(F.array_join(found, "; ").alias("problems")).agg(F.count("*").alias("n"))


@query("""SELECT role, sum(greatest(1, length(text) // 4))::BIGINT AS tokens, count(*) AS n FROM conversations WHERE text IS NOT NULL GROUP BY 1""")
def token_estimate(t: Tables) -> DataFrame:
    """PRJ-37, DFL-07: estimated tokens by role."""
    return t.conversations.where("text is not null").groupBy("role").agg(F.sum(values.tokens_estimated(F.col("text"))).alias("tokens"), F.count("*").alias("n"))


@query("""WITH e AS (SELECT event_id, user_id, epoch_us(ts) // 60000000 - epoch_us(TIMESTAMP '2024-01-01') // 60000000 AS m, value::DECIMAL(10,2) AS v FROM events)
SELECT user_id, m::INT AS minute, v AS value, count(*) AS n FROM e GROUP BY ALL""")
def timeline_reparsed(t: Tables) -> DataFrame:
    """CMP-21, CMP-49: a timeline written as text and read back from it.

    A user's entries of a thousand consecutive events are one text, so that no
    text grows with the table.
    """
    minute = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) * 1440 + F.hour("ts") * 60 + F.minute("ts")
    e = t.events.select("user_id", F.floor(F.col("event_id") / 1000).alias("part"), minute.alias("m"), F.col("value").cast("decimal(10,2)").alias("v"))
    entry = F.format_string("+%d:%02d %s", F.floor(F.col("m") / 60).cast("int"), F.col("m") % 60, F.col("v").cast("string"))
    told = e.groupBy("user_id", "part").agg(F.array_join(F.collect_list(entry), "; ").alias("record"))
    read = told.select("user_id", F.explode(texts.parsed_timeline(F.col("record"))).alias("x"))
    return read.groupBy("user_id", "x.minute", "x.value").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT o_orderkey AS k, o_orderkey % 6 AS depth, o_orderkey % 8 AS inv, 12 + o_custkey % 9 AS exam, o_custkey % 3 AS dep, o_custkey % 5 AS m FROM orders),
s AS (SELECT k, ['Tis', 'T1', 'T2', 'T3', 'T4a', 'T4b'][depth + 1] AS t, CASE WHEN inv = 0 AND dep > 0 THEN 'N1c' ELSE ['N0', 'N1a', 'N1b', 'N1b', 'N2a', 'N2a', 'N2a', 'N2b'][inv + 1] END AS n, ['M0', 'M1a', 'M1b', 'M1c', 'M0'][m + 1] AS m, inv, exam FROM r)
SELECT t, n, m, count(*) AS reports, sum(inv)::BIGINT AS involved, sum(exam)::BIGINT AS examined FROM s GROUP BY ALL""")
def staged_reports(t: Tables) -> DataFrame:
    """STR-13, STR-14: stage categories read from a report text of each order, counted; denials hold for their own clause."""
    key, other = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda c, *xs: F.get(F.array(*[F.lit(x) for x in xs]), (c % len(xs)).cast("int"))
    number = lambda c: F.when(key % 2 == 0, c.cast("string")).otherwise(pick(c, "no", "one", "two", "three", "four", "five", "six", "seven"))
    depth = pick(
        key, "Carcinoma in situ, the submucosa is spared.", "Growth does not extend beyond the submucosa.", "It reaches, but is not through, the muscularis propria; it is adherent to the bladder.",
        "It grows through the muscularis propria, without reaching the serosa.", "There is perforation, and no other organ is invaded.", "The uterus is adherent and invaded, invasion being proven.",
    )
    inv = key % 8
    nodes = F.concat(F.initcap(number(inv)), F.lit(" of "), (12 + other % 9).cast("string"), F.lit(" lymph nodes hold cancer."))
    deposits = F.when(other % 3 == 0, "Tumor deposits are absent.").otherwise(F.concat(F.lit("Tumor deposits: "), (other % 3).cast("string"), F.lit(".")))
    scan = pick(other, "nothing distant, no lesion", "lesions of the liver; no lung nodule", "lung and bone metastases", "omental masses, and liver metastases", "no liver, lung or bone lesion")
    text = F.concat_ws("\n", F.lit("Specimen: colon with bladder cuff"), depth, F.concat_ws(" ", nodes, deposits), F.concat(F.lit("Staging CT of the abdomen: "), scan))
    read = staging.read_reports(t.orders.select("o_orderkey", text.alias("report")), "o_orderkey", "report")
    return read.groupBy("t", "n", "m").agg(F.count("*").alias("reports"), F.sum("involved").alias("involved"), F.sum("examined").alias("examined"))
