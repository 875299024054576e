"""URL filters: exact rules first, then a tree of path templates for each host.

Paths become raw templates: segments with a digit and very long ones are
wildcards. From the top of each host's tree down, whatever its depth, the
branches under a node are compared by the share of blocked pages among those
that a rule has judged: branches that can't be told from their siblings together
become one wildcard, the others stay. A template is rejected if its blocked
share, smoothed towards its host's, is over the threshold.

A round takes all nodes of a level at once, as aggregations over distinct raw
templates, whose partial sums keep a host with a third of all pages out of any
single task; what a join takes from its own rows is a table first, so that both sides are
shuffled and the host can be split. Where a branch has no judged pages, only allowed, only blocked, or
one continuation, all below it would be merged: it is finished at once, and a
stretch that a whole branch has in common is passed over in one step, so the
rounds are as many as decisions lie above each other, not as segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugespark.llm.common import ascii_lower, stored

#: (verdict, host, path): a rule fits its host and all subdomains.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
LONGEST, Z, SMOOTHING, THRESHOLD = 24, 1.96, 4.0, 0.5
_URL = "(?s)^.*?://([^/?#]*)([^?#]*)"
_WILD = "*"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL; both empty without ://."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    return ascii_lower(F.regexp_extract(text, _URL, 1)), F.regexp_extract(text, _URL, 2)


def matched_rule(rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """Rule text and verdict of the longest rule that fits host and path, else null.

    Rules are a list kept by hand: one branch of an expression for each.
    """
    text = verdict = F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        text, verdict = F.when(fits, host + path).otherwise(text), F.when(fits, kind).otherwise(verdict)
    return text, verdict


def _raw(path: Column) -> Column:
    """The path after its first slash, variable segments as wildcards."""
    variable = lambda s: s.rlike("[0-9]") | (F.length(s) > LONGEST)
    return F.array_join(F.transform(F.split(F.regexp_replace(path, "^/", ""), "/", -1), lambda s: F.when(variable(s), _WILD).otherwise(s)), "/")


def _in_common(lo: Column, hi: Column) -> Column:
    """How many elements two arrays begin with alike."""
    shorter = F.least(F.size(lo), F.size(hi))
    other = F.array_position(F.transform(F.slice(lo, F.lit(1), shorter), lambda s, i: s != F.get(hi, i)), F.lit(True))
    return F.when(other > 0, other - 1).otherwise(shorter).cast("int")


def merged_templates(tree: DataFrame) -> DataFrame:
    """host, raw, template, good, bad: tree (host, raw, good, bad) with each raw template's merged one."""
    now = tree.select("host", "raw", F.split("raw", "/", -1).alias("rest"), F.array().cast("array<string>").alias("done"), "good", "bad")
    finished = []
    while True:
        # done has the merged segments so far, rest those that follow
        branches = now.groupBy("host", "done").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"), F.min("rest").alias("lo"), F.max("rest").alias("hi"))
        branches = branches.select("host", "done", F.expr("g > 0 and b > 0 and lo <> hi").alias("open"), _in_common(F.col("lo"), F.col("hi")).alias("common"))
        marked = stored(now.join(stored(branches, "branch-facts"), ["host", "done"]), "branches")
        wild = lambda n: F.concat("done", F.transform(F.slice("rest", F.lit(1), n), lambda s: F.when(s == "", s).otherwise(_WILD)))
        finished.append(marked.where("not open").select("host", "raw", F.array_join(wild(F.size("rest")), "/").alias("template"), "good", "bad"))
        opened = marked.where("open")
        if opened.isEmpty():
            break
        step = F.coalesce(F.concat(F.lit("/"), F.get("rest", F.col("common"))), F.lit(""))
        rows = opened.select("host", "raw", wild(F.col("common")).alias("stem"), step.alias("step"), F.slice("rest", F.col("common") + 2, F.greatest(F.size("rest"), F.lit(1))).alias("rest"), "good", "bad")
        children = stored(rows.groupBy("host", "stem", "step").agg(F.sum("bad").alias("b"), F.sum(F.col("good") + F.col("bad")).alias("n")), "children")
        parents = children.groupBy("host", "stem").agg((F.sum("b") / F.greatest(F.sum("n"), F.lit(1))).alias("p"))
        share, p, n = F.col("b") / F.greatest(F.col("n"), F.lit(1)), F.col("p"), F.col("n")
        alike = (F.col("step") != "/") & ((n == 0) | ((share - p) * (share - p) * n <= F.lit(Z * Z) * p * (1 - p)))
        name = F.when(F.col("step") == "", F.array().cast("array<string>")).when(alike, F.array(F.lit(_WILD))).otherwise(F.array(F.substr("step", F.lit(2))))
        named = stored(children.join(stored(parents, "parents"), ["host", "stem"]).select("host", "stem", "step", name.alias("name")), "named")
        now = rows.join(named, ["host", "stem", "step"]).select("host", "raw", "rest", F.concat("stem", "name").alias("done"), "good", "bad")
    every = finished[0]
    for more in finished[1:]:
        every = every.union(more)
    return every


def template_verdicts(judged: DataFrame) -> DataFrame:
    """host, raw, template, purity: the merged template of each raw one, and its smoothed blocked share."""
    tree = judged.groupBy("host", "raw").agg(F.count_if(F.col("verdict") == "allow").alias("good"), F.count_if(F.col("verdict") == "block").alias("bad"))
    tree = stored(merged_templates(stored(tree, "raw-templates")), "templates")
    totals = tree.agg((F.sum("bad") / F.greatest(F.sum(F.col("good") + F.col("bad")), F.lit(1))).alias("prior"))
    smooth = lambda b, n, prior: (b + F.lit(SMOOTHING) * prior) / (n + F.lit(SMOOTHING))
    hosts = tree.groupBy("host").agg(F.sum("bad").alias("b"), F.sum(F.col("good") + F.col("bad")).alias("n"))
    hosts = hosts.join(F.broadcast(totals)).select("host", smooth(F.col("b"), F.col("n"), F.col("prior")).alias("host_share"))
    groups = tree.groupBy("host", "template").agg(F.sum("bad").alias("b"), F.sum(F.col("good") + F.col("bad")).alias("n"))
    groups = groups.join(hosts, "host").select("host", "template", smooth(F.col("b"), F.col("n"), F.col("host_share")).alias("purity"))
    return stored(tree.join(groups, ["host", "template"]).select("host", "raw", "template", "purity"), "verdicts")


def judged_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity: a row for each row of pages.

    The longest rule that fits decides; pages without one are blocked if their
    template's smoothed blocked share is over one half, else allowed. Templates
    have as many segments as their paths, after the first slash; empty segments
    stay empty. A null URL, or one without ://, has an empty host and path. Repeated rows are judged alike
    and count as often as they occur; other columns are ignored.
    """
    host, path = split_url(F.col("url"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = matched_rule(rules)
    ruled = stored(urls.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), _raw(F.col("path")).alias("raw")), "urls")
    found = template_verdicts(ruled)
    chosen = F.coalesce("verdict", F.when(F.col("purity") > THRESHOLD, "block").otherwise("allow"))
    return ruled.join(found, ["host", "raw"]).select("page_id", "host", "path", "rule", chosen.alias("verdict"), "template", "purity")


def _oracle() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    longest = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in longest)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in longest)
    return f"""
WITH RECURSIVE urls AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{_URL}', 1), '{upper}', '{lower}') AS host,
         regexp_extract(coalesce(url, ''), '{_URL}', 2) AS path FROM pages
), ruled AS (
  SELECT *, CASE {rule} END AS rule, CASE {verdict} END AS verdict,
         list_transform(string_split(regexp_replace(path, '^/', ''), '/'), lambda s: CASE WHEN regexp_matches(s, '[0-9]') OR length(s) > {LONGEST} THEN '*' ELSE s END) AS seg
  FROM urls
), t0 AS (
  SELECT host, seg, count(*) FILTER (verdict = 'allow') AS good, count(*) FILTER (verdict = 'block') AS bad FROM ruled GROUP BY ALL
), tree AS (
  SELECT host, seg, []::VARCHAR[] AS done, 0 AS depth, good, bad FROM t0
  UNION ALL
  SELECT host, seg, CASE WHEN depth = len(seg) THEN done
                         WHEN (n = 0 OR (b / greatest(n, 1) - p) * (b / greatest(n, 1) - p) * n <= {Z * Z} * p * (1 - p)) AND seg[depth + 1] <> '' THEN list_append(done, '*')
                         ELSE list_append(done, seg[depth + 1]) END, depth + 1, good, bad
  FROM (
    SELECT *, (sum(bad) OVER c)::DOUBLE AS b, (sum(good + bad) OVER c)::DOUBLE AS n,
           (sum(bad) OVER a)::DOUBLE / greatest((sum(good + bad) OVER a)::DOUBLE, 1) AS p
    FROM tree WHERE depth <= len(seg)
    WINDOW a AS (PARTITION BY host, done), c AS (PARTITION BY host, done, seg[depth + 1])
  )
), merged AS (
  SELECT host, seg, array_to_string(done, '/') AS template, good, bad FROM tree WHERE depth = len(seg) + 1
), shares AS (
  SELECT *, sum(bad) OVER h AS hb, sum(good + bad) OVER h AS hn, sum(bad) OVER g AS gb, sum(good + bad) OVER g AS gn,
         sum(bad) OVER () / greatest(sum(good + bad) OVER (), 1) AS prior
  FROM merged WINDOW h AS (PARTITION BY host), g AS (PARTITION BY host, template)
), purities AS (
  SELECT *, (gb + {SMOOTHING}::DOUBLE * ((hb + {SMOOTHING}::DOUBLE * prior) / (hn + {SMOOTHING}::DOUBLE))) / (gn + {SMOOTHING}::DOUBLE) AS purity FROM shares
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN purity > {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict, template, purity
FROM ruled JOIN purities USING (host, seg)
"""


#: op7 in DuckDB's SQL, every level of the tree by a recursive step.
ORACLE = _oracle()
