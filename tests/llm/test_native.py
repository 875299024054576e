"""Mixing, sharding, line dedup, URL filters and license scans against DuckDB and by hand."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from gaugespark.llm import license_scan, line_dedup, mixing, registry, sharding, url_filters
from pyspark.sql import functions as F

COLUMNS = "doc_id, text, lang, source, n_chars"


def rounded(rows, columns):
    return Counter(tuple(round(v, 9) if isinstance(v, float) else v for v in (r[columns.index(c)] for c in sorted(columns))) for r in rows)


def agree(df, sql, tables):
    con = duckdb.connect()
    for name, path in tables.items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rounded([tuple(r) for r in df.collect()], df.columns) == rounded(cur.fetchall(), names)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_small_tables(spark, sf, name):
    agree(registry.QUERIES[name](spark, sf), registry.ORACLES[name], {t: f"{sf}/{t}.parquet" for t in ("documents", "pages")})


@pytest.mark.parametrize("name", ["op3_source_mixing", "op4_virtual_slot_sharding", "op9_license_scan"])
def test_edges_as_in_sql(spark, edge, tmp_path, name):
    known = edge.where("doc_id is not null").dropDuplicates(["doc_id"]) if name.startswith("op9") else edge
    known.write.parquet(f"{tmp_path}/documents.parquet")
    agree(registry.QUERIES[name](spark, str(tmp_path)), registry.ORACLES[name], {"documents": f"{tmp_path}/documents.parquet/*.parquet"})


def test_mixing_targets(spark, edge, empty):
    rows = mixing.mix(edge).collect()
    by = defaultdict(list)
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        by[r.source].append(r)
    assert len(rows) == edge.count()
    for own in by.values():
        assert sum(r.taken for r in own) == int(own[0].target)
        assert own[0].target <= 2 * own[0].source_size == 2 * sum(r.size for r in own)
    assert sum(own[0].target for own in by.values()) == pytest.approx(1.5 * sum(r.size for r in rows))
    assert mixing.mix(empty).count() == 0


def test_mixing_is_exact_over_many_slots(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7 + 1).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 11)).alias("source"))
    rows = mixing.mix(docs)
    again = mixing.mix(docs.repartition(7))
    assert rows.exceptAll(again).count() == 0
    off = rows.groupBy("source").agg(F.sum("taken").alias("t"), F.floor(F.first("target")).alias("b")).where("t <> b").count()
    assert off == 0


def test_mixed_documents(spark, edge, edge_rows, empty):
    mixed = mixing.mixed_documents(edge)
    assert mixed.columns == edge.columns
    taken = Counter(r.doc_id for r in mixed.collect())
    for r in mixing.mix(edge).where("doc_id is not null and size > 0").dropDuplicates(["doc_id"]).collect():
        rows = sum(1 for x in edge_rows if x[0] == r.doc_id)
        assert rows > 1 or abs(taken[r.doc_id] - r.taken / r.size) <= 0.5
    assert mixing.mixed_documents(empty).count() == 0


def test_sharding(spark, edge, edge_rows, empty):
    rows = sharding.shard(edge).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in edge_rows)
    for k in range(16):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    assert sharding.shard(empty).count() == 0
    assert sharding.sharded_documents(empty).count() == 0
    whole = sharding.sharded_documents(edge)
    assert Counter((r.doc_id, r.shard) for r in whole.collect()) == Counter((r.doc_id, r.shard) for r in rows)


def test_shards_are_even_with_a_hot_text(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.repeat(F.lit("hot "), 50)).otherwise(F.concat(F.lit("text "), F.repeat(F.col("id").cast("string"), 30))).alias("text"))
    found = sharding.shard(docs)
    sizes = [r[0] for r in found.groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert len(sizes) == 16 and max(sizes) < 1.02 * min(sizes)
    spread = found.where("doc_id % 3 <> 0").groupBy("text_crc32", "size").agg(F.countDistinct("shard").alias("n")).where("n > 1").count()
    assert spread == 0


def test_slots_of_short_common_texts(spark, monkeypatch, tmp_path):
    """A third of the rows are empty, a tenth are one row repeated: places stay gapless over many ranges."""
    monkeypatch.setattr(sharding, "ROWS_PER_RANGE", 16)
    n = F.col("id")
    docs = spark.range(6000).select(F.when(n % 10 == 0, -1).when(n % 3 == 0, n).otherwise(n + 10000).alias("doc_id"), F.when((n % 10 == 0) | (n % 3 == 0), "").otherwise(n.cast("string")).alias("text"))
    rows = sharding.shard(docs, 4, f"{tmp_path}/map").collect()
    assert len(rows) == 6000 and {r.version for r in sharding.load_map(spark, f"{tmp_path}/map").collect()} == {0}
    for k in range(4):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    assert len({r.shard for r in rows if r.size == 1}) == 1
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.collect())


def test_slot_maps_are_versioned(spark, tmp_path):
    weights = spark.range(500).select(F.col("id").cast("int").alias("virtual_slot"), (F.lit(100) + F.col("id") % 17).alias("bytes"), F.lit(1).alias("rows"))
    first = sharding.first_map(weights, 8)
    sharding.store_map(first, f"{tmp_path}/map")
    grown = weights.withColumn("bytes", F.when(F.col("virtual_slot") < 30, F.col("bytes") * 3).otherwise(F.col("bytes")))
    second = sharding.rebalanced(sharding.load_map(spark, f"{tmp_path}/map"), grown, 9)
    sharding.store_map(second, f"{tmp_path}/map")
    now = sharding.load_map(spark, f"{tmp_path}/map")
    assert {r.version for r in now.collect()} == {1} and now.count() == 500
    assert sharding.load_map(spark, f"{tmp_path}/map", 0).exceptAll(first).count() == 0
    loads = [r[0] for r in now.join(grown, "virtual_slot").groupBy("shard").agg(F.sum("bytes").alias("b")).select("b").collect()]
    assert len(loads) == 9 and max(loads) < 1.1 * min(loads)
    moved = now.join(first.withColumnRenamed("shard", "old"), "virtual_slot").where("shard <> old").count()
    assert moved < 200


def dedup_by_hand(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(low)
    held = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if d is not None and len(key(line)) >= 10:
                held[key(line)].add(d)
    gone = lambda d, line: d is not None and len(held[key(line)]) > 1 and d != min(held[key(line)])
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not gone(d, x)]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return Counter(out)


def test_line_dedup_edges(edge, edge_rows, empty):
    got = Counter((r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in line_dedup.deduped_lines(edge).collect())
    assert got == dedup_by_hand([(r[0], r[1]) for r in edge_rows])
    assert line_dedup.deduped_lines(empty).count() == 0


def test_a_hot_line_is_split(spark):
    """The join with the shared lines is one that adaptive execution splits at a line of a third of all rows."""
    settings = {"adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "adaptive.skewJoin.skewedPartitionFactor": "1.2", "adaptive.advisoryPartitionSizeInBytes": "4k", "adaptive.coalescePartitions.enabled": "false", "shuffle.partitions": "8"}
    before = {k: spark.conf.get(f"spark.sql.{k}") for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(f"spark.sql.{k}", v)
        n = F.col("id")
        docs = spark.range(0, 6000, 1, 8).select(n.alias("doc_id"), F.concat_ws("\n", F.lit("a line that all documents hold"), F.concat(F.lit("own line number "), n), F.concat(F.lit("shared line "), n % 500)).alias("text"))
        places = line_dedup.repeated_places(docs)
        assert len(places.collect()) == 5999
        assert "skew=true" in places._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(f"spark.sql.{k}", v)


URLS = [
    ("https://A.Example.org/es/x?y", "a.example.org", "/es/x", "example.org/es/", "block"),
    ("http://example.org/en/123", "example.org", "/en/123", "example.org/en/1", "block"),
    ("http://example.org/en/223", "example.org", "/en/223", "org/", "allow"),
    ("http://x.com/fr/1#a", "x.com", "/fr/1", "com/fr/", "allow"),
    ("http://x.com/de/1", "x.com", "/de/1", "com/de/", "block"),
    ("http://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"),
    ("http://x.net", "x.net", "", None, "allow"),
    ("http://x.org?a=/b", "x.org", "", None, "allow"),
    ("x.org/a", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("a://b://c/d", "b:", "//c/d", None, "allow"),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u[0], "h", "t", 1) for i, u in enumerate(URLS)] + [(None, None, None, None, None)], "page_id long, url string, host string, template string, purity int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judged_urls(pages).collect()}
    assert got == {**{i: u[1:] for i, u in enumerate(URLS)}, None: ("", "", None, "allow")}
    assert url_filters.judged_urls(pages.limit(0)).count() == 0


def test_url_templates_follow_labels(spark):
    """On one host every ruled page under /de/ is blocked, so its other templates stay apart."""
    rules = (("block", "site.net", "/bad/1"), ("allow", "site.net", "/good/1"))
    urls = [f"http://site.net/{kind}/{n}" for kind in ("bad", "good") for n in [*range(100, 140), *range(200, 210)]]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filters.judged_urls(pages, rules).collect()
    for r in got:
        assert r.verdict == ("block" if "/bad/" in r.path else "allow")
    assert {r.template for r in got} == {"bad/*", "good/*"}


def test_url_templates_at_any_depth(spark):
    """Branches told apart at the fifth segment, one of them after a stretch in common; a slash at the end counts."""
    rules = (("block", "site.net", "/a/b/c/d/bad/1"), ("allow", "site.net", "/a/b/c/d/good/1"), ("block", "long.net", "/" + "s/" * 300 + "bad"), ("allow", "long.net", "/" + "s/" * 300 + "good"))
    urls = [f"http://site.net/a/b/c/d/{kind}/{n}{end}" for kind in ("bad", "good") for n in [*range(100, 140), *range(200, 210)] for end in ("", "/")]
    urls += [f"http://long.net/{'s/' * 300}{kind}" for kind in ("bad", "good") for _ in range(30)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filters.judged_urls(pages, rules).collect()
    for r in got:
        assert r.verdict == ("block" if "/bad" in r.path else "allow")
    assert {r.template for r in got if r.host == "site.net"} == {f"*/*/*/*/{kind}/*{end}" for kind in ("bad", "good") for end in ("", "/")}
    assert {r.template for r in got if r.host == "long.net"} == {"*/" * 300 + kind for kind in ("bad", "good")}


def test_deep_urls_as_in_sql(spark, tmp_path):
    rng = random.Random(6)
    hosts = ["a.com", "b.org", "example.org", "x.net", ""]
    urls = ["http://" + rng.choice(hosts) + "".join("/" + rng.choice(["fr", "de", "es", "en", "1", "b", "c9", ""]) for _ in range(rng.randrange(0, 7))) for _ in range(1500)]
    spark.createDataFrame(list(enumerate([*urls, None, "none"])), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    agree(registry.QUERIES["op7_url_path_templates"](spark, str(tmp_path)), registry.ORACLES["op7_url_path_templates"], {"pages": f"{tmp_path}/pages.parquet/*.parquet"})


PROBES = [
    ("Licensed under CC BY 4.0.", "cc-by,cc-by-4.0"),
    ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"),
    ("Licensed under CC-BY-NC-SA 4.0", "cc-by,cc-by-nc-sa-4.0"),
    ("Distributed under GPL version 2", ""),
    ("Licensed under the GNU General Public License, version 2", "gpl,gpl-2.0"),
    ("Licensed under the GNU Lesser General Public License, version 3", "lgpl-3.0"),
    ("Licensed under the Apache\nLicense, Version 2.0", "apache,apache-2.0"),
    ("Creative Commons Attribution-ShareAlike 4.0 International", "cc-by-sa-4.0"),
    (license_scan._GPL.format("", "3"), "gpl,gpl-3.0"),
    ("The license was by 4 of 0, under cc", ""),
]


def test_license_labels_are_told_apart(spark):
    docs = spark.createDataFrame([(i, p[0]) for i, p in enumerate(PROBES)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in license_scan.license_scan(docs).collect()}
    assert got == {i: p[1] for i, p in enumerate(PROBES)}


def test_license_edges(edge, edge_rows, empty):
    got = {r.doc_id: r for r in license_scan.license_scan(edge).where("doc_id is not null").collect()}
    assert (got[13].base_labels, got[13].labels, got[13].n_base) == ("cc-by,mit", "cc-by,cc-by-nc-4.0,mit", 3)
    assert (got[13].first_word, got[13].last_word) == (3, 14)
    assert (got[14].base_labels, got[14].labels, got[14].score) == ("gpl", "gpl,gpl-3.0", 1.0)
    assert (got[15].base_labels, got[15].n_base, got[15].first_word, got[15].last_word) == ("apache,cc-by", 3, 0, 7)
    assert (got[4].n_words, got[4].n_base, got[4].first_word, got[4].labels, got[4].score) == (0, 0, None, "", 0.0)
    assert license_scan.license_scan(empty).count() == 0
    assert license_scan.license_scan(edge).count() == len(edge_rows)


def test_line_dedup_digest(spark, sf):
    kept = line_dedup.deduped_lines(spark.read.parquet(f"{sf}/documents.parquet")).where("n_dropped = 0").limit(20).collect()
    query = {r.doc_id: r.kept_sha256 for r in registry.QUERIES["op6_line_dedup"](spark, sf).collect()}
    for r in kept:
        assert query[r.doc_id] == hashlib.sha256(r.kept_text.encode()).hexdigest()
