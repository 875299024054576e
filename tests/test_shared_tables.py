"""Tables that many writers change, streams that are killed, documents, distributions, digests, and rows that divide by nothing."""

import threading

import duckdb
import pytest
from pyspark.sql import functions as F

from gaugespark import catalogue
from gaugespark.operators import distributions, documents, metrics, provenance, ranks, routing
from gaugespark.sources import snapshots
from gaugespark.streaming import incremental


def test_two_writers_lose_no_rows(spark, tmp_path):
    path, failures = f"{tmp_path}/shared", []

    def writer(name):
        try:
            for k in range(3):
                new = spark.createDataFrame([(name, k)], "system string, k int")
                snapshots.updated(spark, path, lambda rows: new if rows is None else rows.unionByName(new), tries=30)
        except Exception as error:
            failures.append(error)

    threads = [threading.Thread(target=writer, args=(n,)) for n in ("a", "b")]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert not failures
    assert sorted(tuple(r) for r in snapshots.snapshot(spark, path).collect()) == [(n, k) for n in "ab" for k in range(3)]
    assert snapshots.versions(spark, path) == [1, 2, 3, 4, 5, 6]
    assert snapshots.snapshot(spark, path, 1).count() == 1


def test_a_version_is_published_once(spark, tmp_path):
    path = f"{tmp_path}/shared"
    assert snapshots.snapshot(spark, path) is None
    one = spark.createDataFrame([("a", 1), ("b", 1)], "system string, k int")
    assert snapshots.updated(spark, path, snapshots.replaced(one, "system")) == 1
    assert not snapshots._published(spark, path, 1, "other")
    assert snapshots.updated(spark, path, snapshots.replaced(spark.createDataFrame([("b", 2)], "system string, k int"), "system")) == 2
    assert sorted(tuple(r) for r in snapshots.snapshot(spark, path).collect()) == [("a", 1), ("b", 2)]

    def late(rows):
        snapshots.updated(spark, path, lambda now: now)
        return rows

    with pytest.raises(snapshots.Conflict):
        snapshots.updated(spark, path, late, tries=2, wait=0)


def test_a_killed_stream_writes_each_row_once(spark, tmp_path):
    source = f"{tmp_path}/in"
    for k in range(4):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(source)
    calls = []

    def breaks(rows, n):
        calls.append(n)
        if len(calls) == 2:
            raise ValueError("killed")

    def start():
        stream = incremental.arriving(spark, source, "id long", files_at_once=1)
        return incremental.written_once(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint", breaks)

    with pytest.raises(Exception, match="killed"):
        start().awaitTermination()
    start().awaitTermination()
    assert calls.count(1) == 2
    got = sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == list(range(40))


def test_parts_go_on_after_one_that_fails(spark, tmp_path, capsys):
    df, path, fails = spark.range(25).withColumnRenamed("id", "n"), f"{tmp_path}/parts", [True]

    def finish(rows):
        if fails[0] and rows.where("n = 12").count():
            raise ValueError("no room")
        return rows.withColumn("square", F.col("n") * F.col("n"))

    assert len(incremental.checkpointed(df, path, "n", 10, finish)) == 2
    assert "no room" in capsys.readouterr().out
    fails[0] = False
    assert incremental.checkpointed(df, path, "n", 10, finish) == [f"{path}/part=1"]
    assert sorted(r.square for r in spark.read.parquet(path).collect()) == [n * n for n in range(25)]
    assert incremental.checkpointed(df.limit(0), path, "n", 10, finish) == []


def test_leaves_of_documents(spark):
    rows = [(1, '{"a":{"b":[1,{"c":null},[]]},"x y":"t","z":1.50,"e":{},"t":true}'), (2, None), (3, "{bad"), (4, "7"), (5, "[]")]
    got = {(r.k, r.path): (r.kind, r.value) for r in documents.leaves(spark.createDataFrame(rows, "k int, d string"), ["k"], "d").collect()}
    assert got == {
        (1, "$.a.b[0]"): ("number", "1"), (1, "$.a.b[1].c"): ("null", None), (1, "$.a.b[2]"): ("array", "[]"), (1, '$."x y"'): ("text", "t"), (1, "$.z"): ("number", "1.5"), (1, "$.e"): ("object", "{}"),
        (1, "$.t"): ("boolean", "true"), (2, "$"): ("unreadable", None), (3, "$"): ("unreadable", None), (4, "$"): ("number", "7"), (5, "$"): ("array", "[]"),
    }


def test_differences_of_documents(spark):
    of = lambda *rows: spark.createDataFrame(list(rows), "k int, d string")
    one = of((1, '{"model":"m","n":1,"same":[{"q":"x"}]}'), (2, '{"n":1}'), (3, '{"n":1}'))
    two = of((1, '{"model":"o","n":"1","same":[{"q":"x"},2]}'), (2, '{"n":1}'))
    got = {(r.k, r.path): (r.change, r.left, r.right, r.severity) for r in documents.differences(one, two, ["k"], "d", [r"^\$\.model"], [r"^\$\.same"]).collect()}
    assert got == {(1, "$.model"): ("changed", "m", "o", "blocking"), (1, "$.n"): ("changed", "1", "1", "notable"), (1, "$.same[1]"): ("added", None, "2", "harmless"), (3, "$.n"): ("removed", "1", None, "notable")}


def test_joint_distribution(spark):
    rows = [(1, [("a", 0.25), ("b", 0.75)], [("x", 0.5), ("y", 0.5)]), (2, [("b", 1.0)], [("y", 1.0)]), (3, [], [("x", 1.0)]), (4, None, [("x", 1.0)])]
    df = spark.createDataFrame(rows, "k int, p array<struct<label:string,p:double>>, q array<struct<label:string,p:double>>")
    product = distributions.joint([F.col("p"), F.col("q")])
    assert df.where("k = 1").select(F.aggregate(product, F.lit(0.0), lambda a, x: a + x["p"]).alias("s")).first().s == pytest.approx(1)
    level = lambda x: F.when((F.get(x, F.lit(0)) == "b") & (F.get(x, F.lit(1)) == "y"), F.lit(None).cast("string")).otherwise(F.get(x, F.lit(1)))
    got = {r.k: r.m for r in df.select("k", distributions.level_distribution(product, level).alias("m")).collect()}
    assert got[1] == pytest.approx({"x": 0.5 / 0.625, "y": 0.125 / 0.625})
    assert got[2] == got[3] == got[4] == {}


def test_one_changed_value_is_named(spark):
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"), F.when(F.col("id") % 5 > 0, "t").alias("s"))
    assert provenance.changed(df, df.repartition(7).select("s", "v", "k"), ["k"]).count() == 0
    other = df.where("k <> 9").withColumn("v", F.when(F.col("k") == 77, 5).otherwise(F.col("v"))).withColumn("s", F.when(F.col("k") == 100, "new").otherwise(F.col("s")))
    got = {(r.k, r.column, r.change, r.left, r.right) for r in provenance.changed(df, other, ["k"], blocks=16).collect()}
    assert got == {(77, "v", "changed", "154", "5"), (9, "v", "removed", "18", None), (9, "s", "removed", "t", None), (100, "s", "changed", None, "new")}


def test_nothing_to_divide_by(spark):
    lone = spark.createDataFrame([("a", 1.0, True)], "g string, x double, ok boolean")
    nth = F.lit(1)
    assert lone.select(ranks.first_rank_decile(nth, F.count("*").over(__import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy("g"))).alias("d")).first().d == 1
    got = routing.pairing(lone, "g", F.lit(True), F.col("ok"), F.col("ok"), F.lit(1.0), F.lit(0.0)).first()
    assert (got.paired, got.cost_share) == (1.0, None)
    assert metrics.auroc_variance(lone, "x", F.col("ok")).first().variance is None


def test_several_levels_are_one_round(spark, monkeypatch):
    """A document of three levels is written once, and a deeper one as often as its rounds."""
    written, real = [], documents.kept
    monkeypatch.setattr(documents, "kept", lambda df, name: written.append(name) or real(df, name))
    flat = spark.createDataFrame([(1, '{"a": {"b": [1, {}]}}'), (2, "[]"), (3, "no")], "k int, d string")
    assert {(r.k, r.path, r.kind, r.value) for r in documents.leaves(flat, ["k"], "d").collect()} == {(1, "$.a.b[0]", "number", "1"), (1, "$.a.b[1]", "object", "{}"), (2, "$", "array", "[]"), (3, "$", "unreadable", None)}
    assert len(written) == 1
    deep = spark.createDataFrame([(1, "[" * 11 + "null" + "]" * 11)], "k int, d string")
    assert [tuple(r) for r in documents.leaves(deep, ["k"], "d").collect()] == [(1, "$" + "[0]" * 11, "null", None)]
    assert len(written) == 4


def test_every_event_is_compared_with_the_next(spark, tmp_path):
    """Also events whose number a filter might leave out, here those that 5 divides."""
    rows = [(n, 7, "click" if 5 < n <= 10 else "view", '{"k": %d}' % ((n - 1) // 5)) for n in range(4, 13)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, props string").write.parquet(f"{tmp_path}/events.parquet")
    df = catalogue.QUERIES["document_differences"](spark, str(tmp_path))
    got = sorted(tuple(r) for r in df.select("path", "change", "severity", "n", "first").collect())
    paths = [("$.type", "blocking"), ("$.props.k", "harmless"), *[(p, "notable") for p in ("$.history[0]", '$.history[1]."odd name"', "$.history[1].seen", "$.history[2]")]]
    ends = [(p, change, s, 1, first) for p, s in paths for change, first in (("added", 3), ("removed", 12))]
    # types and numbers change from 5 to 6 and from 10 to 11, the last entry also beside each number that 3 divides
    assert got == sorted([*ends, ("$.type", "changed", "blocking", 2, 5), ("$.props.k", "changed", "harmless", 2, 5), ("$.history[2]", "changed", "notable", 6, 5)])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == sorted(con.execute(f'SELECT path, change, severity, n, "first" FROM ({catalogue.ORACLES["document_differences"]})').fetchall())
