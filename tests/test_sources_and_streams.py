"""Readers, writers, streams and models on small files, against hand-worked results."""

import gzip
import json
import zipfile
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugespark.functions import texts, values
from gaugespark.operators import keys, metrics, models, ranks, resampling, routing
from gaugespark.sources import tables
from gaugespark.streaming import incremental


def test_csv_and_gzip(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ID,Name\n1,x\n2,\n")
    with gzip.open(tmp_path / "b.csv.gz", "wt") as f:
        f.write("ID,Name\n3,y\n")
    found = tables.csv_lower(spark, str(tmp_path))
    assert found.columns == ["id", "name"]
    assert {r.id for r in found.collect()} == {"1", "2", "3"}
    kept = tables.csv_text(spark, str(tmp_path / "a.csv"), "id string, name string")
    assert sorted(tuple(r) for r in kept.collect()) == [("1", "x"), ("2", "")]


def test_fixed_width_and_layout(spark, tmp_path):
    spans = tables.layout("SEQN 1-3\nSEX $ 4-4\n@5 AGE 2.\n")
    assert spans == {"SEQN": (1, 3, False), "SEX": (4, 4, True), "AGE": (5, 6, False)}
    (tmp_path / "f.txt").write_text("  1F40\n  2M88\n  3 . \n")
    rows = sorted(tuple(r) for r in tables.fixed_width(spark, str(tmp_path / "f.txt"), spans).collect())
    assert rows == [(1.0, "F", 40.0), (2.0, "M", None), (3.0, None, None)]


def test_json_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), [0.1, 0.2]), (2, 0.5, [0.3, 0.4])], "id int, p double, ci array<double>")
    tables.to_json(df, str(tmp_path / "j"))
    back = {r.id: r for r in tables.json_lines(spark, str(tmp_path / "j"), "id int, p double, ci array<double>").collect()}
    assert back[1].p is None and back[2].p == 0.5
    tables.to_csv(df, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).columns == ["id", "p", "ci_low", "ci_high"]


def test_parquet_replaces_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "p")
    tables.to_parquet(spark.createDataFrame([("a", 1), ("b", 2)], "system string, v int"), path, ["system"])
    tables.to_parquet(spark.createDataFrame([("b", 3)], "system string, v int"), path, ["system"])
    assert sorted((r.system, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 3)]


def test_files_against_manifest(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"one")
    (tmp_path / "y.bin").write_bytes(b"two")
    files = tables.whole_files(spark, str(tmp_path))
    listed = files.where("length = 3 and path like '%x.bin'").select("sha256")
    assert [r.path.rsplit("/", 1)[1] for r in tables.unverified(files, listed).collect()] == ["y.bin"]


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a.csv", "1,2\n")
        z.writestr("b.txt", "hello")
    found = {r.member: (r.length, r.text) for r in tables.zip_members(spark, str(tmp_path / "z.zip")).collect()}
    assert found == {"a.csv": (4, "1,2\n"), "b.txt": (5, "hello")}


def test_json_documents(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"a": {"b": [1, 2]}, "c": "x"}, indent=1))
    assert tables.json_documents(spark, str(tmp_path / "d.json")).select("a.b", "c").first() == ([1, 2], "x")


def test_stream_keeps_first_of_key_and_resumes(spark, tmp_path):
    schema = "key string, ts timestamp, value double"
    rows = spark.sql("select * from values ('a', timestamp'2024-01-01 00:00:00', 1D), ('a', timestamp'2024-01-01 00:01:00', 1D), ('b', timestamp'2024-01-01 00:02:00', 3D) as t(key, ts, value)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for _ in range(2):
        stream = incremental.first_of_key(incremental.arriving(spark, str(tmp_path / "in"), schema), "key", "ts")
        incremental.appended(stream, out, mark).awaitTermination(60)
    assert sorted((r.key, r.value) for r in spark.read.parquet(out).collect()) == [("a", 1.0), ("b", 3.0)]
    rows.select("key", F.expr("ts + interval 3 hours").alias("ts"), "value").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = incremental.first_of_key(incremental.arriving(spark, str(tmp_path / "in"), schema), "key", "ts")
    incremental.appended(stream, out, mark).awaitTermination(60)
    assert spark.read.parquet(out).count() >= 2


def test_windowed_counts_match_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    events.write.parquet(str(tmp_path / "in"))
    counted = incremental.counted(incremental.arriving(spark, str(tmp_path / "in"), events.schema), "ts", "1 day", "event_type")
    query = counted.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(90)
    batch = events.groupBy(F.window("ts", "1 day")["start"].alias("start"), "event_type").agg(F.count("*").alias("n"))
    key = lambda df: sorted((str(r.start), r.event_type, r.n) for r in df.collect())
    assert key(spark.table("counted")) == key(batch)


def test_rise_rule_on_worked_cases(spark):
    hour = 60
    cases = [
        ([(-1, "1.00"), (10, "1.30")], 1), ([(-1, "1.00"), (10, "1.29")], 0), ([(-2, "1.00"), (46, "1.30")], 1), ([(-80, "1.00"), (10, "1.50")], 1), ([(-80, "1.00"), (10, "2.00")], 2),
        ([(-80, "1.00"), (10, "3.00")], 3), ([(-10, "3.70"), (2, "4.00")], 3), ([(-1, "3.00"), (1, "1.00"), (50, "1.10")], 0),
    ]
    rows = [(k, h * hour, Decimal(v)) for k, (events, _) in enumerate(cases) for h, v in events]
    rows += [(99, -2 * hour, Decimal("1.00")), (99, 46 * hour + 1, Decimal("1.30"))]  # a minute late
    df = spark.createDataFrame(rows, "id int, t int, v decimal(10,2)")
    df = ranks.earlier_minimum(ranks.earlier_minimum(df, "id", "t", "v", 2880, "short"), "id", "t", "v", 10080, "long")
    staged = df.withColumn("stage", ranks.rise_stage(F.col("v"), F.col("short"), F.col("long")))
    found = {r.id: r.stage for r in ranks.highest_first(staged, "id", "stage", "t").collect()}
    assert found == {k: stage for k, (_, stage) in enumerate(cases)} | {99: 0}


def test_tiles_like_array_split(spark):
    for n in (7, 23, 100):
        df = spark.createDataFrame([(i, float(i % 5)) for i in range(n)], "id int, v double")
        placed = ranks.numbered(df, "v", "id")
        got = [r.t for r in placed.orderBy("_nth").select(ranks.tile(F.col("_nth"), F.lit(n), 10).alias("t")).collect()]
        assert got == [k + 1 for k, part in enumerate(np.array_split(np.arange(n), 10)) for _ in part]


def test_logistic_line_solves_the_score_equations(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.5 + 1.5 * x)))).astype(float)
    a, b = models.logistic_line(spark.createDataFrame([(float(i), float(j)) for i, j in zip(x, y)], "x double, y double"), F.col("x"), F.col("y"), F.lit(1.0))
    left = y - 1 / (1 + np.exp(-(a + b * x)))
    assert abs(left.sum()) < 1e-4 and abs((left * x).sum()) < 1e-4


def test_crossfitting_scores_each_row_once(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(v), "a" if i % 2 else "b", int(v + rng.normal() * 0.3 > 0)) for i, v in enumerate(rng.normal(size=300))]
    out = models.crossfitted(spark.createDataFrame(rows, "id long, v double, g string, y int"), "id", "y", ["v"], ["g"], folds=3).toPandas()
    assert len(out) == 300 and out.id.is_unique
    assert ((out.p > 0.5) == (out.y > 0.5)).mean() > 0.8


def test_auroc_and_variance_by_pairs(spark):
    rng = np.random.default_rng(3)
    score, pos = rng.integers(0, 9, 80).astype(float), rng.random(80) < 0.4
    df = spark.createDataFrame([(float(s), bool(p)) for s, p in zip(score, pos)], "s double, p boolean")
    wins = (score[pos][:, None] > score[~pos]) + 0.5 * (score[pos][:, None] == score[~pos])
    assert metrics.auroc(df, "s", F.col("p")).first().auroc == pytest.approx(wins.mean())
    variance = wins.mean(1).var(ddof=1) / pos.sum() + wins.mean(0).var(ddof=1) / (~pos).sum()
    assert metrics.auroc_variance(df, "s", F.col("p")).first().variance == pytest.approx(variance)


def test_poisson_weights_have_mean_one(spark):
    w = [r.w for r in spark.range(4000).select(resampling.poisson_weight(F.col("id"), F.lit(3)).alias("w")).collect()]
    assert np.mean(w) == pytest.approx(1, abs=0.06) and np.var(w) == pytest.approx(1, abs=0.12)


def test_frontier_by_pairs(spark):
    rng = np.random.default_rng(4)
    points = [(i, float(c), float(e)) for i, (c, e) in enumerate(rng.integers(0, 30, (200, 2)))]
    kept = {r.id for r in keys.on_frontier(spark.createDataFrame(points, "id int, cost double, error double"), "id", "cost", "error").collect()}
    dominated = lambda p: any(q[1] <= p[1] and q[2] <= p[2] and (q[1] < p[1] or q[2] < p[2]) for q in points)
    assert kept == {p[0] for p in points if not dominated(p)}


def test_certainty_has_a_tolerance_and_nulls_are_uncertain(spark):
    df = spark.createDataFrame([(1.0,), (1 - 5e-10,), (0.99,), (None,)], "p double")
    assert [r.c for r in df.select(routing.certain(F.col("p")).alias("c")).collect()] == [True, True, False, False]


def test_half_even_and_published_formula(spark):
    row = spark.range(1).select(F.bround(F.lit(2.5), 0).alias("h"), F.round(values.filtration_rate(F.lit(0.8), F.lit(50), F.lit("female")), 1).alias("e")).first()
    assert row.h == 2.0 and row.e == pytest.approx(89.7, abs=0.2)


def test_matched_label_needs_one_meaning(spark):
    df = spark.createDataFrame([("Yes",), ("[yes].",), ("maybe",), ("AB",), ("Ab",)], "c string")
    found = [r.m for r in df.select(texts.matched_label(F.col("c"), ["yes", "no", "AB", "ab"]).alias("m")).collect()]
    assert found == ["yes", "yes", None, "AB", None]


def test_places_of_a_hot_value(spark):
    rows = [(i, 1.0 if i % 3 else float(i % 7)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, v double").repartition(5)
    got = {r.id: r["_nth"] for r in ranks.numbered(df, "v", "id").collect()}
    assert got == {i: k for k, (_, i) in enumerate(sorted((v, i) for i, v in rows), 1)}
    down = {r.id: r["_nth"] for r in ranks.numbered(df, "v", "id", falling=True).collect()}
    assert down == {i: k for k, (_, i) in enumerate(sorted((-v, i) for i, v in rows), 1)}


def test_places_by_text_ties(spark):
    rows = [(f"k{i % 50:02d}-{i}", float(i % 4)) for i in range(300)]
    got = {r.k: r["_nth"] for r in ranks.numbered(spark.createDataFrame(rows, "k string, v double"), "v", "k").collect()}
    assert got == {k: n for n, (_, k) in enumerate(sorted((v, k) for k, v in rows), 1)}


def test_range_minima_of_a_hot_entity(spark):
    rng = np.random.default_rng(6)
    rows = [(0 if i % 3 else int(i % 5), int(t), float(v)) for i, (t, v) in enumerate(zip(rng.integers(-500, 3000, 600), rng.integers(0, 1000, 600)))] + [(1, None, 5.0)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, e int, t int, v double")
    got = ranks.range_minima(df, "e", "t", "v", {"before": (-60, -1), "after": (1, 90)}).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.t is None:
            continue
        near = lambda low, high, r=r: min((v for e, t, v in rows if e == r.e and t is not None and low <= t - r.t <= high), default=None)
        assert (r.before, r.after) == (near(-60, -1), near(1, 90))


def test_running_minimum(spark):
    rng = np.random.default_rng(7)
    rows = [(float(i), float(v)) for i, v in enumerate(rng.integers(0, 1000, 500))]
    got = {r.x: r.least for r in ranks.running_minimum(spark.createDataFrame(rows, "x double, y double"), "x", "y", "least").collect()}
    assert got == {x: min((y for z, y in rows if z < x), default=None) for x, _ in rows}


def test_simultaneous_intervals_are_wider(spark):
    rng = np.random.default_rng(8)
    draws = spark.createDataFrame([(b, m, float(rng.normal())) for b in range(200) for m in ("a", "b", "c")], "draw int, m string, v double")
    point = draws.groupBy("m").agg(F.avg("v").alias("v"))
    both = {r.m: r.high - r.low for r in resampling.simultaneous(draws, point, "m", "v").collect()}
    alone = {r.m: r.high - r.low for r in resampling.interval(draws, "v", ["m"]).collect()}
    assert all(both[m] > alone[m] for m in "abc")


def test_holm_is_monotone_and_capped(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.9)], "n string, p double")
    assert {r.n: round(r.holm_p, 6) for r in resampling.holm(df, "p", "n").collect()} == {"a": 0.04, "c": 0.09, "b": 0.09, "d": 0.9}


def ibm(x):
    """A number as eight bytes of base-16 floating point."""
    if not x:
        return bytes(8)
    sign, x, power = (0x80 if x < 0 else 0), abs(x), 64
    while x >= 1:
        x, power = x / 16, power + 1
    while x < 1 / 16:
        x, power = x * 16, power - 1
    return bytes([sign | power]) + int(x * 2**56).to_bytes(7, "big")


def transport_file(names, rows):
    """A SAS transport file of numbers (type 1) and texts of eight bytes (type 2)."""
    import struct

    head = lambda kind, rest="0" * 30: f"HEADER RECORD*******{kind:<8}HEADER RECORD!!!!!!!{rest}  ".encode()
    day = "01JAN24:00:00:00"
    out = head("LIBRARY") + f"{'SAS':<8}{'SAS':<8}{'SASLIB':<8}{'9.1':<8}{'x':<8}{'':24}{day}".encode() + f"{day:<80}".encode()
    out += head("MEMBER", "000000000000000001600000000140") + head("DSCRPTR")
    out += f"{'SAS':<8}{'T':<8}{'SASDATA':<8}{'9.1':<8}{'x':<8}{'':24}{day}".encode() + f"{day}{'':64}".encode()
    out += head("NAMESTR", f"000000{len(names):04d}00000000000000000000")
    fields = b"".join(struct.pack(">hhhh8s40s8shhh2s8shhl52s", kind, 0, 8, i + 1, n.ljust(8).encode(), b" " * 40, b" " * 8, 0, 0, 0, b"  ", b" " * 8, 0, 0, 8 * i, b" " * 52) for i, (n, kind) in enumerate(names))
    data = b"".join(ibm(v) if kind == 1 else v.ljust(8).encode("latin-1") for r in rows for v, (_, kind) in zip(r, names))
    pad = lambda b: b + b" " * (-len(b) % 80)
    return out + pad(fields) + head("OBS") + pad(data)


def test_transport_files(spark, tmp_path):
    rows = [(1.0, "ab", -2.5), (2.0, "\xe9t\xe9", 0.0), (3.0, "", 1234.0625)] + [(float(i), "x", i / 8) for i in range(4, 20)]
    (tmp_path / "t.xpt").write_bytes(transport_file([("seqn", 1), ("name", 2), ("v", 1)], rows))
    got = tables.xport(spark, str(tmp_path / "t.xpt"), "SEQN double, NAME string, V double, NONE double").collect()
    assert [(r.SEQN, r.NAME or "", r.V) for r in got] == rows and all(r.NONE is None or r.NONE != r.NONE for r in got)
