"""Weights of digests as matrices, and sums over draws, against the same as columns and rows."""

import re
from hashlib import md5

from pyspark.sql import functions as F

from gaugespark.operators import resampling


def spread(cells, unit, keys, sums, draws):
    """The same sums from a row for each cell and draw."""
    rows = resampling.over_draws(cells, unit, draws, resampling.digest_weight)
    return rows.groupBy("draw", *keys).agg(F.sum("_w").cast("double").alias("_t"), *[F.sum(F.col("_w") * F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in sums])


def test_counts_are_those_of_the_column(spark):
    units = [None, "", "1", "22", "é5", "x" * 49, "x" * 52, "x" * 55, "x" * 200, "-17"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(units)], "i int, u string").crossJoin(spark.range(1200).select(F.col("id").cast("int").alias("draw")))
    want = {(r.i, r.draw): r.w for r in df.select("i", "draw", resampling.digest_weight(F.col("u"), F.col("draw")).alias("w")).collect()}
    got = resampling.digest_counts(units, 1200)
    assert all(got[i, d] == w for (i, d), w in want.items())


def test_sums_and_nulls_and_many_keys(spark, monkeypatch):
    rows = [(i % 37 if i % 50 else None, f"g{i % 5}" if i % 7 else None, float("nan") if i % 3 == 0 else i % 2 * 1.0, i, None if i % 4 else i * 2) for i in range(400)]
    df = spark.createDataFrame(rows, "u long, g string, h double, a long, b long")
    cells = df.groupBy("u", "g", "h").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    for keys in (["g", "h"], []):
        got = resampling.drawn_sums(cells, "u", keys, ["a", "b"], 120, resampling.digest_weight)
        assert sorted(map(str, got.collect())) == sorted(map(str, spread(cells, "u", keys, ["a", "b"], 120).select(got.columns).collect()))
    assert resampling.drawn_sums(cells.limit(0), "u", [], ["a"], 120, resampling.digest_weight).count() == 0


def test_draws_are_no_rows(spark):
    """Cells meet 2000 draws inside a task: no plan node makes a row for each unit and draw."""
    cells = spark.range(300).select((F.col("id") % 100).alias("u"), F.col("id").alias("a"))
    plan = resampling.drawn_sums(cells, "u", [], ["a"], 2000, resampling.digest_weight)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan


def test_weights_are_worked_out_by_all_tasks(spark):
    """Few bytes of units are many digests: adaptive execution must not put them together again."""
    cells = spark.range(300).select((F.col("id") % 100).alias("u"), F.col("id").alias("a"))
    plan = resampling.drawn_sums(cells, "u", [], ["a"], 2000, resampling.digest_weight)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_weights_are_dealt_to_every_core(spark):
    """Fewer shuffle parts than cores must leave no core idle; the sums stay the same."""
    cells = spark.range(300).select((F.col("id") % 100).alias("u"), F.col("id").alias("a"))
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = resampling.drawn_sums(cells, "u", [], ["a"], 120, resampling.digest_weight)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"hashpartitioning\(.*, (\d+)\), REPARTITION_BY_NUM", plan)[1] == str(spark.sparkContext.defaultParallelism)
        assert sorted(map(str, got.collect())) == sorted(map(str, spread(cells, "u", [], ["a"], 120).select(got.columns).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_counts_wherever_unit_and_draw_meet_in_the_block():
    """Units of every size, several a block, one, and more than a block: words of the unit, of the draw, of both."""
    units = [str(7 * 10**k + i) for k in range(0, 52, 3) for i in range(3)]
    draws = [0, 9, 10, 99, 100, 999, 1000, 1999]
    bounds = resampling._poisson_bounds()
    want = [[sum(int(md5(f"{u}:{d}".encode()).hexdigest()[:8], 16) / 2**32 >= x for x in bounds) for d in draws] for u in units]
    assert resampling.digest_counts(units, 2000)[:, draws].tolist() == want
    assert resampling.digest_counts(units[:1], 2000)[:, draws].tolist() == want[:1]
