"""Keys that a third of all rows or more have: joins that split them, counts that stay small, bounded models."""

import numpy as np
import pytest
from gaugespark.llm import common, mixing, near_dedup, quality, queries, url_filters
from pyspark.sql import functions as F

SETTINGS = {
    "adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
    "adaptive.skewJoin.skewedPartitionFactor": "1.2",
    "adaptive.advisoryPartitionSizeInBytes": "4k",
    "adaptive.coalescePartitions.enabled": "false",
    "autoBroadcastJoinThreshold": "-1",
    "adaptive.autoBroadcastJoinThreshold": "-1",
    "shuffle.partitions": "8",
}


@pytest.fixture
def splitting(spark):
    """Adaptive execution that splits small partitions too."""
    before = {k: spark.conf.get(f"spark.sql.{k}", None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(f"spark.sql.{k}", v)
    yield
    for k, v in before.items():
        spark.conf.unset(f"spark.sql.{k}") if v is None else spark.conf.set(f"spark.sql.{k}", v)


@pytest.fixture
def plans(monkeypatch):
    """The executed plans of the tables that a module stores, by name."""
    seen = []

    def of(module):
        def recorded(df, name):
            df.collect()
            seen.append((name, df._jdf.queryExecution().executedPlan().toString()))
            return common.stored(df, name)

        monkeypatch.setattr(module, "stored", recorded)
        return seen

    return of


def test_a_hot_star_is_split(spark, splitting, plans):
    seen = plans(near_dedup)
    star = spark.range(1, 8000, 1, 8).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    # the centre is not the smallest, so its edges move
    edges = star.select((F.col("a") + 100000).alias("a"), "b")
    got = near_dedup.components(edges).collect()
    assert {r.comp for r in got} == {1} and len(got) == 7999
    assert any(name == "edges" and "skew=true" in plan for name, plan in seen)


def test_a_hot_host_is_split_in_every_round(spark, splitting, plans):
    seen = plans(url_filters)
    n = F.col("id")
    path = F.concat(F.lit("a"), n % 40, F.lit("/"), F.when(n % 2 == 0, "bad").otherwise("good"), F.lit("/x"), F.translate(n.cast("string"), "0123456789", "abcdefghij"))
    tree = spark.range(0, 6000, 1, 8).select(F.when(n % 3 > 0, "hot.org").otherwise(F.concat(F.lit("h"), n)).alias("host"), path.alias("raw"), (n % 2).alias("good"), ((n + 1) % 2).alias("bad"))
    assert url_filters.merged_templates(common.stored(tree, "tree")).count() == 6000
    rounds = [plan for name, plan in seen if name == "branches"]
    assert len(rounds) >= 2 and all("skew=true" in plan for plan in rounds[:2])


def test_rows_without_id_are_counted_before_they_are_placed(spark):
    n = F.col("id")
    docs = spark.range(0, 30000, 1, 8).select(F.when(n % 3 > 0, n).alias("doc_id"), F.repeat(F.lit("w "), (n % 5).cast("int")).alias("text"), F.lit("s").alias("source"))
    rows = mixing.mix(docs)
    assert rows.count() == 30000
    assert rows.agg(F.sum("taken")).first()[0] == rows.agg(F.floor(F.max("target"))).first()[0]
    windows = [line for line in rows._jdf.queryExecution().executedPlan().toString().splitlines() if "Window" in line]
    assert windows
    half = rows.where("doc_id is null and size > 0 and taken > 0")
    assert half.agg(F.max(F.col("taken") / F.col("size"))).first()[0] <= 2


def test_a_model_is_of_distinct_documents(spark):
    texts = [(i, f"Clean prose number {i} about rivers and towns." if i % 2 else f"BUY!!! {i} $$$ NOW <<>> {i}{i}{i}") for i in range(300)]
    docs = spark.createDataFrame(texts + [(7, texts[7][1])] * 500 + [(8, f"Other text {k}") for k in range(200)], "doc_id long, text string")
    rows = [(i, i % 2) for i in range(300)] + [(9, 1)] * 3000 + [(10, 0), (10, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    model = quality.fit(docs, labels, F.lit(True), per_class=100)
    assert len(model["labels"]) == 200 and model["labels"].sum() == 100
    whole = quality.fit(docs, labels, F.lit(True))
    assert len(whole["labels"]) == 299  # 10 is labelled both ways


def test_query_of_quality_by_votes_one_by_one(spark, sf):
    """op1's scores equal votes worked out a document at a time from its own model."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels, ~quality.held_out(F.col("doc_id")))
    got = {r.doc_id: r for r in queries.op1_quality_neighbours(spark, sf).collect()}
    for r in docs.select("doc_id", "text").collect():
        v = np.log1p(quality.term_counts(np.frombuffer((r.text or "").encode(), np.uint8))).astype(np.float32) @ model["weights"]
        v = v / max(np.linalg.norm(v), 1e-12)
        near = sorted(((round(float(v @ k), 6), float(y)) for k, y in zip(model["vectors"], model["labels"])), reverse=True)
        votes = [(c**quality.SHARPNESS, y) for c, y in near if c > 0 and c >= near[min(quality.NEIGHBOURS, len(near)) - 1][0]]
        want = sum(w * y for w, y in votes) / sum(w for w, _ in votes) if votes else float(model["labels"].mean())
        assert got[r.doc_id].score == pytest.approx(want, abs=2e-3)
        assert got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.5)
