"""Each stage of the pipeline against brute force on its own input."""

import re
import sys
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parent))
import corpus_pipeline  # noqa: E402
from gaugespark.llm import decontamination, mixing, quality, sharding  # noqa: E402
from test_near_dedup import brute  # noqa: E402

VIEW = lambda t: np.frombuffer((t or "").encode(), np.uint8)


def rejected_by_votes(spark, docs, rows, sf):
    """doc_ids whose neighbours, found one cosine at a time, vote them under one half."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels, ~quality.held_out(F.col("doc_id")))
    out = set()
    for r in rows:
        v = np.log1p(quality.term_counts(VIEW(r.text))).astype(np.float32) @ model["weights"]
        v = v / max(np.linalg.norm(v), 1e-12)
        near = sorted(((round(float(v @ k), 6), y) for k, y in zip(model["vectors"], model["labels"])), reverse=True)
        last = near[min(quality.NEIGHBOURS, len(near)) - 1][0]
        voting = [(c**quality.SHARPNESS, y) for c, y in near if c >= last and c > 0]
        score = sum(w * y for w, y in voting) / sum(w for w, _ in voting) if voting else model["labels"].mean()
        if abs(score - 0.5) > 1e-4 and score < 0.5:
            out.add(r.doc_id)
    return out


def least(item, text):
    """The least edit distance of item to any part of text, by the full matrix."""
    places, codes = np.arange(len(text) + 1), np.array([ord(c) for c in text])
    row = np.zeros(len(text) + 1, np.int64)
    for i, c in enumerate(item, 1):
        now = np.concatenate([[i], np.minimum(row[:-1] + (codes != ord(c)), row[1:] + 1)])
        row = np.minimum.accumulate(now - places) + places
    return int(row.min())


def contaminated(rows, items):
    known = [t for t in (decontamination.normalised(i.text or "") for i in items) if t]
    out = set()
    grams = lambda t: [t[i : i + 6] for i in range(len(t) - 5)]
    for r in rows:
        text = decontamination.normalised(r.text or "")
        own = set(grams(text))
        # k edits spoil at most 6 k runs of six characters, so fewer runs in common need no matrix
        near = [t for t in known if sum(g in own for g in grams(t)) >= len(grams(t)) - 6 * decontamination.budget(t)]
        if any(least(t, text) <= decontamination.budget(t) for t in near):
            out.add(r.doc_id)
    return out


def in_sql(sql, docs, path):
    docs.write.parquet(str(path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return [dict(zip(names, r)) for r in cursor.fetchall()]


def test_stages_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    outs = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.stored(stage(spark, docs, sf), name)
        rows, kept = docs.collect(), out.collect()
        before, after = {r.doc_id for r in rows}, Counter(r.doc_id for r in kept)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
            assert {tuple(r) for r in kept} <= {tuple(r) for r in rows}
        if name == "quality":
            assert before - set(after) == rejected_by_votes(spark, docs, rows, sf)
            good, bad = ({d for d in before if labels.get(d) == q} for q in (1, 0))
            assert len(good & set(after)) >= 0.95 * len(good) and len(bad & set(after)) <= 0.3 * len(bad)
        elif name == "near-dedup":
            groups = brute([(r.doc_id, r.text) for r in rows], 5)
            assert set(after) == set(groups.values())
        elif name == "decontamination":
            assert before - set(after) == contaminated(rows, spark.read.parquet(f"{sf}/benchmark.parquet").collect())
        elif name == "mixing":
            want = Counter()
            for r in in_sql(mixing.ORACLE, docs, tmp_path / "mixing"):
                if r["size"]:
                    want[r["doc_id"]] += int(np.floor(r["taken"] / r["size"] + 0.5))
            assert after == +want
        else:
            want = Counter((r["doc_id"], r["shard"], r["virtual_slot"]) for r in in_sql(sharding.ORACLE, docs, tmp_path / "sharding"))
            assert Counter((r.doc_id, r.shard, r.virtual_slot) for r in kept) == want
        outs[name] = after
        docs = out
    assert sum(outs["sharding"].values()) == sum(outs["mixing"].values())
    assert all(re.match("quality|near-dedup|decontamination|mixing|sharding", n) for n in outs)


def test_run_on_empty_and_null_rows(spark, edge, tmp_path):
    edge.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (11, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing that is here at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).columns[:5] == edge.columns[:5]
    none = tmp_path / "none"
    edge.limit(0).write.parquet(f"{none}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{t}.parquet").write.parquet(f"{none}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(none)).count() == 0
