import random

import numpy as np
import pytest

from gaugespark.llm import heavy_light, queries
from tests.llm.test_near_dedup import brute, sets


def check(spark, docs, rows, n, percent):
    got = heavy_light.shingle_join(docs, n, percent).collect()
    want, shingled = brute(rows, n, percent), sets(rows, n)
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == want.get(r.doc_id)
        assert r.n_shingles in {len(s) for s in shingled[r.doc_id]}
    return want


def families(seed, sizes, groups=30, words=400):
    """Chains of edits: texts some of which are near their group's first."""
    rng, rows = random.Random(seed), []
    for _ in range(groups):
        text = [f"w{rng.randrange(words)}" for _ in range(rng.choice(sizes))]
        for _ in range(rng.randrange(1, 12)):
            rows.append((len(rows), " ".join(text)))
            at = rng.randrange(len(text))
            text[at : at + rng.randrange(2)] = [f"w{rng.randrange(words)}"] * rng.randrange(2)
            text = text or ["w"]
    rng.shuffle(rows)
    return rows


def test_edges(spark, edge, edge_rows):
    check(spark, edge, [(r[0], r[1]) for r in edge_rows], 4, 85)


def test_empty(spark, empty):
    assert heavy_light.shingle_join(empty).count() == 0


@pytest.mark.parametrize("words,percent,sizes", [(1, 60, [3, 5, 9]), (2, 80, [6, 14, 40]), (4, 85, [15, 30, 200])])
def test_families(spark, words, percent, sizes, monkeypatch):
    monkeypatch.setattr(heavy_light, "BLOCK", 3)
    rows = families(words, sizes, words=40 if words == 1 else 400)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = check(spark, docs, rows, words, percent)
    assert len(set(want.values())) < len(rows)


def test_passage_that_all_share(spark):
    """Texts of one passage and some words of their own: a key of all, and only some linked."""
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, passage + " " + " ".join(f"o{rng.randrange(4) if i % 3 else 1000 * i + j}" for j in range(rng.choice([4, 8, 20, 60])))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = check(spark, docs, rows, 2, 85)
    assert 1 < len(set(want.values())) < len(rows)


def test_light_and_heavy_give_the_same(spark, monkeypatch):
    """Any boundary gives the same links."""
    rows = families(9, [8, 12, 16, 30])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for light in (0, 9, heavy_light.SMALL):
        monkeypatch.setattr(heavy_light, "boundary", lambda *_, light=light: light)
        check(spark, docs, rows, 2, 80)


def test_subsets_meet_where_sets_are_linked():
    rng = np.random.default_rng(1)
    for _ in range(400):
        n, percent = int(rng.integers(1, 14)), int(rng.choice([60, 80, 85]))
        one = np.sort(rng.choice(30, n, replace=False)).astype(np.uint64)
        drop, add = rng.integers(0, 3, 2)
        two = np.union1d(one[drop:], rng.choice(np.arange(30, 60), add, replace=False).astype(np.uint64))
        if not len(two):
            continue
        shared = len(np.intersect1d(one, two))
        linked = 100 * shared >= percent * (len(one) + len(two) - shared)
        met = len(np.intersect1d(heavy_light.subset_keys(one, percent), heavy_light.subset_keys(two, percent))) > 0
        assert met or not linked
        assert len(heavy_light.subset_keys(one, percent)) == heavy_light.subset_count(n, percent)


def test_sketches_lose_no_link():
    rng = np.random.default_rng(2)
    for _ in range(300):
        one = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 300)), dtype=np.uint64))
        two = np.union1d(one[: len(one) - int(rng.integers(0, 1 + len(one) // 8))], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + len(one) // 8)), dtype=np.uint64))
        shared = len(np.intersect1d(one, two))
        if len(two) and 100 * shared >= 85 * (len(one) + len(two) - shared):
            x, y = heavy_light.sketch(one), heavy_light.sketch(two)
            size = min(len(x), len(y))
            assert heavy_light._may_link(len(one), heavy_light._folded(x, size), np.array([len(two)]), heavy_light._folded(y, size)[None], 85)[0]


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows, 4, 85)
    assert {r.doc_id: r.component_id for r in queries.op12_ngram_jaccard_join(spark, sf).collect()} == want


def test_boundary_and_blocks_are_the_same_for_any_table(spark):
    """Subsets grow with the table and no faster; keys of the same members are one."""
    assert heavy_light.boundary(85) == 13
    for percent in (60, 80, 85):
        light = heavy_light.boundary(percent)
        assert all(heavy_light.subset_count(n, percent) <= heavy_light.KEYS for n in range(1, light + 1))
    rows = [(key, i, i, 0) for key in (5, 6, 9) for i in range(4)] + [(7, i, i, 0) for i in range(3)]
    got = heavy_light._once(spark.createDataFrame(rows, "key long, id long, comp long, main long")).collect()
    assert sorted({r.key for r in got}) == [5, 7] and len(got) == 7
