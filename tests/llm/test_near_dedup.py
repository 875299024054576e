import random
import re
from collections import defaultdict

from gaugespark.llm import near_dedup

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets(rows, n):
    out = defaultdict(list)
    for d, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOW))
        size = min(n, len(w))
        out[d].append(frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if w else frozenset())
    return out


def brute(rows, n, percent=80):
    found = sets([r for r in rows if r[0] is not None], n)
    root = {d: d for d in found}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(found)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            for x in found[a]:
                for y in found[b]:
                    if x and y and 100 * len(x & y) >= percent * len(x | y):
                        p, q = top(a), top(b)
                        root[max(p, q)] = min(p, q)
    return {d: top(d) for d in ids}


def check(spark, docs, rows, n):
    got = near_dedup.near_duplicates(docs, n, 80).collect()
    want, shingled = brute(rows, n), sets(rows, n)
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == want.get(r.doc_id)
        assert r.kept == (r.doc_id == r.component_id)
        assert r.n_shingles in {len(s) for s in shingled[r.doc_id]}
    return want


def test_edges(spark, edge, edge_rows):
    check(spark, edge, [(r[0], r[1]) for r in edge_rows], 2)
    check(spark, edge, [(r[0], r[1]) for r in edge_rows], 5)


def test_empty(spark, empty):
    assert near_dedup.near_duplicates(empty).count() == 0


def test_generated(spark):
    """Chains of edits, where some members are far from their group's smallest."""
    rng = random.Random(5)
    rows = []
    for g in range(25):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([6, 30, 120]))]
        for _ in range(rng.randrange(1, 14)):
            rows.append((len(rows), " ".join(words)))
            for _ in range(max(1, len(words) // 20)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(400)}"
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = check(spark, docs, rows, 2)
    assert 25 <= len(set(want.values())) < len(rows)


def test_small_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(spark, docs, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 2)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (101, 103)] + [(200, 200 + i) for i in range(1, 50)]
    got = {r.id: r.comp for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in (101, 102, 103)}, **{200 + i: 200 for i in range(1, 50)}}
