"""Quality, token counts, decontamination and fingerprints against brute force."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from gaugespark.llm import decontamination, fingerprints, quality, registry, token_counts

VIEW = lambda t: np.frombuffer((t or "").encode(), np.uint8)


# quality


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = registry.QUERIES["op1_quality_neighbours"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    for k in (0, 1):
        own = [r for r in rows if r.quality == k]
        assert sum(r.predicted == k for r in own) >= 0.9 * len(own)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_quality_edges(spark, edge, edge_rows, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (11, 0, 0), (12, 0, 0), (None, 1, 0), (7, None, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    rows = quality.quality_scores(edge, labels).collect()
    assert len(rows) == len(edge_rows)
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    assert quality.quality_scores(empty, labels).count() == 0
    assert {r.score for r in quality.quality_scores(edge, labels.limit(0)).collect()} == {0.5}
    assert quality.kept(edge, None).count() == len(edge_rows)


def test_votes_are_exact_cosines():
    rng = np.random.default_rng(3)
    known = rng.standard_normal((400, 12)).astype(np.float32)
    known /= np.linalg.norm(known, axis=1, keepdims=True)
    model = {"vectors": known, "labels": rng.integers(0, 2, 400).astype(np.float32)}
    asked = rng.standard_normal((50, 12)).astype(np.float32)
    got = quality.votes(asked, model)
    for i, v in enumerate(asked):
        cos = sorted(((float(v @ k) / float(np.linalg.norm(v)), y) for k, y in zip(known, model["labels"])), reverse=True)[: quality.NEIGHBOURS]
        weight = [max(c, 0) ** quality.SHARPNESS for c, _ in cos]
        assert got[i] == pytest.approx(sum(w * y for w, (_, y) in zip(weight, cos)) / sum(weight), abs=1e-4)


def test_terms_do_not_depend_on_blocks(monkeypatch):
    text = VIEW("Aé b! " * 500 + "\nXX yy 12")
    whole = quality.term_counts(text)
    monkeypatch.setattr(quality, "_STEP", 7)
    assert (quality.term_counts(text) == whole).all()


# token counts


def plain_count(token, scores, fallback, longest=10**6):
    best = [(0.0, 0)]
    for upto in range(1, len(token) + 1):
        size = len(token[upto - 1].encode())
        options = [(best[upto - 1][0] + size * fallback, best[upto - 1][1] - size)]
        options += [(best[i][0] + scores[token[i:upto]], best[i][1] - 1) for i in range(max(0, upto - longest), upto) if token[i:upto] in scores]
        best.append(max(options))
    return -best[-1][1]


def test_token_counts_equal_plain_programming(monkeypatch):
    scores = {p: -math.log(r + 2.7) for r, p in enumerate(["▁", "a", "b", "ab", "▁a", "ba", "abab", "é", "c", "▁abc"])}
    rng = random.Random(2)
    tokens = {"▁" + "".join(rng.choice("aabbcé☃\0") for _ in range(rng.randrange(0, 90))) for _ in range(400)} | {"▁ab", "▁ab\0", "▁"}
    pieces = token_counts.Vocabulary(scores)
    for words in (token_counts.MAX_WORDS, 7):
        monkeypatch.setattr(token_counts, "MAX_WORDS", words)
        got = dict(token_counts.counted(tokens, pieces))
        assert got == {t: plain_count(t, scores, pieces.fallback) for t in tokens}
    assert all(pieces.count_alone(t) == n for t, n in got.items())
    assert list(token_counts.counted([], pieces)) == []


def test_trie_scores_each_prefix_once():
    trie = token_counts.Trie(sorted({"abab", "abaa", "aba", "b"}), token_counts.Vocabulary({"a": -1.0, "ab": -1.5, "b": -4.0}))
    assert trie.nodes == len({"a", "ab", "aba", "abab", "abaa", "b"})
    assert trie.counts.tolist() == [2, 3, 2, 1]


def test_token_count_rows(spark, edge, edge_rows, empty):
    rows = {r.doc_id: r for r in token_counts.token_counts(edge).collect() if r.doc_id is not None}
    scores = token_counts.load_scores()
    fallback = token_counts.Vocabulary(scores).fallback
    known = {w: plain_count("▁" + w, scores, fallback, max(map(len, scores))) for w in {w for r in edge_rows for w in (r[1] or "").split()}}
    for r in edge_rows:
        if r[0] is not None:
            words = (r[1] or "").split()
            assert (rows[r[0]].n_words, rows[r[0]].n_tokens) == (len(words), sum(known[w] for w in words))
    assert token_counts.token_counts(empty).count() == 0


def test_token_counts_of_small_tables(spark, sf):
    scores = token_counts.load_scores()
    pieces, longest = token_counts.Vocabulary(scores), max(map(len, scores))
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    known = {}
    for r in registry.QUERIES["op2_token_counts"](spark, sf).collect():
        words = docs[r.doc_id].split()
        for w in set(words) - set(known):
            known[w] = plain_count("▁" + w, scores, pieces.fallback, longest)
        assert (r.n_words, r.n_tokens) == (len(words), sum(known[w] for w in words))


# decontamination


def least(item, text):
    """The least edit distance of item to any part of text, by the full matrix."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(row[j - 1] + (c != d), row[j] + 1, now[j - 1] + 1))
        row = now
    return min(row)


def edited(rng, text, n):
    text = list(text)
    for _ in range(n):
        at = rng.randrange(len(text))
        text[at : at + 1] = rng.choice(["", "z", "z" + text[at]])
    return "".join(text)


def test_matches_equal_the_full_matrix():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randrange(4, 30)))) for i in range(25)]
    matcher = decontamination.Matcher(items, 0.05)
    hits = 0
    for _ in range(60):
        _, item = rng.choice(items)
        noise = [" ".join(word() for _ in range(20)) for _ in range(2)]
        text = noise[0] + " " + edited(rng, item, rng.randrange(0, 8)) + " " + noise[1]
        got = {i: d for i, d, _ in matcher.find(text)}
        want = {i: d for i, t in items if (d := least(t, decontamination.normalised(text))) <= decontamination.budget(t)}
        assert got == want
        hits += len(want)
    assert hits > 20


def test_contaminations(spark, edge, edge_rows, empty):
    benchmark = spark.createDataFrame([(1, "ALPHA beta  gamma delta epsilon zeta eta theta iota kapa lambda"), (2, None), (3, " "), (None, "word"), (4, "line number 3 of twenty line number 4 of twenty"), (4, "something else that is nowhere to be found")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontamination.contaminations(edge, benchmark).collect()}
    assert got == {**{(d, 1): 1 for d in (1, 2, 3, None)}, **{(d, 4): 0 for d in (20, 21, 22)}}
    clean = decontamination.clean(edge, benchmark)
    assert clean.columns == edge.columns
    assert sorted(r.doc_id or 0 for r in clean.collect()) == sorted(r[0] or 0 for r in edge_rows if r[0] not in (1, 2, 3, 20, 21, 22) and (r[0] or not r[1]))
    assert decontamination.contaminations(empty, benchmark).count() == 0
    assert decontamination.contaminations(edge, benchmark.limit(0)).count() == 0


def test_items_in_several_blocks(spark, sf, monkeypatch):
    docs, benchmark = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = {tuple(r) for r in decontamination.contaminations(docs, benchmark).collect()}
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 3000)
    assert {tuple(r) for r in decontamination.contaminations(docs, benchmark).collect()} == whole
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {(d, i) for d, t in texts.items() for i, x in ((r.item_id, r.text) for r in benchmark.collect()) if x in t} <= {w[:2] for w in whole}


# fingerprints


def test_peeling_is_exact():
    rng = np.random.default_rng(1)
    fresh = lambda n: fingerprints.mix(rng.integers(0, 2**63, n).astype(np.uint64))
    for _ in range(300):
        left = np.unique(fresh(int(rng.integers(0, 300))))
        right = np.sort(np.concatenate([rng.permutation(left)[: int(rng.integers(0, len(left) + 1))], fresh(int(rng.integers(0, 200)))]))
        ours, theirs = fingerprints.difference(left, right)
        assert set(ours.tolist()) == set(left.tolist()) - set(right.tolist())
        assert set(theirs.tolist()) == set(right.tolist()) - set(left.tolist())


def check_fingerprints(docs, rows):
    key = lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or "")
    ordered = sorted(rows, key=key)
    want = []
    for k, (d, t) in enumerate(ordered):
        t, following = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        third = len(t) // 3
        new = t[: len(t) - third] + following[:third]
        sets = [set(fingerprints.digests(VIEW(x)).tolist()) for x in (t, new, following)]
        like = [len(sets[0] & s) / len(sets[0] | s) if sets[0] | s else 1.0 for s in sets[1:]]
        want.append((d, len(t), hashlib.sha256(new.encode()).hexdigest(), fingerprints.fingerprint_text(VIEW(t)), fingerprints.fingerprint_text(VIEW(new)), *like))
    got = [tuple(r) for r in fingerprints.edited_fingerprints(docs).collect()]
    order = lambda r: (r[0] or -1, r[2])
    assert sorted(got, key=order) == sorted(want, key=order)


def test_fingerprints_of_edges(edge, edge_rows, empty):
    check_fingerprints(edge, [(r[0], r[1]) for r in edge_rows])
    assert fingerprints.edited_fingerprints(empty).count() == 0


def test_fingerprints_of_one_row(edge):
    one = edge.where("doc_id = 1")
    check_fingerprints(one, [(r.doc_id, r.text) for r in one.collect()])


def test_fingerprints_of_small_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check_fingerprints(docs, [(r.doc_id, r.text) for r in docs.collect()])
