import hashlib
import random
import zlib

import numpy as np
import pytest

from gaugespark.llm import periodic_runs as pr
from gaugespark.llm import queries


def brute(words, min_length=6, min_exponent=4):
    """(start, length, period) by every period and place."""
    n, found = len(words), {}
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(min_length, min_exponent * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def words_of(text):
    return (text or "").encode().split()


@pytest.mark.parametrize("seed", range(8))
def test_runs_of_generated_words(seed):
    rng = random.Random(seed)
    for _ in range(60):
        docs = []
        for _ in range(rng.randrange(1, 5)):
            words = []
            for _ in range(rng.randrange(0, 6)):
                piece = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(1, 7))]
                words += (piece * rng.randrange(1, 9))[: rng.randrange(1, 60)]
            docs.append([str(w).encode() for w in words])
        ids, begins = pr._numbered(docs)
        low, exponent = rng.choice([(6, 4), (2, 2), (1, 3)])
        start, length, period = pr.maximal_runs(ids, low, exponent) if len(ids) else [np.zeros(0, int)] * 3
        got = sorted(zip(start.tolist(), length.tolist(), period.tolist()))
        want = sorted((s + int(b), n, q) for words, b in zip(docs, begins) for s, n, q in brute(words, low, exponent))
        assert got == want


def test_thue_morse_has_no_long_run():
    words = [bin(i).count("1") % 2 for i in range(1 << 12)]
    start, _, _ = pr.maximal_runs(np.array(words), 1, 3)
    assert not len(start)


def test_blocks_of_leaves(monkeypatch):
    ids = np.array([0, 1, 2, 0, 1, 2, 0, 1, 2, 0, 1, 2, 0, 3, 3, 3, 3, 3, 3, 3])
    want = [x.tolist() for x in pr.maximal_runs(ids, 6, 4)]
    monkeypatch.setattr(pr, "_ASKED", 3)
    assert [x.tolist() for x in pr.maximal_runs(ids, 6, 4)] == want == [[0, 13], [13, 7], [3, 1]]


def test_edges(spark, edge, edge_rows, monkeypatch):
    monkeypatch.setattr(pr, "BLOCK", 50)
    got = pr.periodic_runs(edge).collect()
    want = sorted((str(r[0]), [tuple(x) for x in brute(words_of(r[1]))], collapsed([w.decode() for w in words_of(r[1])], brute(words_of(r[1])))) for r in edge_rows)
    assert sorted((str(r.doc_id), [tuple(x) for x in r.runs], r.collapsed) for r in got) == want
    assert {r.n_words for r in got if r.doc_id == 12} == {9000}


def test_empty(spark, empty):
    assert pr.run_digests(pr.periodic_runs(empty, order=pr.looped_order)).count() == 0


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    looped = 0
    for r in queries.op11_periodic_runs(spark, sf).collect():
        words, h = words_of(docs[r.doc_id]), zlib.crc32(str(r.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a, looped = g % n, looped + 1
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        text = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed([w.decode() for w in words], runs).encode()).hexdigest()
    assert looped > 5
