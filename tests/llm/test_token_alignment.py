import hashlib
import os
from collections import Counter

import pytest

from gaugespark.llm import queries
from gaugespark.llm import token_alignment as ta

pytestmark = pytest.mark.skipif(not os.path.exists(ta.VOCABULARIES), reason="no vocabulary files")
ODD = [
    "<|endoftext|> and <s> </s> <unk> <0x0A> stay text",
    "two  spaces   three \t tab\n\n line\r\nend ",
    " leading, trailing ",
    "naïve café Straße 東京タワー は高い ½ ﬁ  x y ́z é",
    "▁ mark",
    "x\x1cy \x1c z\x85 q \x85r ᠎ s",
    "😀 emoji 👩‍👩‍👧 family",
    "it's we'll they'd 1234567 3.14 $%^ don't",
    "\x00nul \x00",
    "a" * 500 + " " + "b" * 40,
    "﻿bom",
]


@pytest.fixture(scope="module")
def tokenizers():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{ta.VOCABULARIES}/{ta.BYTE_BPE}")
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=f"{ta.VOCABULARIES}/{ta.PIECE_BPE}")


def tokens(tokenizers, text):
    """Ids and ends of both token streams of a whole text, or none."""
    a, b = tokenizers
    if not text:
        return [], []
    byte = ta._byte_of_char()
    one = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    two = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    if not b"".join(t for _, t in one) == b"".join(t for _, t in two) == (" " + text).encode():
        return [], []
    out = []
    for stream in (one, two):
        at, ends = 0, []
        for i, t in stream:
            at += len(t)
            ends.append((i, at))
        out.append(ends)
    return out


def groups(one, two):
    both = sorted({e for _, e in one} & {e for _, e in two})
    out, low = [], 0
    for high in both:
        out.append(([i for i, e in one if low < e <= high], [i for i, e in two if low < e <= high]))
        low = high
    return out


def brute(tokenizers, rows):
    every = [(d, *tokens(tokenizers, t)) for d, t in rows]
    found = [(d, a, b, groups(a, b)) for d, a, b in every]
    count = Counter((g[0][-1], g[1][-1]) for *_, gs in found for g in gs)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    for d, a, b, gs in found:
        links = [(g[0][-1], g[1][-1]) for g in gs]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in gs)
        yield (d, len(a), len(b), len(gs), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), text)


def check(spark, tokenizers, docs, rows):
    key = lambda r: tuple(str(x) for x in r)
    got = ta.token_alignments(docs).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(tokenizers, rows), key=key)


def test_edges(spark, edge, edge_rows, tokenizers, monkeypatch):
    monkeypatch.setattr(ta, "SLICE", 400)
    check(spark, tokenizers, edge, [(r[0], r[1]) for r in edge_rows])


def test_odd_texts(spark, tokenizers):
    rows = list(enumerate(ODD))
    check(spark, tokenizers, spark.createDataFrame(rows, "doc_id long, text string").repartition(2), rows)


def test_empty(spark, empty):
    assert ta.token_alignments(empty).count() == 0


def test_query(spark, sf, tokenizers):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = {r[0]: r for r in brute(tokenizers, rows)}
    for r in queries.op13_token_alignment(spark, sf).collect():
        w = want[r.doc_id]
        assert tuple(r)[:7] == w[:7]
        assert r.groups_sha256 == (hashlib.sha256(w[7].encode()).hexdigest() if w[1] else "")


def test_forgetting_and_bound(tokenizers, monkeypatch):
    known = ta._Aligner(ta.VOCABULARIES)
    monkeypatch.setattr(ta, "REMEMBERED", 3)
    for text in ODD:
        n_a, n_b, n_groups, _, _ = ta._aligned_slice(known, [text.split(" ")[:2], []])
        assert n_a[1] == n_b[1] == n_groups[1] == 0
    assert ta.pair_bound(known.a.tokens, known.b.tokens) < 1_000_000
