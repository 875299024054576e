"""Token counts by trie-shared dynamic programming over a unigram vocabulary.

A text is split into pre-tokens at white space. The distinct pre-tokens of a
batch go, sorted, into tries of bounded size, worked out level by level: a node
keeps the best score of any segmentation of its prefix and its number of tokens,
so that a prefix which many pre-tokens share is scored once; where a pre-token
ends, its count is kept for all its occurrences. A node also has its live
matches: the places of the vocabulary's own trie that some suffix of the prefix
leads to, each with the score of what stands before that suffix. One more
character moves the live matches on and drops those that no piece continues.

Scores: the vocabulary file gives ranks but no probabilities, so a piece of
rank r scores -ln(r + 2.7), as Zipf's law has it. Characters that no piece
covers fall back to bytes, each a token of the lowest score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugespark.llm.common import pinned

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Pre-tokens in one trie, the longest that goes into it, and counts kept from batch to batch.
MAX_WORDS, MAX_SHARED, MAX_KNOWN = 1 << 16, 64, 1 << 18
_POINT_BITS = 21


def load_scores(path: str = VOCABULARY) -> dict[str, float]:
    """piece -> score, from a SentencePiece model file (bounded by its vocabulary)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    normal = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i))]
    return {model.id_to_piece(i): -math.log(rank + 2.7) for rank, i in enumerate(normal)}


class Vocabulary:
    """The trie of the pieces: its steps by (place, character), and the score of the piece at each place."""

    def __init__(self, scores: dict[str, float]):
        self.steps: dict[int, int] = {}
        ends: dict[int, float] = {}
        for piece, score in scores.items():
            place = 0
            for c in piece:
                place = self.steps.setdefault(place << _POINT_BITS | ord(c), len(self.steps) + 1)
            ends[place] = score
        self.fallback = min(scores.values(), default=0.0) - 10
        self.score = np.full(len(self.steps) + 1, -np.inf)
        self.score[list(ends)] = list(ends.values())
        self.keys = np.array(sorted(self.steps), np.int64)
        self.targets = np.array([self.steps[k] for k in self.keys.tolist()], np.int64)

    def moved(self, places: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The place that a character leads to from each place; -1 for none."""
        if not len(self.keys):
            return np.full(len(places), -1)
        asked = places << _POINT_BITS | chars
        at = np.searchsorted(self.keys, asked)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == asked, self.targets[at], -1)

    def count_alone(self, token: str) -> int:
        """The tokens of one pre-token of any length, character by character."""
        live: list[tuple[int, float, int]] = []
        score, n = 0.0, 0
        for c in token:
            point = ord(c)
            size = int(_utf8_size(point))
            best, ahead = (score + size * self.fallback, n - size), []
            for place, before, tokens in (*live, (0, score, n)):
                place = self.steps.get(place << _POINT_BITS | point)
                if place is not None:
                    ahead.append((place, before, tokens))
                    best = max(best, (before + float(self.score[place]), tokens - 1))
            live, (score, n) = ahead, best
        return -n


def _utf8_size(points):
    return 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)


class Trie:
    """The trie of sorted distinct pre-tokens: `counts` has the tokens of each, `nodes` the prefixes scored."""

    def __init__(self, tokens: Sequence[str], vocabulary: Vocabulary):
        self.vocabulary, self.nodes = vocabulary, 0
        lengths = np.array([len(t) for t in tokens], np.int64)
        self.counts = np.zeros(len(tokens), np.int64)
        if not lengths.any():
            return
        points = np.array(tokens, f"U{lengths.max()}").view(np.uint32).reshape(len(tokens), -1).astype(np.int64)
        inside = np.arange(points.shape[1]) < lengths[:, None]
        marked = np.where(inside, points, -1)
        differ = marked[1:] != marked[:-1]
        #: the first character in which a pre-token differs from the one before
        fresh = np.concatenate([[0], np.where(differ.any(axis=1), differ.argmax(axis=1), points.shape[1])])
        self._fill(points, lengths, fresh)

    def _fill(self, points: np.ndarray, lengths: np.ndarray, fresh: np.ndarray) -> None:
        v = self.vocabulary
        node_of = np.zeros(len(lengths), np.int64)
        score, n = np.zeros(1), np.zeros(1, np.int64)
        # live matches in order of their nodes; each node has the empty one, last
        first, many = np.zeros(1, np.int64), np.ones(1, np.int64)
        places, before, tokens = np.zeros(1, np.int64), score, n
        for level in range(points.shape[1]):
            begins = np.flatnonzero((fresh <= level) & (lengths > level))
            parents, chars = node_of[begins], points[begins, level]
            self.nodes += len(begins)
            width = many[parents]
            starts = np.cumsum(width) - width
            at = np.repeat(first[parents] - starts, width) + np.arange(int(width.sum()))
            ahead = v.moved(places[at], np.repeat(chars, width))
            found = np.where(ahead >= 0, before[at] + v.score[ahead], -np.inf)
            size = _utf8_size(chars)
            alone, least = score[parents] + size * v.fallback, n[parents] - size
            best = np.maximum(np.maximum.reduceat(found, starts), alone)
            ours = np.maximum.reduceat(np.where(found == np.repeat(best, width), tokens[at] - 1, np.iinfo(np.int64).min), starts)
            score, n = best, np.maximum(ours, np.where(alone == best, least, np.iinfo(np.int64).min))
            stays = ahead >= 0
            many = np.add.reduceat(stays.astype(np.int64), starts) + 1
            first = np.cumsum(many) - many
            ends = first + many - 1
            kept = np.ones(int(many.sum()), bool)
            kept[ends] = False
            places, carried, spent = np.zeros(len(kept), np.int64), np.empty(len(kept)), np.empty(len(kept), np.int64)
            places[kept], carried[kept], spent[kept] = ahead[stays], before[at][stays], tokens[at][stays]
            carried[ends], spent[ends] = score, n
            before, tokens = carried, spent
            node_of = np.cumsum((fresh <= level) & (lengths > level)) - 1
            done = np.flatnonzero(lengths == level + 1)
            self.counts[done] = -n[node_of[done]]


def counted(tokens: Sequence[str], vocabulary: Vocabulary) -> Iterator[tuple[str, int]]:
    """(pre-token, tokens of its best segmentation; of equal ones, the shortest) of distinct pre-tokens."""
    ordered = sorted(tokens)
    shared = [t for t in ordered if len(t) <= MAX_SHARED]
    for at in range(0, len(shared), MAX_WORDS):
        part = shared[at : at + MAX_WORDS]
        yield from zip(part, Trie(part, vocabulary).counts.tolist())
    for t in ordered:
        if len(t) > MAX_SHARED:
            yield t, vocabulary.count_alone(t)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_words, n_tokens: a row for each row of docs.

    Words are what white space (as Unicode has it) separates; each is counted
    with the mark of a word's beginning before it. Null and empty texts have no
    tokens. Pre-tokens over MAX_SHARED characters are scored by themselves,
    whole. Repeated rows count alike; other columns are ignored.
    """
    shared = pinned(docs.sparkSession, load_scores(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, known = Vocabulary(shared.value), {}
        for batch in batches:
            distinct: set[str] = set()
            for text in batch.column(1):
                distinct.update((text.as_py() or "").split())
            if len(known) > MAX_KNOWN:
                known.clear()
            for token, n in counted([MARK + w for w in distinct.difference(known)], pieces):
                known[token[1:]] = n
            words, tokens = [], []
            for text in batch.column(1):
                found = (text.as_py() or "").split()
                words.append(len(found))
                tokens.append(sum(map(known.__getitem__, found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
