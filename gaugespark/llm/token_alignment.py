"""Alignment of two tokenizers' tokens by the bytes that they cover.

The tokens of all documents of a slice of an Arrow batch are laid end to end
over one run of bytes, each document at its byte offset. Both token streams'
ends are counted by byte (one bincount each); where both have an end, both are
cut. Prefix sums of the counts and of the cuts, taken at the documents' offsets,
give each document its own numbers.

Texts are tokenized by units: a text is cut before a single space between a
character that is no white space and a letter, digit or sign. Neither tokenizer
has a token across such a place (byte-level BPE splits there first, and no piece
of the other has a space mark after another character), so units are tokenized
alone, each distinct one once in a while, and no long text is tokenized at once.

How often a pair of ids is linked in the whole corpus is counted in each task,
then summed. Two tokens that end together in a text are one the end of the
other, so the pairs are bounded by the two vocabularies alone (under 1e6 for
50,000 and 32,000 entries, see pair_bound); that table is broadcast.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugespark.llm.common import pinned, stored
from gaugespark.llm.textarrays import byte_views

#: Where the vocabulary files are on every machine.
VOCABULARIES = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of texts that are aligned at once (more only where one text is longer).
SLICE = 1 << 21
#: Distinct units whose tokens a task remembers.
REMEMBERED = 1 << 19
_CUT = re.compile(r"(?<=\S) (?=[!-~\w])")


def _byte_of_char() -> dict[str, int]:
    """Byte-level BPE's alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class _Vocabulary:
    """A tokenizer's token bytes by id, and the ids of texts."""

    def __init__(self, tokens: list[bytes], encode):
        self.tokens, self.encode = tokens, encode
        self.sizes = np.array([len(t) for t in tokens], np.int64)


def byte_bpe(path: str) -> _Vocabulary:
    """A byte-level BPE of a tokenizers file; it gets a space before each unit."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(path)
    known.encode_special_tokens = True  # their strings in a text are ordinary text
    byte, entries = _byte_of_char(), known.get_vocab()
    tokens = [b""] * (max(entries.values()) + 1)
    for entry, i in entries.items():
        tokens[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
    return _Vocabulary(tokens, lambda units: [e.ids for e in known.encode_batch_fast([" " + u for u in units], add_special_tokens=False)])


def piece_bpe(path: str) -> _Vocabulary:
    """A sentencepiece model with byte fallback; it puts the space before each unit itself."""
    from sentencepiece import SentencePieceProcessor

    known = SentencePieceProcessor(model_file=path)
    pieces = [known.id_to_piece(i) for i in range(known.get_piece_size())]
    tokens = [bytes([int(p[3:5], 16)]) if known.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    return _Vocabulary(tokens, lambda units: known.encode(units, num_threads=1))


class _Aligner:
    """Both tokenizers, and the tokens of the units that were met lately."""

    def __init__(self, folder: str):
        self.a, self.b = byte_bpe(f"{folder}/{BYTE_BPE}"), piece_bpe(f"{folder}/{PIECE_BPE}")
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.sound = np.zeros(0, bool)
        self.flat = [(np.zeros(0, np.int64), np.zeros(1, np.int64))] * 2

    def numbers(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The number of each unit of each text; new ones are tokenized first."""
        new = list(dict.fromkeys(u for units in texts for u in units if u not in self.known))
        if len(self.known) + len(new) > REMEMBERED and self.known:
            self.forget()
            new = list(dict.fromkeys(u for units in texts for u in units))
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            wanted, sound = [b" " + u.encode() for u in new], np.ones(len(new), bool)
            for side, vocabulary in enumerate((self.a, self.b)):
                ids = vocabulary.encode(new)
                given = [b"".join([vocabulary.tokens[i] for i in x]) for x in ids]
                if given != wanted:
                    sound &= np.fromiter(map(bytes.__eq__, given, wanted), bool, len(new))
                flat, begins = self.flat[side]
                many = np.fromiter(map(len, ids), np.int64, len(ids))
                self.flat[side] = np.append(flat, np.fromiter(chain.from_iterable(ids), np.int64, int(many.sum()))), np.append(begins, begins[-1] + np.cumsum(many))
            self.sound = np.append(self.sound, sound)
        return [np.fromiter(map(self.known.__getitem__, units), np.int64, len(units)) for units in texts]

    def tokens(self, units: np.ndarray, side: int) -> np.ndarray:
        """The ids of one tokenizer's tokens of units laid end to end."""
        flat, begins = self.flat[side]
        many = begins[units + 1] - begins[units]
        before = np.cumsum(many) - many
        return flat[np.arange(int(many.sum())) - np.repeat(before - begins[units], many)]

    @property
    def link_type(self):
        return np.int32 if len(self.a.tokens) * len(self.b.tokens) < 1 << 31 else np.int64


@lru_cache(maxsize=2)
def aligner(folder: str) -> _Aligner:
    """One for each worker process."""
    return _Aligner(folder)


@lru_cache(maxsize=2)
def _written(a: int, b: int) -> list[str]:
    """The decimal ids of both vocabularies, each with the sign that may follow it."""
    return [f"{i}{sign}" for sign, n in ((",", a), ("|", a), (",", b), (";", b)) for i in range(n)]


def _units(view: np.ndarray | None) -> list[str]:
    if view is None or not len(view):
        return []
    try:
        return _CUT.split(view.tobytes().decode())
    except UnicodeDecodeError:
        return []


def _aligned_slice(known: _Aligner, texts: list[list[str]]) -> tuple[np.ndarray, ...]:
    """n_a, n_b, n_groups of each text; all links, all ids and signs in the order they are written, and how many are of each text."""
    numbered = known.numbers(texts)
    numbered = [n if len(n) and known.sound[n].all() else n[:0] for n in numbered]
    units = np.concatenate(numbered)
    a, b = known.tokens(units, 0), known.tokens(units, 1)
    ends_a, ends_b = np.cumsum(known.a.sizes[a]), np.cumsum(known.b.sizes[b])
    total = int(ends_a[-1]) if len(a) else 0
    # byte offsets of the texts: the tokens of a text's units cover it and its first space
    flat, begins = known.flat[0]
    bytes_before = np.cumsum(np.append(0, known.a.sizes[flat]))[begins]
    unit_bytes = bytes_before[units + 1] - bytes_before[units]
    offsets = np.append(0, np.cumsum(unit_bytes))[np.cumsum([0, *map(len, numbered)])]
    at_a, at_b = np.bincount(ends_a, minlength=total + 1), np.bincount(ends_b, minlength=total + 1)
    cut = (at_a > 0) & (at_b > 0)
    upto_a, upto_b, upto_cut = np.cumsum(at_a), np.cumsum(at_b), np.cumsum(cut)
    n_a, n_b, n_groups = (np.diff(upto[offsets]) for upto in (upto_a, upto_b, upto_cut))
    places = np.flatnonzero(cut)
    last_a, last_b = upto_a[places] - 1, upto_b[places] - 1
    links = a[last_a] * len(known.b.tokens) + b[last_b]
    # a group's A tokens, then its B tokens: each token's place among both streams
    group_a, group_b = upto_cut[ends_a] - cut[ends_a], upto_cut[ends_b] - cut[ends_b]
    b_before = np.append(0, last_b + 1)[:-1] if len(places) else np.zeros(0, np.int64)
    order = np.empty(len(a) + len(b), np.int64)
    place_a, place_b = np.arange(len(a)) + b_before[group_a], np.arange(len(b)) + (last_a + 1)[group_b]
    many_a, many_b = len(known.a.tokens), len(known.b.tokens)
    order[place_a], order[place_b] = a, b + 2 * many_a
    order[place_a[last_a]] += many_a
    order[place_b[last_b]] += many_b
    return n_a, n_b, n_groups, links.astype(known.link_type), order


_COLUMNS = "doc_id long, n_a long, n_b long, n_groups long, groups string, links binary"


def aligned(docs: DataFrame, folder: str = VOCABULARIES, digests: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups, links: a row for each row of docs.

    groups is `a1,a2|b1;a3|b2,b3`: the ids of each group, A before B; its SHA-256
    with digests. links has the group's last tokens as packed numbers, A's id
    times B's vocabulary plus B's id. Texts that are null, empty or not UTF-8, or
    that some token stream doesn't give back byte for byte, have no tokens: zeros
    and ''. Repeated rows, and rows without doc_id, fare like any other. Other
    columns of docs are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = aligner(folder)
        written = _written(len(known.a.tokens), len(known.b.tokens))

        def told(doc_ids: list, texts: list[list[str]]) -> pa.RecordBatch:
            n_a, n_b, n_groups, links, order = _aligned_slice(known, texts)
            text_at, link_at = np.append(0, np.cumsum(n_a + n_b)), np.append(0, np.cumsum(n_groups))
            groups, packed = [], []
            for i in range(len(texts)):
                text = "".join(map(written.__getitem__, order[text_at[i] : text_at[i + 1]].tolist()))[:-1]
                groups.append(hashlib.sha256(text.encode()).hexdigest() if digests and text else text)
                packed.append(links[link_at[i] : link_at[i + 1]].tobytes())
            return pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array(n_a), pa.array(n_b), pa.array(n_groups.astype(np.int64)), pa.array(groups, pa.string()), pa.array(packed, pa.binary())],
                names=["doc_id", "n_a", "n_b", "n_groups", "groups", "links"],
            )

        for batch in batches:
            ids, texts, held = [], [], 0
            for doc_id, view in zip(batch.column(0).to_pylist(), byte_views(batch.column(1))):
                ids.append(doc_id)
                texts.append(_units(view))
                held += len(view) if view is not None else 0
                if held >= SLICE:
                    yield told(ids, texts)
                    ids, texts, held = [], [], 0
            if ids:
                yield told(ids, texts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _COLUMNS)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, place = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(place, np.concatenate(counts), len(found)).astype(np.int64)


def pair_counts(found: DataFrame, link_type) -> DataFrame:
    """link, n: how many links of all documents are of each pair of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = np.zeros(0, link_type), np.zeros(0, np.int64)
        for batch in batches:
            column = batch.column(0)
            for at in range(0, len(column), 1024):
                links = np.concatenate([np.frombuffer(x.as_buffer(), link_type) for x in column[at : at + 1024]])
                key, n = _summed([key, *np.unique(links, return_counts=True)[:1]], [n, np.unique(links, return_counts=True)[1]])
        yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(n)], names=["link", "n"])

    counted = found.select("links").mapInArrow(run, "link long, n long")
    return counted.groupBy("link").agg(F.sum("n").alias("n"))


def pair_bound(a: list[bytes], b: list[bytes]) -> int:
    """How many pairs of tokens can end together in any text: one is the end of the other."""

    def within(tokens: list[bytes], others: list[bytes]) -> int:
        many: dict[bytes, int] = {}
        for t in others:
            many[t] = many.get(t, 0) + 1
        return sum(many.get(t[i:], 0) for t in tokens for i in range(len(t)))

    return within(a, b) + within(b, a)


def link_scores(found: DataFrame, folder: str = VOCABULARIES) -> DataFrame:
    """Rows of aligned with n_links, n_best and count_sum in place of links.

    A link's count is that of its pair of ids over all rows of found, and it is
    a best one if no pair with its B id has a higher count. found is read twice,
    so it should be a table.
    """
    known = aligner(folder)
    link_type, many_b = known.link_type, len(known.b.tokens)
    counts = pair_counts(found, link_type).toArrow()  # at most pair_bound rows, whatever the corpus
    key, n = counts.column("link").to_numpy(), counts.column("n").to_numpy()
    order = np.argsort(key)
    key, n = key[order], n[order]
    top = np.zeros(many_b, np.int64)
    np.maximum.at(top, key % many_b, n)
    shared = pinned(found.sparkSession, (key.astype(link_type), n, n == top[key % many_b]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, best = shared.value
        for batch in batches:
            sums, bests, sizes = [], [], []
            for x in batch.column(batch.schema.get_field_index("links")):
                at = np.searchsorted(key, np.frombuffer(x.as_buffer(), link_type))
                sizes.append(len(at))
                sums.append(int(n[at].sum()))
                bests.append(int(best[at].sum()))
            out = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "n_a", "n_b", "n_groups", "groups")]
            yield pa.RecordBatch.from_arrays(
                [*out, pa.array(sizes, pa.int64()), pa.array(bests, pa.int64()), pa.array(sums, pa.int64())],
                names=["doc_id", "n_a", "n_b", "n_groups", "groups", "n_links", "n_best", "count_sum"],
            )

    return found.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, groups string, n_links long, n_best long, count_sum long")


def token_alignments(docs: DataFrame, folder: str = VOCABULARIES, digests: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups, n_links, n_best, count_sum: see aligned and link_scores."""
    return link_scores(stored(aligned(docs, folder, digests), "alignments"), folder)
