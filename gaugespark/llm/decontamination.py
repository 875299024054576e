"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are normalised (lower case, white space as single spaces).
An item that occurs with at most k edits, cut into k + 1 pieces, has one piece
that occurs exactly. An automaton of all pieces finds their exact hits in one
pass over each whole text; around each hit, Myers' bit-parallel algorithm gives
the least edit distance of the item to any passage.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugespark.llm.common import pinned

#: Edits allowed for each character of an item.
EDIT_RATE = 0.05
#: The least length of a piece: items get fewer edits rather than shorter pieces.
MIN_PIECE = 8
#: Items are broadcast in blocks of about so many characters; more items are
#: searched block by block, each over all documents.
BLOCK_CHARS = 8_000_000


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def budget(item: str, rate: float = EDIT_RATE) -> int:
    """The errors allowed for an item, so that its pieces are long enough."""
    return max(0, min(int(len(item) * rate), len(item) // MIN_PIECE - 1))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece): k + 1 pieces of nearly equal length."""
    cuts = [round(i * len(item) / (k + 1)) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def least_distance(item: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the passage of text nearest to item, if within most edits.

    Myers' algorithm: a column of the edit matrix as two bit vectors, each
    character of the text a few operations on whole words.
    """
    m = len(item)
    ones, top = (1 << m) - 1, 1 << (m - 1)
    where: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        where[c] |= 1 << i
    up, down, score, best = ones, 0, m, None
    for end, c in enumerate(text, 1):
        eq = where.get(c, 0)
        vertical = eq | down
        eq = (((eq & up) + up) ^ up) | eq
        rises, falls = down | (ones & ~(eq | up)), up & eq
        if rises & top:
            score += 1
        elif falls & top:
            score -= 1
        rises, falls = rises << 1, falls << 1
        up, down = (falls | ~(vertical | rises)) & ones, rises & vertical & ones
        if score <= most and (best is None or score < best[0]):
            best = (score, end)
    return best


class Matcher:
    """All items of a block: finds those that a text holds within their budgets."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [(i, t, budget(t, rate)) for i, t in items]
        found: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, t, k) in enumerate(self.items):
            for offset, piece in pieces(t, k):
                found[piece].append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item_id, distance, end in the normalised text) of each item held."""
        if self.empty:
            return []
        text = normalised(text)
        starts: dict[int, set[int]] = defaultdict(set)
        for last, (size, places) in self.automaton.iter(text):
            for n, offset in places:
                starts[n].add(last + 1 - size - offset)
        out = []
        for n, begins in starts.items():
            item_id, item, k = self.items[n]
            best, upto = None, None
            ranked = sorted(begins)
            at = 0
            while at < len(ranked):
                # hits whose windows overlap are verified together
                first = last = ranked[at]
                while at + 1 < len(ranked) and ranked[at + 1] - last <= len(item) + 2 * k:
                    at += 1
                    last = ranked[at]
                at += 1
                low = max(0, first - k)
                got = least_distance(item, text[low : last + len(item) + k], k)
                if got and (best is None or got[0] < best):
                    best, upto = got[0], low + got[1]
                if best == 0:
                    break
            if best is not None:
                out.append((item_id, best, upto))
        return out


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The normalised items, in blocks of bounded size: at least one block."""
    items = benchmark.where("item_id is not null and trim(text) <> ''").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    blocks = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // BLOCK_CHARS + 1
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        yield sorted((r.item_id, t) for r in part if (t := normalised(r.text)))


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """The rows of docs, all columns, that hold no item.

    Null and empty texts hold nothing and stay, as all rows do where there are
    no items; repeated rows fare alike.
    """
    at = docs.columns.index("text")
    for items in item_blocks(benchmark):
        shared = pinned(docs.sparkSession, items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.find(t.as_py() or "") for t in batch.column(at).cast(pa.string())], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def contaminations(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """doc_id, item_id, distance, end: a row for each item that a document holds.

    A document holds an item if some passage of its normalised text is within
    the item's error budget of it. end is where the nearest passage (the first
    of them) ends. Null and empty texts hold nothing; null items and items
    without characters are held by nothing; items of equal text are all
    reported. Rows that repeat a doc_id are reported once, with the least
    distance. Rows without doc_id are reported with a null doc_id. Other
    columns of both tables are ignored.
    """
    spark = docs.sparkSession
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], "doc_id long, item_id long, distance int, end long")
    for items in item_blocks(benchmark):
        shared = pinned(spark, items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate)
            for batch in batches:
                found = [(d, *hit) for d, text in zip(batch.column(0).to_pylist(), batch.column(1)) for hit in matcher.find(text.as_py())]
                columns = list(zip(*found)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int64())], names=["doc_id", "item_id", "distance", "end"])

        out = out.union(rows.mapInArrow(run, "doc_id long, item_id long, distance int, end long"))
    return out.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "end")).alias("best")).select("doc_id", "item_id", "best.distance", "best.end")
