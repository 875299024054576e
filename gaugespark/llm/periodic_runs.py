"""Maximal periodic runs of words by a suffix tree's branching tandem repeats.

The words of some whole documents are numbered so that equal words of one
document, and only those, are equal; their suffixes then form a forest, a
suffix tree for each document. It is built on whole arrays: suffixes are sorted
by their first 1, 2, 4, ... words, and only those that are still alike are
sorted again; the ranks of every length are kept, and give the common prefix of
neighbours, hence the tree's nodes, and how far a repeat reaches to the left.

Tandem repeats are found as Stoye and Gusfield do: at each node of depth D, the
leaves of all children but the largest (the smaller half) are asked whether the
leaf D words on, or D words before, stands under another child. Each such pair
is a branching tandem repeat, one that no rotation to the right continues.
Every maximal run ends in one, so rotating it to the left as far as its words
repeat gives the run; repeats that give the same stretch are merged under the
smallest period.

Work is O(n log n) and memory about 4 n log2(longest repeat) bytes for n words
of one block of documents, of about BLOCK words unless one text is longer.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugespark.llm.textarrays import byte_views

#: Words of a block of whole documents whose trees are built together.
BLOCK = 1 << 18
#: Leaves asked at once.
_ASKED = 1 << 22


def _ranked_suffixes(ids: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Ranks by the first 1, 2, 4, ... words, the sorted suffixes, and the common prefix of each with the one before."""
    n = len(ids)
    sa = np.argsort(ids, kind="stable")
    found = ids[sa]
    head = np.ones(n + 1, bool)
    np.not_equal(found[1:], found[:-1], out=head[1:n])
    rank = np.full(n + 1, -1, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(head[:n], np.arange(n), 0))
    levels, split = [rank], np.full(n + 1, -1, np.int8)
    alike = np.flatnonzero(~(head[:n] & head[1:]))
    while len(alike):
        k = len(levels) - 1
        at = sa[alike]
        key = rank[at].astype(np.int64) * (n + 2) + rank[np.minimum(at + (1 << k), n)] + 1
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        sa[alike] = at
        first = np.ones(len(at) + 1, bool)
        np.not_equal(key[1:], key[:-1], out=first[1:-1])
        new = first[:-1] & ~head[alike]
        split[alike[new]] = k
        head[alike[new]] = True
        rank = rank.copy()
        rank[at] = alike[np.maximum.accumulate(np.where(first[:-1], np.arange(len(at)), 0))]
        levels.append(rank)
        alike = alike[~(first[:-1] & first[1:])]
    common = np.zeros(n + 1, np.int64)
    shared = np.flatnonzero(split >= 0)
    k = split[shared]
    x, y = sa[shared - 1] + (1 << k.astype(np.int64)), sa[shared] + (1 << k.astype(np.int64))
    common[shared] = 1 << k.astype(np.int64)
    for j in range(int(k.max(initial=0)) - 1, -1, -1):
        same = (levels[j][np.minimum(x, n)] == levels[j][np.minimum(y, n)]) & (j < k)
        step = same.astype(np.int64) << j
        common[shared] += step
        x, y = x + step, y + step
    return levels, sa, common


def _nodes(common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(boundary, first leaf, end) for each boundary between children of a node, by node, then in order."""
    inner = np.flatnonzero(common)
    low, high = np.arange(-1, len(common) - 1), np.arange(1, len(common) + 1)
    low[0], high[-1] = 0, len(common) - 1
    for reach in (low, high):
        left = inner
        while len(left):
            left = left[common[reach[left]] >= common[left]]
            reach[left] = reach[reach[left]]
    order = np.lexsort((inner, high[inner], low[inner]))
    inner = inner[order]
    return inner, low[inner], high[inner]


def branching_repeats(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(start, period) of the branching tandem repeats, each once, with the ranks of all lengths."""
    n = len(ids)
    levels, sa, common = _ranked_suffixes(ids)
    inner, low, high = _nodes(common)
    none = np.zeros(0, np.int64)
    if not len(inner):
        return none, none, levels
    fresh = np.ones(len(inner), bool)
    fresh[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    node = np.cumsum(fresh) - 1
    first = np.flatnonzero(fresh)
    # the children of each node: from its first leaf to its first boundary, and so on to its end
    heads = first + np.arange(len(first))
    starts = np.empty(len(inner) + len(first), np.int64)
    starts[np.arange(len(inner)) + node + 1] = inner
    starts[heads] = low[first]
    ends = np.append(starts[1:], 0)
    ends[np.append(heads[1:], len(starts)) - 1] = high[first]
    of = np.repeat(np.arange(len(first)), np.diff(np.append(heads, len(starts))))
    size = ends - starts
    largest = np.flatnonzero(size == np.maximum.reduceat(size, heads)[of])
    largest = largest[np.unique(of[largest], return_index=True)[1]]
    asked = np.ones(len(size), bool)
    asked[largest] = False
    starts, ends, of, size = starts[asked], ends[asked], of[asked], size[asked]
    depth, low, high = common[inner[first]], low[first], high[first]
    place, found = levels[-1], []
    cuts = np.searchsorted(np.cumsum(size), np.arange(0, int(size.sum()) + 1, _ASKED), "left")
    for a, b in zip(cuts, np.append(cuts[1:], len(size))):
        if a == b:
            continue
        many = size[a:b]
        before = np.cumsum(many) - many
        child = np.repeat(np.arange(a, b), many)
        leaf = sa[np.arange(int(many.sum())) - np.repeat(before, many) + np.repeat(starts[a:b], many)]
        d = depth[of[child]]
        for other, start in ((leaf + d, leaf), (leaf - d, leaf - d)):
            at = place[np.clip(other, -1, n)]
            ok = (at >= low[of[child]]) & (at < high[of[child]]) & ((at < starts[child]) | (at >= ends[child]))
            found.append(np.stack([start[ok], d[ok]]))
    pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
    return pairs[0], pairs[1], levels


def maximal_runs(ids: np.ndarray, min_length: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the maximal runs long enough, by start, then period."""
    start, period, levels = branching_repeats(ids)
    end, start = start + 2 * period, start.copy()
    for k in range(len(levels) - 1, -1, -1):  # rotate to the left, by powers of two
        at = np.maximum(start - (1 << k), 0)
        back = (start >= 1 << k) & (levels[k][at] == levels[k][at + period])
        start[back] -= 1 << k
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    keep = np.ones(len(start), bool)
    keep[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    keep &= end - start >= np.maximum(min_length, min_exponent * period)
    start, end, period = start[keep], end[keep], period[keep]
    order = np.lexsort((period, start))
    return start[order], (end - start)[order], period[order]


def _blocks(texts: pa.Array, ids: list, order) -> Iterator[list[list[bytes]]]:
    """Lists of the word lists of whole texts, about BLOCK words each."""
    block, held = [], 0
    for doc_id, view in zip(ids, byte_views(texts)):
        words = view.tobytes().split() if view is not None else []
        taken = order(doc_id, len(words)) if order and words else None
        block.append(words if taken is None else [words[i] for i in taken])
        held += len(words)
        if held >= BLOCK:
            yield block
            block, held = [], 0
    if block:
        yield block


def _numbered(block: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers, equal for equal words of one document only, and where each document begins (and the last ends)."""
    numbers, sizes, offset = [], [0], 0
    for words in block:
        known: dict[bytes, int] = {}
        own = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
        numbers.append(own + offset)
        offset += len(known)
        sizes.append(len(words))
    return np.concatenate(numbers), np.cumsum(sizes)


RUNS = "array<struct<start:long,length:long,period:long>>"


def periodic_runs(docs: DataFrame, min_length: int = 6, min_exponent: int = 4, order: Callable | None = None) -> DataFrame:
    """doc_id, n_words, runs, collapsed: a row for each row of docs.

    Words are runs of anything but ASCII white space, numbered from 0. A run is
    a stretch of consecutive words with smallest period q, of at least
    min_length words and min_exponent (2 or more) periods, that no neighbouring
    word extends with that period; runs are ordered by start, then period.
    collapsed has the words, one space between, without those that some run
    contains after its first q words. order(doc_id, n), where given, is the
    numbers of the words to take in place of all n in order, or None.

    Null, empty and blank texts have no words, no runs and an empty collapsed
    text. Rows stand alone: repeated rows, and rows without doc_id (an order is
    asked with None), fare like any other. Other columns of docs are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, done = batch.column(0).to_pylist(), 0
            for block in _blocks(batch.column(1), doc_ids, order):
                ids, begins = _numbered(block)
                start, length, period = maximal_runs(ids, min_length, min_exponent) if len(ids) else [np.zeros(0, np.int64)] * 3
                gone = np.zeros(len(ids) + 1, np.int64)
                np.add.at(gone, start + period, 1)
                np.add.at(gone, start + length, -1)
                kept = np.cumsum(gone[:-1]) == 0
                owner = np.searchsorted(begins, start, "right") - 1
                texts = []
                for i, words in enumerate(block):
                    keep = kept[begins[i] : begins[i + 1]]
                    texts.append(b" ".join(words if keep.all() else [words[j] for j in np.flatnonzero(keep)]))
                runs = pa.StructArray.from_arrays([pa.array(start - begins[owner]), pa.array(length), pa.array(period)], names=["start", "length", "period"])
                offsets = np.searchsorted(owner, np.arange(len(block) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids[done : done + len(block)], pa.int64()), pa.array(np.diff(begins)), pa.ListArray.from_arrays(pa.array(offsets), runs), pa.array(texts, pa.binary())],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )
                done += len(block)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def looped_order(doc_id: int | None, n: int) -> np.ndarray | None:
    """The word numbers of a text of n words whose tail is made a loop, or None: one document in ten, by its doc_id."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def run_digests(found: DataFrame) -> DataFrame:
    """Rows of periodic_runs with the number of runs, the longest (then first, then of least period), and digests."""
    longest = F.try_element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(1))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    found = found.withColumn("best", longest)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.less")).alias("length"),
        F.col("best.period").alias("period"),
        F.expr("-1000 * best.less div best.period").alias("exponent_milli"),
        F.sha2(text.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: op11 in DuckDB's SQL: all pairs of equal words at each distance, joined into stretches.
ORACLE = r"""
WITH hashed AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         xor(list_reduce(list_transform(regexp_extract_all(hex(doc_id::VARCHAR::BLOB), '..'), lambda h: ('0x' || h)::BIGINT),
             lambda c, x: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda e, k: xor(e >> 1, 3988292384 * (e & 1)), xor(c, x)),
             4294967295::BIGINT), 4294967295)::BIGINT AS h
  FROM documents
), looped AS (
  SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS loops, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a, h // 10 AS g FROM hashed
), periods AS (
  SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM looped
), words AS (
  SELECT doc_id, i, w[1 + CASE WHEN loops AND i >= a THEN a + (i - a) % p ELSE i END] AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM periods)
), alike AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q
  FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i
), stretches AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS run FROM alike)
  GROUP BY doc_id, q, run
  HAVING count(*) + q >= greatest(6, 4 * q)
), runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY doc_id, start, length
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
), told AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
         first({'s': start, 'l': length, 'p': period} ORDER BY length DESC, start, period) AS best
  FROM runs GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length, best.p::BIGINT AS period,
       (1000 * best.l // best.p)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM documents d LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
