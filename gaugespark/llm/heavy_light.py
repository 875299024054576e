"""Exact Jaccard join of shingle sets: small sets by subsets, large sets by inverted lists.

Two sets of a and b elements that share a part `percent` of their union share at
least c(a, b) = ceil(percent * (a + b) / (100 + percent)) elements.

* Light sets enumerate their subsets of each size c that a partner may ask for:
  two light sets are linked only if they have such a subset in common.
* Heavy sets scan inverted lists, of their own and of all sets that may be their
  partners. By the prefix rule only n - ceil(percent * n / 100) + 1 elements of a
  set of n need lists, if all sets take theirs by one order: first a fixed part of
  all hash values, by the number of sets that hold the element (the rarest first),
  then the others by hash. Only that part's elements are counted; a set with too
  few of them takes its next ones.
* The boundary is fixed by the similarity, whatever the table: the largest sets of
  which none has more subsets than KEYS. Sets above it would have many times as many.

Who meets under a key, a subset or an element, is told apart without pairing
everybody: all are held against the key's smallest document, the nearest first;
keys whose members are one component by then are done. In the others, members
outside the key's largest component are held against all its members of like
size, in blocks, once for all keys that the same documents meet under. Pairs are held against each other by parity sketches first: two
sketches differ in no more bits than two sets in elements, so none is lost.
Every link is confirmed on whole sets. A key whose many members are all unlike
costs the square of their number, in sketch comparisons, not in rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugespark.llm.common import stored
from gaugespark.llm.near_dedup import components, confirmed, open_keys, relinked
from gaugespark.llm.textarrays import byte_views, lowered, mix, shingles, word_hashes

#: The largest sets whose subsets are ever enumerated.
SMALL = 24
#: Sixteenths of all hash values whose elements are counted.
COUNTED = 4
#: The most subsets of a light set.
KEYS = 16
#: Documents in a block of those that are held against each other.
BLOCK = 2048
#: Sets that a task remembers, so that it sends the elements of copies once.
_REMEMBERED = 1 << 16


def overlap(a: int, b: int, percent: int) -> int:
    """The least number of shared elements of linked sets of a and b."""
    return -(-percent * (a + b) // (100 + percent))


def subset_sizes(n: int, percent: int) -> list[int]:
    """The sizes of the subsets that a set of n must have in common with its partners."""
    partners = range(-(-percent * n // 100), 100 * n // percent + 1)
    return sorted({c for m in partners if (c := overlap(n, m, percent)) <= min(n, m)})


def subset_count(n: int, percent: int) -> int:
    return sum(math.comb(n, c) for c in subset_sizes(n, percent))


@lru_cache(maxsize=256)
def _choices(n: int, c: int) -> np.ndarray:
    return np.array(list(combinations(range(n), c)), np.int64).reshape(-1, c)


def subset_keys(found: np.ndarray, percent: int) -> np.ndarray:
    """A hash of each subset, of each size that is asked for, of a sorted set."""
    out = []
    for c in subset_sizes(len(found), percent):
        key = np.full(math.comb(len(found), c), c, np.uint64)
        for column in found[_choices(len(found), c)].T:
            key = mix(key * np.uint64(0x9DDFEA08EB382D69) + column)
        out.append(key)
    return np.concatenate(out).astype(np.int64)


def sketch(found: np.ndarray) -> np.ndarray:
    """The parity of the number of elements at each place, of at least as many places as elements."""
    width = max(64, 1 << (len(found) - 1).bit_length())
    at = (found & np.uint64(width - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=width) & 1).astype(bool), bitorder="little")


def _folded(x: np.ndarray, size: int) -> np.ndarray:
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _may_link(n: int, one: np.ndarray, many: np.ndarray, sketches: np.ndarray, percent: int) -> np.ndarray:
    """Which of some sets a set of n may be linked with, by size and by sketches of equal width."""
    shared = -(-percent * (n + many) // (100 + percent))
    apart = np.bitwise_count(sketches ^ one).sum(axis=1, dtype=np.int64)
    return (shared <= np.minimum(n, many)) & (apart <= n + many - 2 * shared)


def measured(docs: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """doc_id, class, n, sketch, n_counted, tokens, whole of each row.

    class is equal for equal sets; tokens are the elements that may be in the
    set's prefix, and whole all those of a small set; both are null where the
    task has sent those of an equal set lately.
    """
    last = np.uint64(COUNTED) << np.uint64(60)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows: dict[str, list] = {c: [] for c in ("class", "n", "sketch", "n_counted", "tokens", "whole")}
            for doc_id, buf in zip(ids, byte_views(batch.column(1))):
                found = shingles(word_hashes(lowered(buf)), shingle_words) if buf is not None else np.zeros(0, np.uint64)
                digest = hashlib.md5(found.tobytes()).digest()
                counted = int(np.searchsorted(found, last, "left"))
                tokens = whole = None
                if len(found) and doc_id is not None and digest not in seen:
                    if len(seen) >= _REMEMBERED:
                        seen.clear()
                    seen.add(digest)
                    prefix = len(found) + percent * len(found) // -100 + 1
                    tokens = found[: max(counted, prefix)].astype(np.int64)
                    whole = found.astype(np.int64) if len(found) <= SMALL else None
                cells = (digest, len(found), sketch(found).tobytes() if len(found) else b"", counted, tokens, whole)
                for c, x in zip(rows, cells):
                    rows[c].append(x)
            longs = pa.list_(pa.int64())
            kinds = [pa.binary(), pa.int64(), pa.binary(), pa.int64(), longs, longs]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, k) for x, k in zip(rows.values(), kinds)]], names=["doc_id", *rows])

    schema = "doc_id long, class binary, n long, sketch binary, n_counted long, tokens array<long>, whole array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def prefix_lists(signed: DataFrame, percent: int) -> DataFrame:
    """key, doc_id, n, holders: the shared elements in each set's prefix."""
    posts = signed.where("tokens is not null").select("doc_id", F.explode("tokens").alias("key"))
    # a table, so that both sides of the join below are shuffled and a hot element can be split
    shared = stored(posts.groupBy("key").agg(F.count("*").alias("holders")).where("holders > 1"), "shared-elements")
    held = posts.join(shared, "key").withColumn("counted", F.shiftrightunsigned("key", 60) < COUNTED)
    # a doc_id of several texts keeps all elements of them: more than their prefixes
    facts = signed.where("doc_id is not null and n > 0").groupBy("doc_id").agg(F.min("n").alias("n"), F.min("n_counted").alias("n_counted"), (F.min("class") != F.max("class")).alias("mixed"))
    own = Window.partitionBy("doc_id", "counted")
    held = held.withColumn("place", F.row_number().over(own.orderBy("holders", "key"))).withColumn("n_shared", F.count("*").over(own))
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    inside = ~F.col("counted") | F.col("mixed") | (F.col("n_counted") - F.col("n_shared") + F.col("place") <= prefix)
    return held.join(facts, "doc_id").where(inside).select("key", "doc_id", "n", "holders")


def boundary(percent: int) -> int:
    """The largest light sets: up to there no set has more than KEYS subsets."""
    return next((n for n in range(SMALL) if subset_count(n + 1, percent) > KEYS), SMALL)


def meetings(signed: DataFrame, percent: int) -> DataFrame:
    """key, doc_id: what any two linked sets have at least one of in common."""
    lists = stored(prefix_lists(signed, percent), "prefix-lists")
    light = boundary(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, whole in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys = subset_keys(whole.values.to_numpy().astype(np.uint64), percent)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), doc_id))], names=["key", "doc_id"])

    heavy = lists.where((F.col("n") > light) | (100 * F.col("n") >= percent * (light + 1))).select("key", "doc_id")
    subsets = signed.where(F.col("whole").isNotNull() & (F.col("n") <= light)).select("doc_id", "whole").mapInArrow(run, "key long, doc_id long")
    return heavy.union(subsets)


def _near(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, far: the pairs that sizes and sketches don't tell apart, and how far their sketches are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(i).to_numpy() for i in (2, 4))
            far = np.full(batch.num_rows, -1, np.int64)
            for i, (x, y) in enumerate(zip(batch.column(3), batch.column(5))):
                x, y = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
                size = min(len(x), len(y))
                x, y = _folded(x, size), _folded(y, size)
                if _may_link(int(n[i]), x, m[i : i + 1], y[None], percent)[0]:
                    far[i] = int(np.bitwise_count(x ^ y).sum())
            keep = pa.array(far >= 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(far).filter(keep)], names=["a", "b", "far"])

    of = lambda side: sets.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}"))
    both = pairs.join(of("a"), "a").where("a <> b").join(of("b"), "b")
    like = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return both.where(like).select("a", "b", "n_a", "s_a", "n_b", "s_b").mapInArrow(run, "a long, b long, far long")


def _once(spanning: DataFrame) -> DataFrame:
    """The rows of one key of each set of members."""
    told = [F.bit_xor(F.xxhash64("id", F.lit(i))).alias(f"h{i}") for i in range(2)]
    same = spanning.groupBy("key").agg(F.count("*").alias("members"), *told)
    first = stored(same.groupBy("members", "h0", "h1").agg(F.min("key").alias("key")).select("key"), "keys-of-own")
    return spanning.join(first.hint("merge"), "key")


def _across(spanning: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs that may be linked of documents outside their key's main component with all others of the key."""
    band = F.floor(F.log(F.col("n")) / math.log(100 / percent)).cast("int")
    placed = spanning.join(sets, "id").withColumn("band", band)
    # linked sets are of one band or of neighbours; one more on each side for the rounding of logarithms
    asked = stored(placed.where("comp <> main").withColumn("band", F.explode(F.sequence(F.col("band") - 2, F.col("band") + 2))), "asked")
    against = stored(placed, "against")
    count = lambda df, name: df.groupBy("key", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    sizes = stored(count(asked, "nq").join(count(against, "na"), ["key", "band"]), "blocks")

    def dealt(df: DataFrame, own: str, other: str, n_own: str, n_other: str, is_asked: bool) -> DataFrame:
        rows = df.join(sizes, ["key", "band"]).withColumn(own, F.pmod(F.xxhash64("id"), F.col(n_own)).cast("int"))
        rows = rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1)))
        return rows.select("key", "band", "q", "a", "id", "comp", "n", "sketch", F.lit(is_asked).alias("asked"))

    def run(group: pa.Table) -> pa.Table:
        ids, comps, n = (group.column(c).to_numpy() for c in ("id", "comp", "n"))
        asks = np.array(group.column("asked").to_pylist(), bool)
        found = [np.frombuffer(x.as_buffer(), np.uint8) for x in group.column("sketch")]
        width = min(map(len, found))
        every = np.stack([_folded(x, width) for x in found])
        others, pairs = np.flatnonzero(~asks), []
        for i in np.flatnonzero(asks):
            near = others[_may_link(int(n[i]), every[i], n[others], every[others], percent) & (comps[others] != comps[i])]
            pairs.append(np.stack([np.minimum(ids[i], ids[near]), np.maximum(ids[i], ids[near])]))
        a, b = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
        return pa.table({"a": a, "b": b})

    rows = dealt(asked, "q", "a", "nq", "na", True).union(dealt(against, "a", "q", "na", "nq", False))
    return rows.groupBy("key", "band", "q", "a").applyInArrow(run, "a long, b long").distinct()


def _links(meet: DataFrame, sets: DataFrame, docs: DataFrame, shingle_words: int, percent: int) -> DataFrame | None:
    """(id, comp) of the documents that are linked with one of smaller id."""
    many = meet.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("members")).where("lo < hi")
    members = stored(meet.join(stored(many.select("key", "lo", "members"), "shared-keys"), "key"), "members")
    first = members.where("id <> lo").select(F.col("lo").alias("a"), F.col("id").alias("b")).distinct()
    first = stored(_near(first, sets, percent).groupBy("a", "b").agg(F.min("far").alias("far")), "near-pairs")
    needed = members.select("id").distinct()
    texts = stored(docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("id"), "text").join(needed, "id", "left_semi"), "texts")
    labels = None

    def joined(pairs: DataFrame) -> DataFrame | None:
        links = stored(confirmed(pairs, texts, shingle_words, percent), "links")
        if links.isEmpty():
            return labels
        return components(links) if labels is None else relinked(labels, links)

    def apart(pairs: DataFrame) -> DataFrame:
        """The pairs of documents that are not yet in one component."""
        if labels is None:
            return pairs
        of = lambda side: labels.select(F.col("id").alias(side), F.col("comp").alias(f"comp_{side}"))
        named = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
        return named.where(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b")).select("a", "b")

    if not first.isEmpty():
        nearest = first.groupBy("b").agg(F.min(F.struct("far", "a"))["a"].alias("a")).select("a", "b")
        labels = joined(nearest)
        rest = stored(apart(first.select("a", "b").join(nearest, ["a", "b"], "left_anti")), "pairs")
        if not rest.isEmpty():
            labels = joined(rest)
    # a key of two members has no other pair than the one tested
    larger = members.where("members > 2").select("key", "id")
    named = labels if labels is not None else larger.sparkSession.createDataFrame([], "id long, comp long")
    spanning = stored(_once(open_keys(larger, named)), "spanning")
    if not spanning.isEmpty():
        more = stored(apart(_across(spanning, sets, percent).join(first.select("a", "b"), ["a", "b"], "left_anti")), "pairs")
        if not more.isEmpty():
            labels = joined(more)
    return labels


def shingle_join(docs: DataFrame, shingle_words: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id: a row for each row of docs.

    Words are runs of anything but ASCII white space, A-Z lower-cased. A
    document's set is that of its distinct shingles of shingle_words words (of
    all its words, if fewer). Documents whose sets share percent or more of
    their union are linked; component_id is the smallest doc_id reachable. Null
    or empty texts, and texts without words, are linked with nothing. A row
    without doc_id is linked with nothing and has no component_id. Rows that
    repeat a doc_id count as one document with several texts. Other columns of
    docs are ignored.
    """
    docs = docs.select("doc_id", "text")
    signed = stored(measured(docs, shingle_words, percent), "sets")
    linked = signed.where("doc_id is not null and n > 0")
    classes = stored(linked.groupBy("class").agg(F.min("doc_id").alias("id"), F.min("n").alias("n"), F.min("sketch").alias("sketch")), "classes")
    ids = linked.select("doc_id", "class").distinct().join(classes.select("class", "id"), "class").select("doc_id", "id")
    meet = stored(meetings(signed, percent).join(ids, "doc_id").select("key", "id").distinct(), "meetings")
    labels = _links(meet, classes.select("id", "n", "sketch").distinct(), docs, shingle_words, percent)
    named = classes.select("class", "id")
    named = named.join(labels, "id", "left") if labels is not None else named.withColumn("comp", F.lit(None).cast("long"))
    # copies of one text under several doc_ids are one class; a doc_id of several texts joins theirs
    named = named.select("class", F.coalesce("comp", "id").alias("comp"))
    out = signed.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.expr("doc_id is not null and n > 0"), F.col("class")).alias("class"))
    return out.join(named, "class", "left").select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"))


#: op12 in DuckDB's SQL, for 4-word shingles at 85 %: every pair of documents of like size that share a shingle.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS s
  FROM words WHERE len(w) > 0
), shingles AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS s FROM sets
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, a.n + b.n - count(*) AS every, count(*) AS shared
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
), links AS (
  SELECT x, y FROM pairs WHERE 100 * shared >= 85 * every
), sides AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reached AS (
  SELECT doc_id AS id, doc_id AS least FROM documents
  UNION
  SELECT x, least FROM reached JOIN sides ON y = id WHERE least < x
)
SELECT id AS doc_id, coalesce(len(s), 0)::BIGINT AS n_shingles, component_id
FROM (SELECT id, min(least) AS component_id FROM reached GROUP BY id) LEFT JOIN sets ON id = doc_id
"""
