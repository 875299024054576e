"""Near-duplicate groups of documents by a multi-index Hamming join of b-bit MinHash.

Each distinct word sequence gets a signature of 54 symbols of 10 bits (the low
bits of 54 MinHash values of its shingle set), kept as 9 chunks of 6 symbols in
a long each. By the pigeonhole principle two signatures that differ in at most
9 * (1 + 1) - 1 = 17 symbols have a chunk with at most one wrong symbol, so each
chunk is indexed once for each symbol it may have wrong, with that symbol
blanked: all pairs within that distance meet under some key. Pairs farther
apart still meet wherever one chunk agrees; at a similarity of exactly 0.8 a
pair is missed with probability (1 - 0.655) ** 9 < 1e-4, and less above.

Who meets under a key is then told apart without pairing everybody:

1. every member is compared with the key's smallest document (linear);
2. the links found give components; keys that hold one component are done;
   elsewhere each member outside the key's main component is compared with a
   second centre, drawn by hash from that component (linear);
3. members that are still outside are queries, held against all members of
   their keys in blocks of bounded size, which give only links.

Each comparison is on whole shingle sets, so a link is never a guess, and no
pair under a key of two components stays untested, unless their signatures are
too far apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugespark.llm.common import stored
from gaugespark.llm.textarrays import byte_views, lowered, mix, shingles, word_hashes

CHUNKS, SYMBOLS, BITS = 9, 6, 10
HASHES = CHUNKS * SYMBOLS
#: Pairs whose signatures differ in more symbols are not compared: at a
#: similarity of 0.8 the mean is 10.8 and the standard deviation 2.9.
FARTHEST = 24
#: Documents in a block of queries, and of those they are held against, and about
#: how many shingles they may have together.
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
_HIGH = sum(1 << (BITS * j + BITS - 1) for j in range(SYMBOLS))
_LOW = sum(((1 << (BITS - 1)) - 1) << (BITS * j) for j in range(SYMBOLS))
_COLUMNS = [f"sig{i}" for i in range(CHUNKS)]
_SIGNED = "doc_id long, class binary, n_shingles long, " + ", ".join(f"{c} long" for c in _COLUMNS)


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:HASHES] | np.uint64(1), seeds[HASHES:]


def signature(found: np.ndarray) -> np.ndarray:
    """The 9 packed chunks of a nonempty array of shingle hashes."""
    a, b = _multipliers()
    least = np.full(HASHES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(found), 1024):
        block = found[at : at + 1024, None] * a
        block += b
        np.minimum(least, block.min(axis=0), out=least)
    symbols = (mix(least) & np.uint64((1 << BITS) - 1)).reshape(CHUNKS, SYMBOLS)
    packed = np.zeros(CHUNKS, np.uint64)
    for j in range(SYMBOLS):
        packed |= symbols[:, j] << np.uint64(BITS * j)
    return packed.astype(np.int64)


def signatures(docs: DataFrame, shingle_words: int) -> DataFrame:
    """doc_id, class (equal for equal word sequences), n_shingles, sig0 .. sig8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, sizes, sigs = [], [], np.zeros((batch.num_rows, CHUNKS), np.int64)
            for i, buf in enumerate(byte_views(batch.column(1))):
                words = word_hashes(lowered(buf)) if buf is not None else np.zeros(0, np.uint64)
                found = shingles(words, shingle_words)
                classes.append(hashlib.md5(words.tobytes()).digest())
                sizes.append(len(found))
                if len(found):
                    sigs[i] = signature(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(classes, pa.binary()), pa.array(sizes, pa.int64())] + [pa.array(sigs[:, i]) for i in range(CHUNKS)],
                names=["doc_id", "class", "n_shingles", *_COLUMNS],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _SIGNED)


def _keys(reps: DataFrame) -> DataFrame:
    """(key, id): each chunk with each of its symbols blanked in turn."""
    every = []
    for i, c in enumerate(_COLUMNS):
        for j in range(SYMBOLS):
            blank = ((1 << BITS * SYMBOLS) - 1) & ~(((1 << BITS) - 1) << (BITS * j))
            every.append(F.xxhash64(F.col(c).bitwiseAND(F.lit(blank)), F.lit(i * SYMBOLS + j)))
    return reps.select(F.explode(F.array(*every)).alias("key"), F.col("id"))


def _distance(left: str, right: str) -> Column:
    """The number of symbols in which two signatures differ."""
    total = F.lit(0)
    for c in _COLUMNS:
        x = F.col(f"{left}.{c}").bitwiseXOR(F.col(f"{right}.{c}"))
        set_bits = (x.bitwiseAND(F.lit(_LOW)) + F.lit(_LOW)).bitwiseOR(x).bitwiseAND(F.lit(_HIGH))
        total = total + F.bit_count(set_bits)
    return total


def confirmed(pairs: DataFrame, texts: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            left, right = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            keep = np.zeros(len(left), bool)
            for i, (x, y) in enumerate(zip(byte_views(batch.column(2)), byte_views(batch.column(3)))):
                # the rows of one centre follow each other, sorted for the join
                raw = x.tobytes()
                if last[0] != raw:
                    last = (raw, shingles(word_hashes(lowered(x)), shingle_words))
                one, two = last[1], shingles(word_hashes(lowered(y)), shingle_words)
                small, large = sorted((len(one), len(two)))
                if 100 * small < percent * large:
                    continue
                common = len(np.intersect1d(one, two, assume_unique=True))
                keep[i] = 100 * common >= percent * (small + large - common)
            yield pa.RecordBatch.from_arrays([pa.array(left[keep]), pa.array(right[keep])], names=["a", "b"])

    of_b = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    both = of_b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): the smallest id reachable from each id of an edge (a, b).

    Alternates the large-star and small-star steps until the edges stay as they
    are; each round is kept as a table. A node's neighbours are only counted and
    joined, never gathered; the least of each node is a table of its own, so that
    both sides of its join are shuffled and a hot node's edges can be split.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def large(e: DataFrame) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        return both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b")

    def small(e: DataFrame) -> DataFrame:
        # edges are (smaller a, larger b): b's smaller neighbours are its a's
        least = stored(e.groupBy("b").agg(F.min("a").alias("m")), "least")
        moved = e.join(least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        return moved.union(least.select(F.col("m").alias("a"), "b")).distinct()

    now = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = state(now)
    while before[0]:
        now = stored(small(large(now).distinct()), "edges")
        after = state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("b").alias("id"), F.col("a").alias("comp"))


def relinked(labels: DataFrame, more: DataFrame) -> DataFrame:
    """labels (id, comp) after more links (a, b): the components that they join are joined whole."""
    of = lambda side: labels.select(F.col("id").alias(side), F.col("comp").alias(f"comp_{side}"))
    between = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b"))
    joined = components(between)
    # the smallest of a component has no label of its own, so the new labels are of other ids
    above = joined.select(F.col("id").alias("comp"), F.col("comp").alias("top"))
    return stored(labels.join(above, "comp", "left").select("id", F.coalesce("top", "comp").alias("comp")).union(joined.select("id", "comp")), "labels")


def open_keys(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, id, comp, main) of the keys that span components; main is the key's largest."""
    named = members.join(labels, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"))
    sizes = named.groupBy("key", "comp").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.count("*").alias("kinds"), F.max(F.struct("n", "comp"))["comp"].alias("main")).where("kinds > 1")
    # tables and merge joins here and below: a join with an aggregate of the same rows can't be split at a hot key
    return stored(named.join(stored(main.select("key", "main"), "main-components").hint("merge"), "key"), "open-keys")


def _second_centres(spanning: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b): each document outside its keys' main components with the nearest of their
    second centres, which are drawn by hash from the main components, one for each key."""
    drawn = spanning.where("comp = main").groupBy("key").agg(F.min(F.struct(F.xxhash64("id", "key").alias("h"), "id"))["id"].alias("centre"))
    met = spanning.where("comp <> main").join(stored(drawn, "second-centres").hint("merge"), "key").select("id", "centre").distinct()
    x, y = reps.alias("x"), reps.alias("y")
    near = met.alias("m").join(x, F.col("m.id") == F.col("x.id")).join(y, F.col("m.centre") == F.col("y.id")).select(F.col("m.id").alias("u"), F.col("m.centre").alias("v"), _distance("x", "y").alias("far"))
    nearest = near.where(F.col("far") <= FARTHEST).groupBy("u").agg(F.min(F.struct("far", "v"))["v"].alias("v"))
    return nearest.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))


def _across(spanning: DataFrame, reps: DataFrame, texts: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """Links (a, b) of documents outside their keys' main components, all of them tested.

    They are the query set; the members of their keys, once each under a main
    component, are what they are held against, in blocks of bounded size. A
    query gives one link for each component that a block links it with.
    """
    signed = spanning.join(reps, "id")
    queries = signed.where("comp <> main")
    near = (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") != F.col("y.comp")) & (_distance("x", "y") <= FARTHEST)
    asked = queries.alias("x").join(signed.alias("y"), near, "left_semi").select("main", "id", "comp", "n_shingles").distinct()
    against = signed.alias("x").join(queries.alias("y"), near, "left_semi").select("main", "id", "comp", "n_shingles").distinct()
    asked, against = stored(asked, "queries"), stored(against, "against")
    n_blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    blocks = lambda df, name: df.groupBy("main").agg(n_blocks.alias(name))
    sizes = blocks(asked, "nq").join(blocks(against, "na"), "main")

    def dealt(df: DataFrame, own: str, other: str, n_own: str, n_other: str, query: bool) -> DataFrame:
        placed = df.join(sizes, "main").join(texts, "id").withColumn(own, F.pmod(F.xxhash64("id"), F.col(n_own)).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1))).select("main", "q", "a", "id", "comp", "text", F.lit(query).alias("query"))

    def run(group: pa.Table) -> pa.Table:
        ids, comps = group.column("id").to_numpy(), group.column("comp").to_numpy()
        query = np.array(group.column("query").to_pylist(), bool)
        found = [shingles(word_hashes(lowered(b)), shingle_words) for b in byte_views(group.column("text"))]
        owners = np.flatnonzero(~query)
        sizes = np.array([len(found[i]) for i in owners])
        value = np.concatenate([found[i] for i in owners] or [np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(owners)), sizes)
        order = np.argsort(value, kind="stable")
        value, owner = value[order], owner[order]
        links = []
        for i in np.flatnonzero(query):
            low, high = np.searchsorted(value, found[i], "left"), np.searchsorted(value, found[i], "right")
            many = high - low
            at = np.arange(int(many.sum())) + np.repeat(low - (np.cumsum(many) - many), many)
            common = np.bincount(owner[at], minlength=len(owners))
            linked = np.flatnonzero((100 * common >= percent * (len(found[i]) + sizes - common)) & (comps[owners] != comps[i]))
            for k in np.unique(comps[owners[linked]], return_index=True)[1]:
                j = owners[linked[k]]
                links.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    rows = dealt(asked, "q", "a", "nq", "na", True).union(dealt(against, "a", "q", "na", "nq", False))
    return rows.groupBy("main", "q", "a").applyInArrow(run, "a long, b long").distinct()


def _links(reps: DataFrame, docs: DataFrame, shingle_words: int, percent: int) -> DataFrame | None:
    """(id, comp) of the representatives that are linked with another one."""
    keys = _keys(reps)
    shared = keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key", "lo")
    # a table of their own, so that the join below has a shuffle on each side and a hot key can be split
    members = stored(keys.join(stored(shared, "shared-keys").hint("merge"), "key"), "members")
    first = members.where("id <> lo").select(F.col("lo").alias("a"), F.col("id").alias("b")).distinct()
    x, y = reps.alias("x"), reps.alias("y")
    first = first.join(x, F.col("a") == F.col("x.id")).join(y, F.col("b") == F.col("y.id")).where(_distance("x", "y") <= FARTHEST).select("a", "b")
    first = stored(first.distinct(), "pairs")
    if first.isEmpty():
        return None
    needed = members.select("id").distinct()
    texts = stored(docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("id"), "text").join(needed, "id", "left_semi"), "texts")
    links = stored(confirmed(first, texts, shingle_words, percent), "links")
    labels = components(links)
    spanning = open_keys(members, labels)
    if spanning.isEmpty():
        return labels
    more = stored(confirmed(_second_centres(spanning, reps).join(first, ["a", "b"], "left_anti"), texts, shingle_words, percent), "links")
    if not more.isEmpty():
        labels = relinked(labels, more)
        spanning = open_keys(members, labels)
    more = stored(_across(spanning, reps, texts, shingle_words, percent), "links")
    return labels if more.isEmpty() else relinked(labels, more)


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of docs.

    Words are runs of anything but ASCII white space, A-Z lower-cased. A
    document's set is that of its distinct shingles of shingle_words words (of
    all its words, if fewer). Documents whose sets share percent or more of
    their union are linked; component_id is the smallest doc_id reachable, kept
    marks that document. Null or empty texts, and texts without words, are
    linked with nothing. A row without doc_id is its own group: component_id is
    null and the row is kept. Rows that repeat a doc_id count as one document
    with several texts. Other columns of docs are ignored.
    """
    docs = docs.select("doc_id", "text")
    signed = stored(signatures(docs, shingle_words), "signatures")
    linked = signed.where("doc_id is not null and n_shingles > 0")
    classes = stored(linked.groupBy("class").agg(F.min("doc_id").alias("id"), F.min("n_shingles").alias("n_shingles"), *[F.min(c).alias(c) for c in _COLUMNS]), "classes")
    labels = _links(classes.drop("class").distinct(), docs, shingle_words, percent)
    named = classes.select("class", "id")
    named = named.join(labels, "id", "left") if labels is not None else named.withColumn("comp", F.lit(None).cast("long"))
    named = named.select("class", F.coalesce("comp", "id").alias("comp"))
    out = signed.select("doc_id", "n_shingles", F.when(F.expr("doc_id is not null and n_shingles > 0"), F.col("class")).alias("class"))
    out = out.join(named, "class", "left").withColumn("component_id", F.coalesce("comp", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.expr("doc_id <=> component_id").alias("kept"))


#: op5 in DuckDB's SQL, for 2-word shingles: every pair of documents of like size that share a shingle.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM words
), shingles AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS s FROM sets
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, a.n + b.n - count(*) AS every, count(*) AS shared
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
), links AS (
  SELECT x, y FROM pairs WHERE 100 * shared >= 80 * every
), sides AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reached AS (
  SELECT doc_id AS id, doc_id AS least FROM documents
  UNION
  SELECT x, least FROM reached JOIN sides ON y = id WHERE least < x
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN (SELECT id, min(least) AS component_id FROM reached GROUP BY id) ON id = doc_id
"""
