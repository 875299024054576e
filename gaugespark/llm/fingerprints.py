"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs are its lines, long ones in pieces of eight words. Their
digests (repeats told apart by number) go into a sketch of cells, three for
each digest; a cell keeps a count, the digests' exclusive or, and that of their
checks. Two texts' sketches are subtracted cell by cell, which leaves only the
digests in which they differ, and peeled: a cell with one digest gives it away,
taking it out of its other cells makes more such cells. Where a sketch is too
small to be peeled empty, larger ones are built from the texts until one is.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugespark.llm.textarrays import byte_views, mix, span_hashes, spans

#: About how many bytes of text a task takes, buckets a task, and the most tasks (each
#: bucket has a boundary on the driver; beyond that, tasks grow and sort on disk).
TASK_BYTES, BUCKETS, MOST_TASKS = 48 << 20, 8, 10_000
#: Cells in each of a fingerprint's three parts, and words in a paragraph's piece.
PART, PIECE = 8, 8
_U = np.uint64
_SEEDS = mix(np.arange(1, 3, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
_FACTORS = mix(np.arange(11, 11 + PIECE, dtype=_U)) | _U(1)


def paragraphs(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each paragraph of a text, in order, and where it begins."""
    start, end = spans(buf)
    if not len(start):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    line = np.searchsorted(np.flatnonzero(buf == 10), start)
    number = np.arange(len(start))
    opens = np.flatnonzero(np.diff(line, prepend=-1))
    nth = number - np.repeat(opens, np.diff(opens, append=len(start)))
    piece = np.flatnonzero(nth % PIECE == 0)
    value = np.add.reduceat(span_hashes(buf, start, end) * _FACTORS[nth % PIECE], piece)
    return mix(value + np.diff(piece, append=len(start)).astype(_U)), start[piece]


def told_apart(hashes: np.ndarray) -> np.ndarray:
    """The distinct digests of paragraphs: the second of equal ones is another, and so on."""
    value = np.sort(hashes)
    same = value[1:] == value[:-1]
    if not same.any():
        return value
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    repeat = np.arange(len(value)) - np.repeat(first, np.diff(first, append=len(value)))
    return np.where(repeat > 0, mix(value + repeat.astype(_U) * _U(0x9DDFEA08EB382D69)), value)


def digests(buf: np.ndarray) -> np.ndarray:
    """The distinct digests of a text."""
    return told_apart(paragraphs(buf)[0])


def edited_digests(hashes: np.ndarray, begins: np.ndarray, edited: np.ndarray, cut: int) -> np.ndarray:
    """The distinct digests of a text that is as before up to byte cut.

    hashes and begins are those of the text before; paragraphs from the one that
    holds the last byte before the cut on are taken anew.
    """
    kept = max(0, int(np.searchsorted(begins, cut)) - 1)
    if not kept:
        return digests(edited)
    return told_apart(np.concatenate([hashes[:kept], paragraphs(edited[begins[kept] :])[0]]))


def _cells(keys: np.ndarray, part: int, salt: int) -> np.ndarray:
    """The cells of all digests in the first part, then in the second and third.

    Digests are well mixed, so a product and three runs of its bits will do.
    """
    spread = keys * (_SEEDS[0] + _U(2 * salt))
    at = (np.concatenate((spread >> _U(43), spread >> _U(22), spread >> _U(1))) & _U(0x1FFFFF)) % _U(part)
    at[len(keys) : 2 * len(keys)] += _U(part)
    at[2 * len(keys) :] += _U(2 * part)
    return at.astype(np.int64)


def _thrice(x: np.ndarray) -> np.ndarray:
    return np.concatenate((x, x, x))


def _check(keys: np.ndarray) -> np.ndarray:
    return (keys * _SEEDS[1]) >> _U(32)


def sketch(keys: np.ndarray, part: int = PART, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """count, digests and checks of 3 * part cells."""
    body, check = np.zeros(3 * part, _U), np.zeros(3 * part, _U)
    if not len(keys):
        return np.zeros(3 * part, np.int64), body, check
    at = _cells(keys, part, salt)
    np.bitwise_xor.at(body, at, _thrice(keys))
    np.bitwise_xor.at(check, at, _thrice(_check(keys)))
    return np.bincount(at, minlength=3 * part), body, check


def peeled(left: tuple, right: tuple, part: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray] | None:
    """Digests only in left and only in right; None if cells remain."""
    count, body, check = left[0] - right[0], left[1] ^ right[1], left[2] ^ right[2]
    cells = len(count)
    if np.abs(count).sum() > 3 * cells:
        return None  # more digests than cells
    ours, theirs, peels = [], [], 0
    while True:
        pure = (np.abs(count) == 1).nonzero()[0]
        keys = body[pure]
        right_check = _check(keys) == check[pure]
        pure, keys = pure[right_check], keys[right_check]
        if not len(pure):
            break
        # a digest may be alone in two or three of its cells
        order = keys.argsort()
        keys = keys[order]
        alone = np.empty(len(keys), bool)
        alone[0] = True
        np.not_equal(keys[1:], keys[:-1], out=alone[1:])
        keys, sign = keys[alone], count[pure[order[alone]]]
        ours.append(keys[sign > 0])
        theirs.append(keys[sign < 0])
        at = _cells(keys, part, salt)
        count = count - np.bincount(at, _thrice(sign), cells).astype(np.int64)
        np.bitwise_xor.at(body, at, _thrice(keys))
        np.bitwise_xor.at(check, at, _thrice(_check(keys)))
        peels += len(keys)
        if peels > cells:
            return None
    if count.any() or body.any() or check.any():
        return None
    none = [np.zeros(0, _U)]
    return np.concatenate(ours or none), np.concatenate(theirs or none)


def difference(left: np.ndarray, right: np.ndarray, sketches: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The digests only in left and only in right, by subtracted sketches.

    The fingerprints are tried first; then sketches with room for all digests,
    each time half as large again and with other cells.
    """
    got = peeled(*(sketches or (sketch(left), sketch(right))), PART)
    part, salt = (len(left) + len(right)) * 3 // 5 + PART, 1
    while got is None:
        got = peeled(sketch(left, part, salt), sketch(right, part, salt), part, salt)
        part, salt = part + part // 2, salt + 1
    return got


def likeness(left: np.ndarray, right: np.ndarray, sketches: tuple | None = None) -> float:
    """Shared paragraphs over all paragraphs of both; 1 for two texts without any."""
    ours, theirs = difference(left, right, sketches)
    shared = len(left) - len(ours)
    every = shared + len(ours) + len(theirs)
    return shared / every if every else 1.0


def written(cells: tuple) -> str:
    """A fingerprint as text: its cells, base64."""
    count, body, check = cells
    return base64.b64encode(count.astype("<u4").tobytes() + body.astype("<u8").tobytes() + check.astype("<u4").tobytes()).decode()


def fingerprint_text(buf: np.ndarray) -> str:
    return written(sketch(digests(buf)))


def edited_text(buf: np.ndarray, following: np.ndarray) -> tuple[int, np.ndarray, int]:
    """n_chars, the text with its last third replaced by the next text's beginning, and
    the byte from which it differs."""
    chars = np.flatnonzero((buf & 0xC0) != 0x80)
    third = len(chars) // 3
    cut = chars[len(chars) - third] if third else len(buf)
    if not third:
        return len(chars), buf, len(buf)
    # a character has at most four bytes
    head = following[: 4 * third + 4]
    begins = np.flatnonzero((head & 0xC0) != 0x80)
    return len(chars), np.concatenate([buf[:cut], head[: begins[third]] if len(begins) > third else following]), int(cut)


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text, bucket, ghost, each partition in descending order of buckets and doc_id.

    Buckets are ranges of doc_id. Each has, last, a ghost: a copy of the
    document that begins the next bucket (the first bucket's for the last one).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("_place", F.coalesce(F.col("doc_id").cast("double"), F.lit(-1e300)))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = min(MOST_TASKS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES + 1))
    n = BUCKETS * partitions
    # a bounded summary: one boundary and one head for each bucket
    cuts = rows.agg(F.percentile_approx("_place", [i / n for i in range(1, n)], 20 * n)).first()[0] or []
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    bucketed = Bucketizer(splits=splits, inputCol="_place", outputCol="bucket").transform(rows) if len(splits) > 2 else rows.withColumn("bucket", F.lit(0.0))
    heads = sorted(((r.bucket, r.head) for r in bucketed.groupBy("bucket").agg(F.max("doc_id").alias("head")).collect()), reverse=True)
    serves = [(head, heads[i - 1][0]) for i, (_, head) in enumerate(heads)]
    table = spark.createDataFrame(serves, "head long, serves double")
    own = F.struct(F.col("bucket"), F.lit(False).alias("ghost"))
    also = F.struct(F.col("serves").alias("bucket"), F.lit(True).alias("ghost"))
    marked = bucketed.join(F.broadcast(table), F.col("doc_id").eqNullSafe(F.col("head")), "left")
    spread = marked.select("doc_id", "text", F.explode(F.when(F.col("serves").isNull(), F.array(own)).otherwise(F.array(own, also))).alias("at"))
    spread = spread.select("doc_id", "text", "at.bucket", "at.ghost").repartition(partitions, "bucket")
    return spread.sortWithinPartitions(F.desc("bucket"), "ghost", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likenesses.

    A row for each row of docs. The edited text has the last third of the code
    points (rounded down) replaced by as many of the next document's, in
    descending order of doc_id; the first follows the last. near_edited and
    near_next are the likeness of the document's fingerprint to the edited
    text's and to the next document's. Null counts as empty; texts without
    words are alike. Rows without doc_id stand last, rows that repeat a doc_id
    in order of text. Other columns of docs are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            out = []
            ids, buckets, ghosts = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for doc_id, bucket, ghost, view in zip(ids, buckets, ghosts, byte_views(batch.column(1))):
                buf = view.copy() if view is not None else np.zeros(0, np.uint8)
                hashes, begins = paragraphs(buf)
                keys = told_apart(hashes)
                now = (doc_id, bucket, ghost, buf, keys, sketch(keys), hashes, begins)
                if last is not None and last[1] == bucket and not last[2]:
                    before_id, _, _, text, own, cells, *known = last
                    n_chars, edited, cut = edited_text(text, buf)
                    changed = edited_digests(*known, edited, cut)
                    edited_cells = sketch(changed)
                    out.append((before_id, n_chars, hashlib.sha256(edited.tobytes()).hexdigest(), written(cells), written(edited_cells), likeness(own, changed, (cells, edited_cells)), likeness(own, keys, (cells, now[5]))))
                last = now
            columns = list(zip(*out)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return _in_order(docs).mapInArrow(run, _SCHEMA)
