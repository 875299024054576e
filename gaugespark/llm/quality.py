"""Quality by nearest-neighbour voting in a latent-semantic space.

A bounded sample of labelled documents is turned into term counts, weighed by
sublinear frequency and inverse document frequency, and a singular value
decomposition of them gives the latent space. The sample's vectors are
broadcast (their number and width are parameters); every document's vector is
compared with all of them, a block of documents at a time, by exact cosine
products, and its nearest neighbours vote with their similarity.

Terms are about form, so that all languages share them: trigrams of character
classes over the whole text, and how many words repeat one shortly before them,
hashed to a fixed number of terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugespark.llm.common import pinned
from gaugespark.llm.textarrays import byte_views, lowered, span_hashes, spans

#: The most labelled documents of each class that the model is fitted on.
PER_CLASS = 1500
#: Terms, latent dimensions, neighbours that vote, documents in a block.
TERMS, LATENT, NEIGHBOURS, BLOCK = 2048, 48, 25, 256
#: Vote weight: similarity to this power, so that near neighbours count most.
SHARPNESS = 8
_STEP = 1 << 20


def _classes() -> np.ndarray:
    """A class for each byte: letters by case, digits, white space, others alone."""
    kinds = np.zeros(256, np.int32)
    for b in range(256):
        c = chr(b)
        if b >= 128:
            kinds[b] = 1
        elif c.isdigit():
            kinds[b] = 2
        elif c in "aeiou":
            kinds[b] = 3
        elif "a" <= c <= "z":
            kinds[b] = 4
        elif "A" <= c <= "Z":
            kinds[b] = 5
        elif c == "\n":
            kinds[b] = 6
        elif c.isspace():
            kinds[b] = 7
        else:
            kinds[b] = 8 + b % 33
    return kinds


_CLASSES = _classes()
_SPREAD = 41


def _hashed(x: np.ndarray) -> np.ndarray:
    return ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % TERMS


_TRIGRAM_TERM = _hashed(np.arange(_SPREAD**3)).astype(np.int32)
#: For a word that equals the 1st, 2nd or 3rd before it: some terms for each level
#: of the share of such words, each counted once a word.
_REPEAT_LEVELS = np.array([0.04, 0.1, 0.2, 0.4])
_REPEAT_TERMS = _hashed(_SPREAD**3 + np.arange(3 * 4 * 4)).reshape(3, 4, 4)


def term_counts(buf: np.ndarray) -> np.ndarray:
    """The counts of all terms of one whole text."""
    counts = np.zeros(TERMS)
    for at in range(0, len(buf), _STEP):  # two bytes more, for the trigrams across the cut
        kinds = _CLASSES[buf[at : at + _STEP + 2]]
        if len(kinds) > 2:
            counts += np.bincount(_TRIGRAM_TERM[(kinds[:-2] * _SPREAD + kinds[1:-1]) * _SPREAD + kinds[2:]], minlength=TERMS)
    start, end = spans(buf)
    if len(start):
        words = span_hashes(lowered(buf), start, end)
        for gap in (1, 2, 3):
            share = (words[gap:] == words[:-gap]).mean() if len(words) > gap else 0.0
            counts[_REPEAT_TERMS[gap - 1, : int((share > _REPEAT_LEVELS).sum())]] += len(words)
    return counts


def _damped(counts: np.ndarray) -> np.ndarray:
    return np.log1p(counts)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _sampled(labels: DataFrame, label: str, may_train: Column, per_class: int) -> DataFrame:
    """doc_id, label of at most per_class doc_ids of each class, those of smallest hash; a doc_id labelled both ways is none."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & may_train).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.min(F.col(label).cast("int")).alias("label"), F.max(F.col(label).cast("int")).alias("most")).where("label = most")
    pick = lambda k: known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    return pick(0).union(pick(1))


def fit(docs: DataFrame, labels: DataFrame, may_train: Column, label: str = "quality", per_class: int = PER_CLASS) -> dict | None:
    """The model: idf, projection, the sample's unit vectors and their labels.

    At most 2 * per_class documents, one text (that of least digest) for each
    doc_id; their term counts, not their texts, come to the driver. Labels that
    are repeated count once, those of a doc_id labelled both ways not at all.
    None where no row is labelled.
    """
    sample = F.broadcast(_sampled(labels, label, may_train, per_class))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(sample, "doc_id")
    one = F.min(F.struct(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"), "text"))["text"]
    rows = rows.groupBy("doc_id").agg(one.alias("text"), F.min("label").alias("label")).select("doc_id", "text", "label")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [term_counts(b if b is not None else np.zeros(0, np.uint8)).astype(np.float32).tobytes() for b in byte_views(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], names=["doc_id", "label", "counts"])

    got = sorted((r.doc_id, r.label, bytes(r.counts)) for r in rows.mapInArrow(counted, "doc_id long, label int, counts binary").collect())
    if not got:
        return None
    x = _damped(np.stack([np.frombuffer(c, np.float32) for _, _, c in got]).astype(np.float64))
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1
    x = _unit(x * idf).astype(np.float32)
    projection = _leading(x, min(LATENT, len(x)))
    return {"weights": (idf[:, None] * projection).astype(np.float32), "vectors": _unit(x @ projection).astype(np.float32), "labels": np.array([g[1] for g in got], np.float32)}


def _leading(x: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular vectors of x, by subspace iteration from a fixed start."""
    basis = np.random.default_rng(7).standard_normal((x.shape[1], min(x.shape[1], rank + 16)), np.float32)
    for _ in range(5):
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    _, _, turned = np.linalg.svd(x @ basis, full_matrices=False)
    return (basis @ turned.T)[:, :rank]


def votes(vectors: np.ndarray, model: dict) -> np.ndarray:
    """The score of each row of latent vectors: neighbours' labels, weighed by similarity.

    Cosines count to six digits, since products of blocks of other sizes may
    differ beyond; of equally near neighbours at the last place all vote.
    """
    cosine = np.round(_unit(vectors) @ model["vectors"].T, 6)
    k = min(NEIGHBOURS, cosine.shape[1])
    last = np.partition(cosine, -k, axis=1)[:, -k]
    row, near = np.nonzero((cosine >= last[:, None]) & (cosine > 0))
    weight = cosine[row, near].astype(np.float64) ** SHARPNESS
    total = np.bincount(row, weight, len(cosine))
    score = np.bincount(row, weight * model["labels"][near], len(cosine)) / np.maximum(total, 1e-300)
    return np.where(total > 0, np.round(score, 9), float(model["labels"].mean()))


def _scores(texts: pa.Array, model: dict) -> np.ndarray:
    """The score of each text, a block at a time."""
    scores, block = [np.zeros(0)], []
    for i, b in enumerate(byte_views(texts)):
        block.append(term_counts(b if b is not None else np.zeros(0, np.uint8)))
        if len(block) == BLOCK or i + 1 == len(texts):
            scores.append(votes(_damped(np.stack(block)).astype(np.float32) @ model["weights"], model))
            block = []
    return np.clip(np.concatenate(scores), 0, 1)


def scored(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, score: a row for each row of docs.

    The score depends on the text alone. Null and empty texts, and documents
    like none of the sample, get the sample's mean label; without a model every
    score is 0.5. Repeated rows score alike; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(0.5).alias("score"))
    shared = pinned(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(batch.column(1), shared.value))], names=["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")


def kept(docs: DataFrame, model: dict | None, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that score threshold or more; all without a model.

    Null and empty texts, and documents like none of the sample, score the
    sample's mean label (as in `scored`), so they stay where that reaches the
    threshold. Repeated rows fare alike.
    """
    if model is None:
        return docs
    shared, at = pinned(docs.sparkSession, model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(at).cast(pa.string()), shared.value) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the doc_id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each row of docs.

    Labels of held-out rows are never learnt from. A row without doc_id isn't
    held out. predicted is 1 where the score is 0.5 or more.
    """
    model = fit(docs, labels, ~held_out(F.col("doc_id")), "quality", per_class)
    out = scored(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
