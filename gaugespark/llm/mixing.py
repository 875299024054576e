"""Mixing sources to target weights by hash-random keys and distributed prefix sums.

Every document gets a random key from its doc_id. Within a source the documents
stand in key order; ranges of the key (slots) are summed first, a running sum
over a source's slots gives each slot its offset, and a running sum inside each
slot gives each document the words that stand before it. A source of any size
is thus cut at its exact budget, without its rows meeting in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugespark.llm.common import WORD, stored

#: Bits of the random key, and about how many rows a slot may have on average.
KEY_BITS, ROWS_PER_SLOT = 60, 2048


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """src, source_size, target: sizes has one row per source (src, source, source_size).

    Targets fill up like water: each source gets weight times one common level,
    but no more than cap times its own size; the level is the highest of those
    found when the sources that reach their cap soonest are taken as full.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long")
    weighed = sizes.select("src", "source_size", weight.alias("w"), (F.col("source_size") * cap).alias("full"))
    by_ratio = Window.orderBy(F.col("full") / F.col("w"), "src")
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total, all_w = F.sum("source_size").over(everything), F.sum("w").over(everything)
    left_words = total * F.lit(float(share)) - (F.sum("full").over(upto) - F.col("full")).cast("double")
    left_weight = (all_w - F.sum("w").over(upto) + F.col("w")).cast("double")
    levels = weighed.withColumn("level", left_words / left_weight)
    level = F.max("level").over(everything)
    return levels.select("src", "source_size", F.least(F.col("full").cast("double"), F.col("w") * level).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: a row for each row of docs.

    size counts the words of the text (null: 0). The sources, in code point
    order and null last, weigh weights, repeating, and share `share` times all
    words; no source's target exceeds cap times its words, and the excess goes
    to the others by weight. taken is the words the mix takes of a document,
    repeats counted: whole epochs of its source, and in the last epoch those of
    its words that stand before the cut, so each source's taken words are
    exactly its target rounded down. Rows without doc_id, repeated rows and
    ties of the key stand in order of doc_id and size, and rows alike in both
    are counted by part of the table before they are placed, so that a doc_id
    (or none) that many rows have is a few rows of its range; empty documents
    are taken with 0 words. Other columns of docs are ignored.
    """
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "source",
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("src"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long").alias("key"),
    )
    sized = stored(sized, "sized")
    slots = max(1, sized.count() // ROWS_PER_SLOT)
    shift = max(0, KEY_BITS - slots.bit_length())
    alike = ["src", "source", "key", "doc_id", "size"]
    sized = sized.groupBy(*alike, F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"))
    sized = stored(sized.withColumn("range", F.shiftright("key", shift)).withColumn("words", F.col("size") * F.col("n")), "counted")

    ranges = sized.groupBy("src", "range").agg(F.sum("words").alias("words"), F.first("source").alias("source"))
    sources = ranges.groupBy("src").agg(F.sum("words").alias("source_size"), F.first("source").alias("source"))
    before = Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plan = ranges.select("src", "range", (F.sum("words").over(before) - F.col("words")).alias("offset"))
    plan = plan.join(targets(sources, weights, share, cap), "src")

    within = Window.partitionBy("src", "range").orderBy("key", F.col("doc_id").asc_nulls_last(), "size", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sized.withColumn("before", F.sum("words").over(within) - F.col("words")).join(plan, ["src", "range"])
    one = placed.where("n = 1").withColumn("nth", F.lit(0).cast("long"))
    # rows that are alike are dealt out anew before they are one row each again
    many = stored(placed.where("n > 1"), "alike").repartition("doc_id", "size", "part").withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    placed = one.union(many)
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size")
    stands_before = F.col("offset") + F.col("before") + F.col("nth") * F.col("size")
    taken = epochs * F.col("size") + F.least(F.greatest(rest - stands_before, F.lit(0)), F.col("size"))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents as often as the mix takes them, whole.

    A document that the cut goes through is taken if half of its words or more
    are. Documents without words (null and empty texts too) give the mix
    nothing and are left out. Rows that share doc_id, source and words are all repeated as often as
    the most repeated of them.
    """
    found = mix(docs, **options).where("size > 0")
    copies = found.groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size")).agg(F.max(F.round(F.col("taken") / F.col("size"))).cast("int").alias("_copies")).where("_copies > 0")
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_doc"), F.col("source").alias("_from"), size.alias("_words"))
    same = rows["_doc"].eqNullSafe(copies["_id"]) & rows["_from"].eqNullSafe(copies["_source"]) & (rows["_words"] == copies["_size"])
    taken = rows.join(copies, same).select("_row", F.explode(F.sequence(F.lit(1), "_copies")).alias("_copy"))
    return taken.select("_row.*")


#: op3 in DuckDB's SQL, for the default weights.
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2 * sum(size)::BIGINT AS fully FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w FROM sources
), levels AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5 - (sum(fully) OVER o - fully)::DOUBLE)
            / (sum(w) OVER () - sum(w) OVER o + w)::DOUBLE AS level
  FROM weighed WINDOW o AS (ORDER BY fully::DOUBLE / w, source ROWS UNBOUNDED PRECEDING)
), planned AS (
  SELECT source, source_size, least(fully::DOUBLE, w * max(level) OVER ()) AS target FROM levels
), placed AS (
  SELECT doc_id, size, source_size, target, floor(target)::BIGINT AS budget,
         CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs,
         sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS before
  FROM sized s JOIN planned p ON s.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
       (epochs * size + least(greatest(budget - epochs * source_size - before, 0), size))::BIGINT AS taken
FROM placed
"""
