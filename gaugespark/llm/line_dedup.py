"""Line dedup: lines that several documents hold stay in the first of them only.

Lines are exploded and hashed to 128 bits, kept as a table of hashes and places;
one aggregation finds the hashes that more than one document holds, with the
smallest doc_id; a join marks the places where they must go, and each document
is put together again by position. A line that a third of all documents hold
costs one partial row per task in the aggregation. The shared hashes and the
places are tables too, so that both sides of each join have a shuffle of their
own: only then can adaptive execution split a hot hash or a hot doc_id. The
joins are merge joins at every size, since those tables grow with the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugespark.llm.common import SPACES, ascii_lower, stored

MIN_CHARS = 10


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def repeated_places(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, places: the line numbers (from 0) that a document loses."""
    lines = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(_lines(F.col("text"))).alias("place", "line"))
    key = ascii_lower(F.btrim("line", F.lit(SPACES)))
    keyed = lines.select("doc_id", "place", key.alias("key")).where(F.length("key") >= min_chars)
    hashed = stored(keyed.select("doc_id", "place", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")), "line-hashes")
    shared = hashed.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("h1", "h2", "first")
    places = hashed.join(stored(shared, "shared-lines").hint("merge"), ["h1", "h2"]).where("doc_id <> first")
    return places.groupBy("doc_id").agg(F.collect_set("place").alias("places"))


def deduped_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, kept_text, n_lines, n_dropped: a row for each row of docs.

    A text is split at \\n (null or empty: one empty line). A line's key is the
    line without ASCII white space at both ends, A-Z lower-cased. Keys of
    min_chars code points or more that two or more documents hold lose all
    their lines but those in the smallest doc_id; the rest is joined by \\n.
    Rows without doc_id neither lose lines nor count as holding any; rows that
    repeat a doc_id count as one document and lose the lines that either of
    them must lose at the same place. Other columns of docs are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    places = stored(repeated_places(docs, min_chars), "places")
    lines = rows.join(places.hint("merge"), "doc_id", "left").withColumn("lines", _lines(F.col("text")))
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    kept = F.when(F.col("places").isNull(), F.col("lines")).otherwise(F.transform(F.array_except(every, F.col("places")), lambda i: F.get("lines", i)))
    out = lines.select("doc_id", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept"))
    return out.select("doc_id", F.array_join("kept", "\n").alias("kept_text"), "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"))


#: op6 in DuckDB's SQL.
ORACLE = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS place, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), marked AS (
  SELECT k.*, s.first IS NOT NULL AND s.first <> doc_id AS gone FROM keyed k LEFT JOIN shared s USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
