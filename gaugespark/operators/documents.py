"""Nested documents as rows of their leaves, at any depth, and the differences of two documents.

Texts become Spark's VARIANT, and each round opens some levels of all documents at
once, a leaf standing for itself; what is a leaf stays out of the next round. A path is `$.name[place].name`,
with names in quotes where they are not plain.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugespark.sources.kept import kept

#: Levels that a round opens.
LEVELS = 4


def _kind(told: Column) -> Column:
    """object, array, text, number, boolean or null: what a VARIANT of that schema holds."""
    number = told.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    return (
        F.when(told.startswith("OBJECT"), "object").when(told.startswith("ARRAY"), "array").when(told == "STRING", "text")
        .when(number, "number").when(told == "BOOLEAN", "boolean").when(told == "VOID", "null").otherwise(F.lower(told))
    )


def leaves(df: DataFrame, keys: Sequence[str], document: str) -> DataFrame:
    """keys, path, kind, value: a row for each leaf of each document.

    A leaf is a text, number, boolean or null, or an empty object or array; its
    value is its JSON without quotes around texts, null for null. A document that
    is null or no JSON has one row, with path `$` and kind `unreadable`.
    """
    keys, spark = list(keys), df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # few bytes of text are many leaves, so documents are dealt to all tasks
    now = df.select(*keys, F.col(document).alias("_doc")).repartition(tasks).select(*keys, F.lit("$").alias("path"), F.try_parse_json("_doc").alias("v"))
    found = []
    while True:
        for _ in range(LEVELS):
            step = now.lateralJoin(spark.tvf.variant_explode_outer(F.col("v").outer()))
            plain = F.col("key").rlike("^[A-Za-z_][A-Za-z0-9_]*$")
            name = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos"), F.lit("]"))).when(plain, F.concat(F.lit("."), F.col("key"))).otherwise(F.concat(F.lit('."'), F.col("key"), F.lit('"')))
            # what can't be opened has no value below it
            now = step.select(*keys, F.when(F.col("value").isNull(), F.col("path")).otherwise(F.concat("path", name)).alias("path"), F.coalesce("value", "v").alias("v"))
        told = now.withColumn("_told", F.schema_of_variant("v")).withColumn("text", F.to_json("v"))
        told = told.withColumn("kind", F.when(F.col("v").isNull(), "unreadable").otherwise(_kind(F.col("_told"))))
        full = F.col("kind").isin("object", "array") & ~F.col("text").isin("{}", "[]")
        value = F.when(F.col("kind") == "text", F.variant_get("v", "$", "string")).when(F.col("kind") != "null", F.col("text"))
        level = kept(told.select(*keys, "path", "kind", full.alias("_full"), F.when(~full, value).alias("value"), F.when(full, F.col("v")).alias("v")), "level")
        found.append(level.where(~F.col("_full")).select(*keys, "path", "kind", "value"))
        now = level.where("_full").select(*keys, "path", "v")
        if now.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def differences(left: DataFrame, right: DataFrame, keys: Sequence[str], document: str, blocking: Sequence[str] = (), harmless: Sequence[str] = ()) -> DataFrame:
    """keys, path, change, left, right, severity: where two documents of one key differ.

    change is `added`, `removed` or `changed` (in kind or value; numbers are
    compared as they are written). severity is `blocking` for the paths that one
    of those patterns finds, else `harmless` for those of the others, else
    `notable`. A key that one side lacks has its whole document added or removed.
    """
    keys = list(keys)
    of = lambda df, side: leaves(df, keys, document).select(*keys, "path", F.struct("kind", "value").alias(side))
    both = of(left, "l").join(of(right, "r"), [*keys, "path"], "full")
    change = F.when(F.col("l").isNull(), "added").when(F.col("r").isNull(), "removed").when(~F.col("l").eqNullSafe(F.col("r")), "changed")
    hit = lambda patterns: reduce(lambda a, p: a | F.col("path").rlike(p), patterns, F.lit(False))
    severity = F.when(hit(blocking), "blocking").when(hit(harmless), "harmless").otherwise("notable")
    return both.withColumn("change", change).where("change is not null").select(*keys, "path", "change", F.col("l.value").alias("left"), F.col("r.value").alias("right"), severity.alias("severity"))
