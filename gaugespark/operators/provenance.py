"""Order-free digests of result sets by block, and the cells in which two of them differ.

A row's digest is a hash of its key, columns' names and values; a block's is the
sum of its rows' digests, so neither order nor partitioning counts, and partial
sums do. Two result sets are compared from the top: the whole, then blocks of
keys, and only rows of blocks that differ meet in a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks of a result set, whatever its size.
BLOCKS = 4096


def _cells(columns: Sequence[str]) -> Column:
    """Each column's name and value as text; a null differs from every text."""
    told = lambda c: F.struct(F.lit(c).alias("column"), F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"}).alias("value"))
    return F.array(*[told(c) for c in columns])


def _row_digest(keys: Sequence[str], columns: Sequence[str]) -> Column:
    return F.xxhash64(F.to_json(F.struct(*keys)), F.to_json(_cells(columns))).cast("decimal(38,0)")


def _block(keys: Sequence[str], blocks: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(blocks)).cast("int")


def digests(df: DataFrame, keys: Sequence[str], blocks: int = BLOCKS) -> DataFrame:
    """block, n, digest: a row for each block that has rows, whatever their order."""
    columns = sorted(c for c in df.columns if c not in keys)
    return df.groupBy(_block(keys, blocks).alias("block")).agg(F.count("*").alias("n"), F.sum(_row_digest(keys, columns)).alias("digest"))


def changed(left: DataFrame, right: DataFrame, keys: Sequence[str], blocks: int = BLOCKS) -> DataFrame:
    """keys, column, change, left, right: the cells that differ, values as JSON.

    change is `changed`, or `added` or `removed` for the cells (other than null)
    of a key that one side lacks, or a column that one side lacks. Keys are
    unique on each side; a null is a key's value like any other.
    """
    keys = list(keys)
    one, two = digests(left, keys, blocks).alias("a"), digests(right, keys, blocks).alias("b")
    same = F.col("a.n").eqNullSafe(F.col("b.n")) & F.col("a.digest").eqNullSafe(F.col("b.digest"))
    # at most `blocks` rows
    differing = one.join(two, F.col("a.block") == F.col("b.block"), "full").where(~same).select(F.coalesce("a.block", "b.block").alias("_block"))

    def cells(df: DataFrame, side: str) -> DataFrame:
        columns = sorted(c for c in df.columns if c not in keys)
        met = df.withColumn("_block", _block(keys, blocks)).join(F.broadcast(differing), "_block", "left_semi")
        return met.select(*[F.col(k).alias(f"{side}_{k}") for k in keys], F.explode(_cells(columns)).alias("cell")).select("*", F.col("cell.column").alias(f"{side}_column"), F.col("cell.value").alias(side)).drop("cell")

    every = [*keys, "column"]
    on = F.lit(True)
    for k in every:
        on = on & F.col(f"l_{k}" if k != "column" else "l_column").eqNullSafe(F.col(f"r_{k}" if k != "column" else "r_column"))
    l_side, r_side = cells(left, "l"), cells(right, "r")
    both = l_side.join(r_side, on, "full")
    null = '{"v":null}'
    change = F.when(F.col("l").isNull() & (F.col("r") != null), "added").when(F.col("r").isNull() & (F.col("l") != null), "removed").when(F.col("l") != F.col("r"), "changed")
    told = [F.coalesce(f"l_{k}", f"r_{k}").alias(k) for k in every]
    value = lambda c: F.get_json_object(c, "$.v")
    return both.withColumn("change", change).where("change is not null").select(*told, "change", value("l").alias("left"), value("r").alias("right"))
