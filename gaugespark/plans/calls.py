"""Calls: which to make, which are answered, and what a budget allows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugespark.functions.texts import request_key
from gaugespark.operators.keys import keep_one


def expanded(items: DataFrame, systems: Sequence[str], repeats: int, repeated: Column) -> DataFrame:
    """A row for each item, system and repeat; only repeated items have more than one."""
    n = F.when(repeated, repeats).otherwise(1)
    return items.withColumn("system", F.explode(F.array(*[F.lit(s) for s in systems]))).withColumn("repeat", F.explode(F.sequence(F.lit(0), n - 1)))


def keyed(calls: DataFrame, parts: Sequence[str]) -> DataFrame:
    """calls with request_key: a hash of the request as JSON with sorted names."""
    return calls.withColumn("request_key", request_key(F.to_json(F.struct(*[F.col(c) for c in sorted(parts)]))))


def first_written(records: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The first record of each key wins; later ones never replace it."""
    return keep_one(records, [key], order)


def pending(calls: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    return calls.join(answers.select(key).distinct(), key, "left_anti")


def within_budget(calls: DataFrame, group: str, order: Sequence[Column], cost: str, budget: float) -> DataFrame:
    """The calls of each group that a budget pays for, in order."""
    upto = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return calls.withColumn("spent", F.sum(cost).over(upto)).where(F.col("spent") <= budget)


def complete_blocks(calls: DataFrame, block: str, done: Column) -> DataFrame:
    """The calls of blocks in which all are done; blocks are counted, then joined."""
    whole = calls.groupBy(block).agg(F.bool_and(F.coalesce(done, F.lit(False))).alias("_all")).where("_all").select(block)
    return calls.join(whole, block, "left_semi")


def executed(calls: DataFrame, answer: Callable[[dict], dict], fields: str) -> DataFrame:
    """calls with the fields that answer gives for each, and error: a call that fails is a row
    with a message, not a failed task. Batches go through Arrow; nothing is kept between them."""
    names = [part.split()[0] for part in fields.split(",")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in calls.schema.fields) + f", {fields}, error string"

    def run(batches):
        for batch in batches:
            rows = []
            for call in batch.to_dict("records"):
                try:
                    rows.append({**answer(call), "error": None})
                except Exception as failure:  # noqa: BLE001  (it is told in the row)
                    rows.append({"error": f"{type(failure).__name__}: {failure}"})
            for name in [*names, "error"]:
                batch[name] = [r.get(name) for r in rows]
            yield batch

    return calls.mapInPandas(run, schema)
