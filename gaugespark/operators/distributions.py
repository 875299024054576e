"""Joint distributions of several parts, folded inside the row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def joint(parts: Sequence[Column]) -> Column:
    """The product of part distributions: an array of (labels, p), a row's parts being arrays of (label, p).

    Parts are short lists of levels (a handful each), and so is their product. A
    null or empty part makes the product empty.
    """
    start = F.array(F.struct(F.array().cast("array<string>").alias("labels"), F.lit(1.0).alias("p")))

    def times(held: Column, part: Column) -> Column:
        add = lambda h: F.transform(F.coalesce(part, F.array().cast("array<struct<label:string,p:double>>")), lambda x: F.struct(F.concat(h["labels"], F.array(x["label"])).alias("labels"), (h["p"] * x["p"]).alias("p")))
        return F.flatten(F.transform(held, add))

    held = start
    for part in parts:
        held = times(held, part)
    return held


def level_distribution(product: Column, level) -> Column:
    """A map of level to probability, given that there is one: level(labels) is null where labels are no level.

    Empty where no labels are any level, or all that are have no probability.
    """
    staged = F.filter(F.transform(product, lambda x: F.struct(level(x["labels"]).alias("level"), x["p"].alias("p"))), lambda x: x["level"].isNotNull())
    whole = F.aggregate(staged, F.lit(0.0), lambda a, x: a + x["p"])
    names = F.array_sort(F.array_distinct(F.transform(staged, lambda x: x["level"])))
    share = lambda name: F.aggregate(F.filter(staged, lambda x: x["level"] == name), F.lit(0.0), lambda a, x: a + x["p"])
    told = F.map_from_entries(F.transform(names, lambda name: F.struct(name, (share(name) / whole).alias("p"))))
    return F.when(whole > 0, told).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")))
