"""Bootstrap draws with exact totals: each draw takes as many units as a stratum has.

A stratum's n picks are split down a binary tree over the hash range of its
units: of the c picks at a node, those whose number (a hash of draw, node and
pick) falls under the share of units in the node's left half go left. Nodes are
split until a leaf has some hundred units; there each pick takes one of them.
Counts are multinomial, every draw's sum to n, and no unit has to know its rank
among all. What is shuffled is a row for each draw and node, not for each unit,
and LEVELS of the tree are split in one step. Picks are no rows: a task hashes
those of a node as vectors and counts them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugespark.sources.kept import kept

#: About how many units a leaf has, how many picks are hashed at once, and how many levels are split in a step.
LEAF, PICKS, LEVELS = 1024, 1 << 15, 8
#: Rows that a task holds before it passes them on; arithmetic that rounds no decimal.
_ROWS, _EXACT = 1 << 18, Context(prec=60)
_FACTOR, _RANGE = 73244475, 1 << 32


def mixed(x: Column) -> Column:
    """A 32-bit number mixed twice; the products stay under 2 ** 63."""
    for factor in (_FACTOR, _FACTOR, 1):
        x = F.shiftright(x, 16).bitwiseXOR(x) * factor % _RANGE
    return x


def mixed_sql(x: str) -> str:
    """The same in DuckDB's SQL."""
    return f"list_reduce([({x})::BIGINT, {_FACTOR}, {_FACTOR}, 1], lambda a, f: xor(a >> 16, a) * f % {_RANGE})"


def text_hash(c: Column) -> Column:
    """The first 32 bits of a value's MD5, as a number."""
    return F.conv(F.substring(F.md5(c.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")


def _mixed(x: np.ndarray) -> np.ndarray:
    """mixed of 32-bit numbers, in their place."""
    for factor in (_FACTOR, _FACTOR, 1):
        x ^= x >> np.uint32(16)
        x *= np.uint32(factor)
    return x


def _numbers(keys: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """first row, row after the last, where each row's begin, numbers: those of all picks of rows, some PICKS at once."""
    ends = np.cumsum(counts)
    at = 0
    while at < len(counts):
        if counts[at] > PICKS:
            for k in range(0, int(counts[at]), PICKS):
                some = np.arange(k, min(k + PICKS, int(counts[at])), dtype=np.int64).astype(np.uint32)
                yield at, at + 1, np.zeros(1, np.int64), _mixed(some + keys[at])
            at += 1
            continue
        stop = int(np.searchsorted(ends, ends[at] - counts[at] + PICKS, "right"))
        some = counts[at:stop]
        starts = np.cumsum(some) - some
        numbers = np.repeat(keys[at:stop] - starts.astype(np.uint32), some)
        numbers += np.arange(len(numbers), dtype=np.uint32)
        yield at, stop, starts, _mixed(numbers)
        at = stop


def _descended(node: int, c: int, seed: int, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that c picks at a node reach, some levels down, and the picks of each; sizes are those of all nodes there."""
    levels = [sizes.astype(np.uint64)]
    while len(levels[0]) > 1:
        levels.insert(0, levels[0].reshape(-1, 2).sum(1))
    nodes, counts = np.zeros(1, np.int64), np.array([c], np.int64)
    for depth, (own, below) in enumerate(zip(levels, levels[1:])):
        keys = _mixed(((node << depth) + nodes).astype(np.uint32) ^ np.uint32(seed))
        m, left = np.maximum(own[nodes], np.uint64(1)), below[2 * nodes]
        # number * m < left * 2 ** 32, as a last number
        last = ((left << np.uint64(32)) + m - np.uint64(1)) // m
        some, last = last > 0, np.maximum(last, np.uint64(1)) - np.uint64(1)
        last = np.minimum(last, np.uint64(_RANGE - 1)).astype(np.uint32)
        went = np.zeros(len(nodes), np.int64)
        for first, stop, starts, numbers in _numbers(keys, counts):
            if stop == first + 1:
                went[first] += np.count_nonzero(numbers <= last[first])
            else:
                goes = numbers <= np.repeat(last[first:stop], counts[first:stop])
                went[first:stop] = np.add.reduceat(goes.view(np.uint8), starts, dtype=np.int64)
        went *= some
        nodes, counts = np.stack([2 * nodes, 2 * nodes + 1], 1).ravel(), np.stack([went, counts - went], 1).ravel()
        nodes, counts = nodes[counts > 0], counts[counts > 0]
    return (node << (len(levels) - 1)) + nodes, counts


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """stratum, draw, n, node, c, seed of the nodes some levels below each row's; places and sizes are those of units there."""
    for batch in batches:
        named = {c: batch.column(c) for c in ("stratum", "draw", "n", "node", "c", "seed", "wide")}
        node, c, seed, wide = (named[x].to_pylist() for x in ("node", "c", "seed", "wide"))
        listed = _listed(batch.column("below"))
        held, found = 0, []

        def told() -> pa.RecordBatch:
            row = np.repeat([f[0] for f in found], [len(f[1]) for f in found])
            of = {x: named[x].take(pa.array(row)) for x in ("stratum", "draw", "n", "seed")}
            of |= {"node": pa.array(np.concatenate([f[1] for f in found])), "c": pa.array(np.concatenate([f[2] for f in found]))}
            return pa.RecordBatch.from_pydict({x: of[x] for x in ("stratum", "draw", "n", "node", "c", "seed")})

        for i, (place, m) in enumerate(listed):
            sizes = np.zeros(wide[i], np.int64)
            sizes[place] = m
            found.append((i, *_descended(node[i], c[i], seed[i], sizes)))
            held += len(found[-1][1])
            if held > _ROWS:
                yield told()
                held, found = 0, []
        if found:
            yield told()


def _listed(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """place and m of each row's list."""
    fields, offsets = column.flatten(), column.offsets.to_numpy() - column.offsets[0].as_py()
    place, m = fields.field("place").to_numpy(), fields.field("m").to_numpy()
    for a, b in zip(offsets, offsets[1:]):
        yield place[a:b], m[a:b]


def _whole(values: pa.Array, most: int) -> np.ndarray:
    """Values as whole numbers (decimals by their last digit): Python's own where most of the largest might pass 63 bits."""
    if pa.types.is_floating(values.type):
        return values.to_numpy()
    if pa.types.is_decimal(values.type):
        scale = values.type.scale
        exact = [int(x.scaleb(scale, _EXACT)) for x in values.to_pylist()]
    else:
        exact = values.to_pylist()
    fits = max(map(abs, exact), default=0) * most < 1 << 63
    return np.array(exact, np.int64 if fits else object)


def _taken(sums: list[str], kinds: list[pa.DataType]):
    """A function of a leaf's picks in all draws and its units: what each draw's picks sum to."""
    schema = pa.schema([("draw", pa.int32()), ("stratum", pa.string()), ("n", pa.int64()), ("taken", pa.int64()), *zip([f"_{c}" for c in sums], kinds)])

    def run(key: tuple[pa.Scalar, ...], picks: pa.Table, leaf: pa.Table) -> pa.Table:
        if not picks.num_rows or not leaf.num_rows:
            return schema.empty_table()
        units = leaf.column("units").combine_chunks().flatten()
        counts = picks.column("c").to_numpy()
        keys = picks.column("seed").to_numpy().astype(np.uint32) ^ np.uint32((key[1].as_py() + (1 << 31)) % _RANGE)
        keys = _mixed(keys)
        values = [_whole(units.field(c), int(counts.max())) for c in sums]
        out = [np.zeros(len(counts), v.dtype) for v in values]
        for first, stop, starts, numbers in _numbers(keys, counts):
            place = (numbers.astype(np.uint64) * np.uint64(len(units)) >> np.uint64(32)).astype(np.int64)
            for v, o in zip(values, out):
                o[first:stop] += np.add.reduceat(v[place], starts)
        told = [pa.array([Decimal(int(x)).scaleb(-t.scale, _EXACT) for x in o], t) if pa.types.is_decimal(t) else pa.array(o.tolist() if o.dtype == object else o, t) for o, t in zip(out, kinds)]
        fixed = [picks.column("draw").combine_chunks(), pa.array([key[0].as_py()] * len(counts), pa.string()), picks.column("n").combine_chunks(), pa.array(counts)]
        return pa.Table.from_arrays([*fixed, *told], schema=schema)

    return run


def exact_sums(units: DataFrame, unit: str, sums: list[str], draws: int, stratum: str | None = None, leaf: int = LEAF) -> DataFrame:
    """draw, stratum, n, taken, and each of sums over the units that the draw takes, with repeats.

    units has a row for each unit, whose values are whole numbers or decimals;
    nulls count as 0. n is the stratum's number of units, and taken that of the
    draw, which is the same. A null stratum is the empty text's. An empty table
    has no draws.
    """
    of = F.coalesce(F.col(stratum).cast("string"), F.lit("")) if stratum else F.lit("")
    rows = units.select(of.alias("stratum"), text_hash(F.col(unit)).alias("h"), F.col(unit).cast("string").alias("_unit"), *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in sums])
    kinds = dict(rows.dtypes)
    wide = {c: "double" if kinds[c] in ("double", "float") else "decimal(38,6)" if kinds[c].startswith("decimal") else "long" for c in sums}
    rows = rows.select("stratum", "h", "_unit", *[F.col(c).cast(wide[c]).alias(c) for c in sums])
    largest = rows.groupBy("stratum").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    deep = max(0, math.ceil(math.log2(largest / leaf))) if largest else 0
    placed = rows.withColumn("node", F.lit(1 << deep).cast("long") + F.shiftright("h", 32 - deep))
    leaves = kept(placed.groupBy("stratum", "node").agg(F.count("*").alias("m"), F.sort_array(F.collect_list(F.struct("h", "_unit", *sums))).alias("units")), "leaves")
    strata = kept(leaves.groupBy("stratum").agg(F.sum("m").alias("n")), "strata")
    tasks = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    state = strata.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    state = state.select("stratum", "draw", "n", F.lit(1).cast("long").alias("node"), F.col("n").alias("c"), mixed((text_hash(F.col("stratum")) + F.col("draw")) % _RANGE).alias("seed"))
    at = 0
    while at < deep:
        # blocks of LEVELS from the leaves up, so that only the first may be smaller
        down = (deep - at - 1) % LEVELS + 1
        at += down
        sizes = leaves.groupBy("stratum", F.shiftright("node", deep - at).alias("lower")).agg(F.sum("m").alias("m"))
        place = F.col("lower").bitwiseAND(F.lit((1 << down) - 1)).cast("int")
        below = sizes.groupBy("stratum", F.shiftright("lower", down).alias("node")).agg(F.collect_list(F.struct(place.alias("place"), "m")).alias("below"))
        met = state.join(below, ["stratum", "node"]).withColumn("wide", F.lit(1 << down))
        state = met.repartition(tasks, F.xxhash64("stratum", "draw", "node")).mapInArrow(_split, "stratum string, draw int, n long, node long, c long, seed long")
    # a leaf's own picks have other keys than a node's
    types = {"double": pa.float64(), "long": pa.int64(), "decimal(38,6)": pa.decimal128(38, 6)}
    schema = ", ".join(["draw int, stratum string, n long, taken long", *[f"`_{c}` {wide[c]}" for c in sums]])
    units_of = leaves.select("stratum", "node", "units")
    picked = state.groupBy("stratum", "node").cogroup(units_of.groupBy("stratum", "node")).applyInArrow(_taken(sums, [types[wide[c]] for c in sums]), schema)
    return picked.groupBy("draw", "stratum", "n").agg(F.sum("taken").alias("taken"), *[F.sum(f"_{c}").alias(c) for c in sums])


def exact_sums_sql(units: str, sums: list[str], draws: int, leaf: int = LEAF) -> str:
    """exact_sums of a CTE (unit, stratum, sums) in DuckDB's SQL, as CTEs ending in drawn; needs WITH RECURSIVE."""
    number = "('0x' || substr(md5({}::VARCHAR), 1, 8))::BIGINT"
    fields = ", ".join(f"'{c}': {c}" for c in sums)
    picked = ", ".join(f"sum(list_sum(list_transform(picks, lambda i: units[i + 1].{c}))) AS {c}" for c in sums)
    return f"""hashed AS (SELECT *, {number.format("unit")} AS h FROM {units}),
deep AS (SELECT greatest(0, ceil(log2(max(n) / {leaf}::DOUBLE)))::INT AS d FROM (SELECT count(*) AS n FROM hashed GROUP BY stratum)),
placed AS (SELECT *, (1::BIGINT << d) + (h >> (32 - d)) AS leaf FROM hashed CROSS JOIN deep),
leaves AS (SELECT stratum, leaf, list({{{fields}}} ORDER BY h, unit::VARCHAR) AS units FROM placed GROUP BY ALL),
sizes AS (SELECT stratum, leaf >> up AS node, count(*) AS m FROM (SELECT stratum, leaf, unnest(range(d + 1)) AS up FROM placed) GROUP BY ALL),
tree AS (SELECT stratum, draw, {mixed_sql(f"({number.format('stratum')} + draw) % {_RANGE}")} AS seed, 1::BIGINT AS node, n AS c, 0 AS level
  FROM (SELECT stratum, count(*) AS n FROM hashed GROUP BY 1) CROSS JOIN (SELECT unnest(range({draws})) AS draw)
  UNION ALL
  SELECT stratum, draw, seed, unnest([2 * node, 2 * node + 1]) AS node, unnest([went, c - went]) AS c, level + 1 FROM (
    SELECT stratum, draw, seed, node, c, level, len(list_filter(range(c), lambda k: {mixed_sql(f"(key + k) % {_RANGE}")} * m < coalesce(l, 0) * {_RANGE})) AS went
    FROM (SELECT t.*, s.m, z.m AS l, {mixed_sql("xor(seed, t.node)")} AS key FROM tree t JOIN sizes s ON s.stratum = t.stratum AND s.node = t.node LEFT JOIN sizes z ON z.stratum = t.stratum AND z.node = 2 * t.node
          WHERE level < (SELECT d FROM deep) AND c > 0))),
picked AS (SELECT stratum, draw, c, units, list_transform(range(c), lambda k: ({mixed_sql(f"(key + k) % {_RANGE}")} * len(units)) >> 32) AS picks
  FROM (SELECT t.*, units, {mixed_sql(f"xor(seed, (t.node + {1 << 31}) % {_RANGE})")} AS key FROM tree t JOIN leaves v ON v.stratum = t.stratum AND v.leaf = t.node WHERE level = (SELECT d FROM deep) AND c > 0)),
drawn AS (SELECT stratum, draw, sum(c) AS taken, {picked} FROM picked GROUP BY ALL)"""
