"""Bootstrap statistics from resample weights, simultaneous intervals, Holm's procedure.

A draw is a number, and a row's weight in a draw is a function of both, so no
weights are stored or sent: rows are first reduced to the sums of their
resampling unit, then spread over the draws, and summed with partial sums.
Where weights are digests, a task works out those of some hundred units at a
time as a matrix, and its sums over all draws are products with it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from hashlib import md5 as _md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugespark.sources.kept import kept

#: Units whose weights are one matrix, elements of a digest's steps at once, and sums that a task holds before it passes them on.
_UNITS, _STEP, _SUMS = 256, 1 << 15, 1 << 22


def poisson_count(u: Column) -> Column:
    """The Poisson(1) count, 8 at most, of a uniform number from 0 to 1."""
    out = F.lit(0)
    for bound in _poisson_bounds():
        out = out + (u >= bound).cast("int")
    return out


def poisson_weight(unit: Column, draw: Column, seed: int = 0) -> Column:
    """The Poisson(1) count of a resampling unit in a draw, from a hash of both."""
    return poisson_count((F.xxhash64(unit, draw, F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1))) / float(1 << 53))


def digest_weight(unit: Column, draw: Column) -> Column:
    """The same from an MD5 digest, which other engines can repeat."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", unit.cast("string"), draw.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    return poisson_count(u / 4294967296.0)


def _poisson_bounds() -> list[float]:
    out, p, cumulative = [], 0.36787944117144233, 0.0
    for k in range(1, 9):
        cumulative += p
        out.append(cumulative)
        p /= k
    return out


_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_PLACES = [(1, 0), (5, 1), (3, 5), (7, 0)]
_FIRST = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Numbers as arrays: a ufunc takes them faster than scalars.
_SHIFTS = [np.array(i, np.uint32) for i in range(33)]


def _leading(prefix: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """The first 32 bits of the MD5 of each prefix with each suffix: words of one padded block, the two or-ed.

    The first four steps are those of prefixes alone as far as words are; the
    others go over flat arrays in place, few enough that a core's cache holds them.
    """
    shape = (len(prefix), len(suffix))
    words = [prefix[:, g, None] | suffix[None, :, g] if prefix[:, g].any() and (suffix[:, g] != suffix[0, g]).any() else prefix[:, g, None] | suffix[:1, g] if (suffix[:, g] == suffix[0, g]).all() else suffix[None, :, g] for g in range(16)]
    same = [int(w[0, 0]) if (w == w[0, 0]).all() else None for w in words]
    a, b, c, d = (np.full((1, 1), x, np.uint32) for x in _FIRST)
    for i in range(4):
        x = (d ^ (b & (c ^ d))) + (words[i] + np.uint32(_SINES[i])) + a
        a, b, c, d = d, (x << _SHIFTS[_TURNS[0][i]] | x >> _SHIFTS[32 - _TURNS[0][i]]) + b, b, c

    def whole(x: np.ndarray) -> np.ndarray:
        out = np.empty(shape, np.uint32)
        out[:] = x
        return out.reshape(-1)

    a, b, c, d = whole(a), whole(b), whole(c), whole(d)
    varied = [whole(w) if s is None else None for w, s in zip(words, same)]
    t, u = np.empty_like(a), np.empty_like(a)
    add, both, either, xor, left, right = np.add, np.bitwise_and, np.bitwise_or, np.bitwise_xor, np.left_shift, np.right_shift
    # the last three steps don't reach the first word
    for i in range(4, 61):
        kind = i // 16
        if kind == 0:
            xor(c, d, u), both(u, b, u), xor(u, d, u)
        elif kind == 1:
            xor(b, c, u), both(u, d, u), xor(u, c, u)
        elif kind == 2 and i % 2 == 0:
            xor(b, c, t), xor(t, d, u)
        elif kind == 2:  # t is c ^ d, of the step before
            xor(t, b, u)
        else:
            np.invert(d, u), either(u, b, u), xor(u, c, u)
        times, plus = _PLACES[kind]
        g, turn = (times * i + plus) % 16, _TURNS[kind][i % 4]
        add(a, u, a)
        if same[g] is None:
            add(a, varied[g], a)
        add(a, np.array(_SINES[i] + (same[g] or 0) & 0xFFFFFFFF, np.uint32), a)
        right(a, _SHIFTS[32 - turn], u), left(a, _SHIFTS[turn], a), either(a, u, a), add(a, b, a)
        a, b, c, d = d, a, b, c
    return (b + np.uint32(_FIRST[0])).byteswap().reshape(shape)


def digest_counts(units: Sequence[str | None], draws: int) -> np.ndarray:
    """digest_weight of each unit (as text) in each of the draws, a row for each unit."""
    bounds = np.array([math.ceil(x * 2**32) for x in _poisson_bounds()], np.uint32)
    steps = [np.array(x) for x in bounds]
    out = np.zeros((len(units), draws), np.uint8)
    prefixes = [b"" if u is None else u.encode() + b":" for u in units]
    sizes = np.array([len(p) for p in prefixes])
    numbers = [str(x).encode() for x in range(draws)]
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        for digits in range(1, len(str(max(draws - 1, 0))) + 1):
            first, last = (10 ** (digits - 1) if digits > 1 else 0), min(10**digits, draws)
            length = size + digits
            if length > 55:  # more than one block
                number = np.array([[int.from_bytes(_md5(prefixes[r] + numbers[x]).digest()[:4], "big") for x in range(first, last)] for r in rows], np.uint32)
                out[rows, first:last] = (number[..., None] >= bounds).sum(-1)
                continue
            suffix = np.zeros((last - first, 64), np.uint8)
            suffix[:, size:length] = np.frombuffer(b"".join(numbers[first:last]), np.uint8).reshape(-1, digits)
            suffix[:, length], suffix[:, 56], suffix[:, 57] = 0x80, 8 * length & 255, 8 * length >> 8
            prefix = np.zeros((len(rows), 64), np.uint8)
            prefix[:, :size] = np.frombuffer(b"".join(prefixes[r] for r in rows), np.uint8).reshape(len(rows), size)
            at_once = max(1, _STEP // len(suffix))
            for k in range(0, len(rows), at_once):
                number = _leading(prefix[k : k + at_once].view("<u4"), suffix.view("<u4"))
                count = np.zeros(number.shape, np.uint8)
                for bound in steps:
                    count += (number >= bound).view(np.uint8)
                out[rows[k : k + at_once], first:last] = count
    return out


def drawn_sums(cells: DataFrame, unit: str, keys: Sequence[str], sums: Sequence[str], draws: int, weight) -> DataFrame:
    """draw, keys, _t, sums: the sums over all cells of a key, each times its unit's weight in the draw, as doubles; _t is that of weights.

    cells has a row for each unit and keys; nulls count as 0. Weights other than
    digests are spread over the draws as rows. A key whose units a draw all leaves
    out has a row of zeros.
    """
    keys, sums = list(keys), list(sums)
    packed = cells.groupBy(F.col(unit).cast("string").alias("_unit")).agg(F.collect_list(F.struct(*keys, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in sums], F.lit(1.0).alias("_t"))).alias("_g"))
    every = ["_t", *sums]
    if weight is not digest_weight:
        spread = over_draws(packed, "_unit", draws, weight).select("draw", "_w", F.inline("_g"))
        return spread.groupBy("draw", *keys).agg(*[F.sum(F.col("_w") * F.col(c)).alias(c) for c in every])
    kinds = dict(cells.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        types, nan = None, float("nan")

        def told() -> Iterator[pa.RecordBatch]:
            for name, found in held.items():
                columns = [pa.array(np.arange(draws, dtype=np.int32)), *[pa.array([x] * draws, kind) for x, kind in zip(name, types)], *[pa.array(x) for x in found]]
                yield pa.RecordBatch.from_arrays(columns, names=["draw", *keys, *every])
            held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, _UNITS):
                part = batch.slice(at, _UNITS)
                listed = part.column(1)
                fields = listed.flatten()
                types = [fields.field(c).type for c in keys]
                owner = np.repeat(np.arange(part.num_rows), np.diff(listed.offsets.to_numpy()))
                # not a number is one key, as Spark groups it
                names = [tuple(nan if x != x else x for x in name) for name in zip(*[fields.field(c).to_pylist() for c in keys])] if keys else [()] * len(owner)
                numbers = {name: i for i, name in enumerate(dict.fromkeys(names))}
                place = np.array([numbers[name] for name in names], np.int64)
                values = np.zeros((part.num_rows, len(numbers), len(every)))
                for i, c in enumerate(every):
                    np.add.at(values, (owner, place, i), fields.field(c).to_numpy(zero_copy_only=False))
                weights = digest_counts(part.column(0).to_pylist(), draws).astype(np.float64)
                found = (values.reshape(part.num_rows, -1).T @ weights).reshape(len(numbers), len(every), draws)
                for name, i in numbers.items():
                    if name in held:
                        held[name] += found[i]
                    else:
                        held[name] = found[i].copy()
                if len(held) * len(every) * draws > _SUMS:
                    yield from told()
        yield from told()

    # digests keep cores busy, not disks: fewer parts than cores would leave some idle
    session = cells.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    schema = ", ".join(["draw int", *[f"`{c}` {kinds[c]}" for c in keys], *[f"`{c}` double" for c in every]])
    # a hash of the unit: dealt by the unit itself, as packed already is, the rows would stay in as few tasks as their bytes ask for
    parts = packed.repartition(tasks, F.xxhash64("_unit")).mapInArrow(run, schema)
    return parts.groupBy("draw", *keys).agg(*[F.sum(c).alias(c) for c in every])


def over_draws(units: DataFrame, unit: str, draws: int, weight) -> DataFrame:
    """units once for each draw, with draw and its weight _w, zeros included.

    Blocks of 50 draws are dealt to as many tasks as a shuffle has. A filter of
    _w here would be pushed under the weight and work it out again.
    """
    tasks = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = units.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(50)))).repartition(tasks, unit, "_b")
    spread = blocks.withColumn("draw", F.explode(F.sequence(F.col("_b"), F.least(F.col("_b") + 49, F.lit(draws - 1)))))
    return spread.drop("_b").withColumn("_w", weight(F.col(unit), F.col("draw")))


def drawn_means(df: DataFrame, unit: str, value: Column, draws: int, weight, group: list[str] | None = None) -> DataFrame:
    """draw, mean (for each group): weighted means of all draws; weight(unit, draw) gives a count."""
    group = group or []
    units = df.groupBy(unit, *group).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    sums = drawn_sums(units, unit, group, ["_s", "_n"], draws, weight).where("_t > 0")
    # a table: intervals that hold for a family read it more than once
    return kept(sums.select("draw", *group, F.try_divide("_s", "_n").alias("mean")), "draws")


def interval(draws: DataFrame, value: str, group: list[str] | None = None, level: float = 0.95) -> DataFrame:
    """low, high: linear percentiles over draws; draws without a value don't count."""
    low = (1 - level) / 2
    return draws.groupBy(*(group or [])).agg(F.percentile(value, low).alias("low"), F.percentile(value, 1 - low).alias("high"), F.stddev_samp(value).alias("se"))


def two_sided_p(draws: DataFrame, value: str) -> DataFrame:
    below, above, n = F.count_if(F.col(value) <= 0), F.count_if(F.col(value) >= 0), F.count(value)
    return draws.agg(F.least(F.lit(1.0), 2 * (F.least(below, above) + 1) / (n + 1)).alias("p"))


def simultaneous(draws: DataFrame, point: DataFrame, member: str, value: str, level: float = 0.95) -> DataFrame:
    """member, point, low, high: intervals that hold for all members together (max-t)."""
    spread = draws.groupBy(member).agg(F.stddev_samp(value).alias("se"), F.avg(value).alias("centre"))
    t = draws.join(spread, member).where("se > 0").groupBy("draw").agg(F.max(F.abs(F.col(value) - F.col("centre")) / F.col("se")).alias("t"))
    critical = t.agg(F.percentile("t", level).alias("c"))
    return point.join(spread, member).join(F.broadcast(critical)).select(member, value, (F.col(value) - F.col("c") * F.col("se")).alias("low"), (F.col(value) + F.col("c") * F.col("se")).alias("high"))


def holm(df: DataFrame, p: str, tie: str, group: list[str] | None = None) -> DataFrame:
    """df with holm_p: a family's p values, each the running largest of (m - i) p.

    A family is at most a few hundred tests, so one task has it whole.
    """
    family = Window.partitionBy(*(group or [])).orderBy(p, tie)
    everything = Window.partitionBy(*(group or []))
    step = F.least(F.lit(1.0), (F.count("*").over(everything) - F.row_number().over(family) + 1) * F.col(p))
    stepped = df.withColumn("_step", step)
    return stepped.withColumn("holm_p", F.max("_step").over(family.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_step")


def holm_bounds(draws: DataFrame, member: str, value: str, margin: float, alpha: float = 0.025) -> DataFrame:
    """member, bound, ok: step-down lower bounds of a family's differences, ok where above -margin.

    Members are taken in order of their draws at or below -margin (the larger
    median first, then by name); step i of m has level alpha / (m - i + 1) and
    the lower order statistic at it. From the first bound that isn't above
    -margin on, all keep that step's level and are not ok. A row of draws a
    member, as many as there are draws, and as many rows as members.
    """
    per = draws.groupBy(member).agg(F.sort_array(F.collect_list(value)).alias("_v"), F.count_if(F.col(value) <= -margin).alias("_k"), F.percentile(value, 0.5).alias("_median"))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = per.withColumn("_i", F.row_number().over(Window.orderBy("_k", -F.col("_median"), member)) - 1).withColumn("_m", F.count("*").over(whole))
    bound = lambda i: F.get("_v", F.floor(alpha / (F.col("_m") - i) * (F.size("_v") - 1)).cast("int"))
    stopped = ranked.withColumn("_stop", F.min(F.when(bound(F.col("_i")) <= -margin, F.col("_i"))).over(whole))
    step = F.least("_i", F.coalesce("_stop", "_i"))
    return stopped.select(member, bound(step).alias("bound"), (F.col("_stop").isNull() | (F.col("_i") < F.col("_stop"))).alias("ok"))


def holm_outcomes(draws: DataFrame, member: str, value: str, margin: float, alpha: float = 0.025) -> DataFrame:
    """member, lower, upper, outcome: non-inferior by the lower bounds, else worse by the upper ones, else inconclusive."""
    low = holm_bounds(draws, member, value, margin, alpha).select(member, F.col("bound").alias("lower"), F.col("ok").alias("_above"))
    mirrored = draws.withColumn("_mirror", -F.col(value))
    high = holm_bounds(mirrored, member, "_mirror", -margin, alpha).select(member, (-F.col("bound")).alias("upper"), F.col("ok").alias("_below"))
    outcome = F.when(F.col("_above"), "non-inferior").when(F.col("_below"), "worse").otherwise("inconclusive")
    return low.join(high, member).select(member, "lower", "upper", outcome.alias("outcome"))


def stratified_means(units: DataFrame, unit: str, stratum: str, value: Column, draws: int, weight) -> DataFrame:
    """draw, mean: units resampled within their stratum; every draw has the strata at their own shares.

    A stratum that a draw leaves empty is left out of that draw's mean.
    """
    cells = units.groupBy(unit, stratum).agg(F.count("*").alias("_n"), F.sum(value).alias("_s"))
    sums = drawn_sums(cells, unit, [stratum], ["_n", "_s"], draws, weight).where("_n > 0").select("draw", stratum, F.col("_n").alias("_t"), "_s")
    total = units.agg(F.count("*").alias("_all"))
    shares = units.groupBy(stratum).agg(F.count("*").alias("_n")).join(F.broadcast(total)).select(stratum, (F.col("_n").cast("double") / F.col("_all")).alias("_share"))
    return sums.join(F.broadcast(shares), stratum).groupBy("draw").agg((F.sum(F.col("_share") * F.col("_s").cast("double") / F.col("_t")) / F.sum("_share")).alias("mean"))


def marginal_only(df: DataFrame, prefix: str = "simultaneous_") -> DataFrame:
    """df without the columns of simultaneous intervals."""
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])


def verdict(low: Column, high: Column, margin: float) -> Column:
    """How a difference (lower is better) stands to a margin."""
    return F.when(high < margin, F.when(high < 0, "better").otherwise("non-inferior")).when(low > margin, "worse").otherwise("inconclusive")
