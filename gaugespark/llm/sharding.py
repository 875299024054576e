"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records are hashed by text into a fixed number of virtual slots, so equal texts
stay together; the bytes of each slot are summed, and whole slots are dealt to
shards, the heaviest first, each to the least loaded shard. Texts whose copies
alone exceed a shard's even share are salted by doc_id. Rebalancing edits the
map, not the hash: it moves few slots and adds a version.

Rows are numbered in a shard slot by slot, within a slot in order of a hash of
doc_id: a slot is cut into ranges of that hash, of about ROWS_PER_RANGE rows, and
rows that are alike in all columns are counted, not sorted, so that neither a
slot with a third of all rows (short texts weigh few bytes) nor one row repeated
that often lands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugespark.llm.common import stored

SLOTS = 4096
SHARDS = 16
ROWS_PER_RANGE = 512


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")


def _hash32(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def _slot_of(digest: Column) -> Column:
    return (_hash32(digest) % SLOTS).cast("int")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32, digest of each row's text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(_text()) + 1).cast("long").alias("size"), F.crc32(_text()).alias("text_crc32"), F.md5(_text()).alias("digest"))


def heavy_texts(records: DataFrame, n_shards: int) -> DataFrame:
    """The digests of texts whose copies exceed the even share: under n_shards of them."""
    groups = records.groupBy("digest").agg(F.sum("size").alias("bytes"))
    share = records.agg((F.sum("size") / n_shards).alias("share"))
    return groups.join(F.broadcast(share), F.col("bytes") > F.col("share")).select("digest")


def with_slots(records: DataFrame, heavy: DataFrame) -> DataFrame:
    """Adds virtual_slot: by text, or by text and doc_id for heavy texts."""
    marked = records.join(F.broadcast(heavy.withColumn("heavy", F.lit(True))), "digest", "left")
    salted = F.md5(F.concat(F.col("digest"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    return marked.withColumn("virtual_slot", F.when(F.col("heavy"), _slot_of(salted)).otherwise(_slot_of(F.col("digest")))).drop("heavy")


def slot_bytes(records: DataFrame) -> DataFrame:
    """virtual_slot, bytes, rows: at most SLOTS rows."""
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def _dealt(weights: DataFrame, loads: DataFrame) -> DataFrame:
    """virtual_slot, shard: slots by falling bytes, each to the least loaded shard.

    One fold over an array of at most SLOTS entries; loads has the array of
    bytes that the shards hold already.
    """
    listed = weights.agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("less"), F.col("virtual_slot").alias("slot")))).alias("slots"))
    least = "array_position(acc.loads, array_min(acc.loads))"
    fold = f"""aggregate(slots, named_struct('loads', loads, 'shards', cast(array() as array<int>)), (acc, x) -> named_struct(
        'loads', transform(acc.loads, (l, i) -> if(i + 1 = {least}, l - x.less, l)),
        'shards', concat(acc.shards, array(cast({least} - 1 as int)))))"""
    dealt = listed.join(F.broadcast(loads)).select("slots", F.expr(fold).alias("dealt"))
    return dealt.select(F.explode(F.arrays_zip(F.col("slots.slot").alias("virtual_slot"), F.col("dealt.shards").alias("shard"))).alias("m")).select("m.virtual_slot", "m.shard")


def first_map(weights: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """version 0 of the map: virtual_slot, shard, version."""
    empty = weights.sparkSession.range(1).select(F.array_repeat(F.lit(0).cast("long"), n_shards).alias("loads"))
    return _dealt(weights, empty).withColumn("version", F.lit(0))


def rebalanced(current: DataFrame, weights: DataFrame, n_shards: int, slack: float = 0.01) -> DataFrame:
    """The next version of a map: slots leave only shards over the even share.

    A shard keeps its slots, the heaviest first, while they stay within the even
    share of n_shards (which may be more than before) times 1 + slack; the rest
    and slots that are new go to the least loaded shards. Slots of shards that
    are no more all move.
    """
    held = weights.join(F.broadcast(current), "virtual_slot", "left")
    per_shard = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot")
    share = weights.agg((F.sum("bytes") / n_shards * (1 + slack)).alias("share"))
    held = held.join(F.broadcast(share)).withColumn("upto", F.sum("bytes").over(per_shard.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    held = held.withColumn("stays", F.coalesce((F.col("upto") <= F.col("share")) & (F.col("shard") < n_shards), F.lit(False)))
    kept = held.where("stays").groupBy("shard").agg(F.sum("bytes").alias("bytes"))
    shards = weights.sparkSession.range(n_shards).select(F.col("id").cast("int").alias("shard"))
    loads = shards.join(kept, "shard", "left").agg(F.sort_array(F.collect_list(F.struct("shard", F.coalesce("bytes", F.lit(0).cast("long")).alias("bytes"))))["bytes"].alias("loads"))
    moved = _dealt(held.where("not stays").select("virtual_slot", "bytes"), loads)
    version = current.agg((F.coalesce(F.max("version"), F.lit(-1)) + 1).alias("version"))
    return held.where("stays").select("virtual_slot", "shard").union(moved).join(F.broadcast(version)).select("virtual_slot", "shard", "version")


def store_map(slot_map: DataFrame, path: str) -> None:
    """Appends a version; versions are folders and are never overwritten."""
    slot_map.coalesce(1).write.partitionBy("version").mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version of the map, the newest by default."""
    every = spark.read.parquet(path)
    chosen = F.lit(version) if version is not None else None
    if chosen is None:
        return every.join(F.broadcast(every.agg(F.max("version").alias("version"))), "version").select("virtual_slot", "shard", "version")
    return every.where(F.col("version") == chosen).select("virtual_slot", "shard", "version")


def shard(docs: DataFrame, n_shards: int = SHARDS, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot.

    With map_path, the slot map is appended there as a version and read back;
    later versions come from `rebalanced`.

    A row for each row of docs. The law is `bytes`: shards have nearly equal
    bytes, as far as single rows allow. slot is the row's place in its shard,
    without gaps from 0; grown_shard is null under this law. Equal texts are in
    one shard unless their copies alone exceed a shard's even share. A null text
    counts as an empty one, with size 1 and checksum 0; rows without doc_id and
    repeated rows are placed like any other, ties standing in order of doc_id
    (of its hash first), checksum and size. Other columns of docs are ignored.
    """
    # the part is where a row happens to be stored: it only deals out rows that are alike
    records = stored(measured(docs).withColumn("part", F.spark_partition_id()), "measured")
    placed = with_slots(records, heavy_texts(records, n_shards))
    weights = slot_bytes(placed)
    slot_map = first_map(weights, n_shards)
    if map_path is not None:
        store_map(slot_map, map_path)
        slot_map = load_map(docs.sparkSession, map_path)
    slot_map = stored(slot_map.join(weights, "virtual_slot"), "slot-map")
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = slot_map.select("virtual_slot", "shard", (F.sum("rows").over(before) - F.col("rows")).alias("start"), F.ceil(F.col("rows") / ROWS_PER_RANGE).cast("long").alias("ranges"))

    ranged = placed.withColumn("h", _hash32(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))).join(F.broadcast(starts), "virtual_slot")
    ranged = ranged.withColumn("range", F.shiftright(F.col("h") * F.col("ranges"), 32))
    order = ["h", "doc_id", "text_crc32", "size", "digest"]
    counted = ranged.groupBy("virtual_slot", "shard", "start", "range", *order, "part").agg(F.count("*").alias("n"))
    counted = stored(counted, "numbered")
    upto = Window.partitionBy("virtual_slot").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = counted.groupBy("virtual_slot", "range").agg(F.sum("n").alias("n")).select("virtual_slot", "range", (F.sum("n").over(upto) - F.col("n")).alias("offset"))
    within = Window.partitionBy("virtual_slot", "range").orderBy(*[F.col(c).asc_nulls_last() for c in order], "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = counted.withColumn("first", F.sum("n").over(within) - F.col("n")).join(offsets, ["virtual_slot", "range"])
    every = numbered.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("nth"))
    return every.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.col("offset") + F.col("first") + F.col("nth")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )


def sharded_documents(docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """docs with the columns shard and virtual_slot (in place of such columns, if it has
    any), without moving the texts."""
    records = stored(measured(docs), "measured")
    heavy = stored(heavy_texts(records, n_shards), "heavy-texts")
    slot_map = stored(first_map(slot_bytes(with_slots(records, heavy)), n_shards), "slot-map")
    rows = docs.select(F.struct(*[c for c in docs.columns if c.lower() not in ("shard", "virtual_slot")]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.md5(_text()).alias("digest"))
    marked = with_slots(rows, heavy)
    return marked.join(F.broadcast(slot_map.select("virtual_slot", "shard")), "virtual_slot").select("row.*", "shard", "virtual_slot")


#: op4 in DuckDB's SQL: the same slots, and the deal as a fold over them.
ORACLE = """
WITH texts AS (
  SELECT doc_id, encode(coalesce(text, '')) AS bytes, md5(coalesce(text, '')) AS digest FROM documents
), records AS (
  SELECT doc_id, (octet_length(bytes) + 1)::BIGINT AS size, digest,
         xor(list_reduce(list_transform(regexp_extract_all(hex(bytes), '..'), lambda h: ('0x' || h)::BIGINT),
             lambda c, x: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda e, k: xor(e >> 1, 3988292384 * (e & 1)), xor(c, x)),
             4294967295::BIGINT), 4294967295)::BIGINT AS text_crc32
  FROM texts
), placed AS (
  SELECT *, (('0x' || substr(CASE WHEN sum(size) OVER (PARTITION BY digest) > (SELECT sum(size) / 16 FROM records)
             THEN md5(digest || coalesce(doc_id::VARCHAR, '')) ELSE digest END, 1, 8))::BIGINT % 4096)::INT AS virtual_slot
  FROM records
), weights AS (
  SELECT virtual_slot, sum(size)::BIGINT AS bytes, count(*) AS n FROM placed GROUP BY virtual_slot
), listed AS (
  SELECT list({'v': virtual_slot, 'b': bytes} ORDER BY bytes DESC, virtual_slot) AS slots FROM weights
), dealt AS (
  SELECT slots, list_reduce(slots,
    lambda acc, x: {'loads': list_transform(acc.loads, lambda l, i: CASE WHEN i = list_position(acc.loads, list_min(acc.loads)) THEN l + x.b ELSE l END),
                    'shards': list_append(acc.shards, list_position(acc.loads, list_min(acc.loads))::INT - 1)},
    {'loads': [0::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0], 'shards': []::INT[]}).shards AS shards
  FROM listed
), slot_map AS (
  SELECT unnest(slots).v AS virtual_slot, unnest(shards) AS shard FROM dealt
), starts AS (
  SELECT virtual_slot, shard, sum(n) OVER (PARTITION BY shard ORDER BY virtual_slot ROWS UNBOUNDED PRECEDING) - n AS start
  FROM slot_map JOIN weights USING (virtual_slot)
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       (start + row_number() OVER (PARTITION BY virtual_slot ORDER BY ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT,
                                                                      doc_id NULLS LAST, text_crc32, size, digest) - 1)::BIGINT AS slot,
       NULL::INT AS grown_shard, virtual_slot
FROM placed JOIN starts USING (virtual_slot)
"""
