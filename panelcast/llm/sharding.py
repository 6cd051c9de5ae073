"""Shards by fixed virtual slots, with DataFrame functions only.

A record's hash names one of ``SLOTS`` virtual slots, for ever. The bytes of each slot are added up, and a map from slots to
shards is made from these sums: largest slots first, each to the lightest shard. The map is all that is ever edited. Its versions
are kept beside each other: ``rebalance`` moves slots from shards that have become too heavy, ``grow`` moves slots to a new shard
and none between the others, so records move only with their slots.

The hash covers id and text, so that rows of one id, or copies of one text, spread over the slots; only rows equal in both share a
slot. Sums per slot and the map have ``SLOTS`` rows at most at any size of the input, which bounds what is folded in one row or
broadcast. Positions in a shard come from counts of sub-slots (``SUB`` per slot), so that no task numbers a whole shard.

Defined results: a null text has no bytes, a null id is hashed as empty; equal rows each give a row, at positions of their own;
an empty table gives an empty result; columns other than doc_id and text are not read. The law is ``bytes``, so ``grown_shard``
is null."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, stored

#: Virtual slots.
SLOTS = 4096
#: Parts of a slot that are numbered apart; a power of 256.
SUB = 256
SHARDS = 8


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot and sub of each document; texts are read once and not kept."""
    text = F.coalesce("text", F.lit(""))
    h = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text))
    number = lambda at, n: F.conv(F.substring(h, at, n), 16, 10).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), (number(1, 8) % slots).cast("int").alias("virtual_slot"), (number(9, 2) % SUB).cast("int").alias("sub"))


def loads(parts: DataFrame) -> DataFrame:
    """Bytes and rows of each virtual slot that has any."""
    return parts.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def _all_slots(sums: DataFrame, slots: int) -> DataFrame:
    every = sums.sparkSession.range(0, slots, 1, 1).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(F.broadcast(sums), "virtual_slot", "left").na.fill(0, ["bytes", "rows"])


def _dealt(sums: DataFrame, start: str) -> DataFrame:
    """virtual_slot and shard: slots in falling order of bytes, each to the shard that is lightest then. ``start``: SQL for the shards' bytes before. One row, of SLOTS entries at most."""
    lightest = "array_position(a.loads, array_min(a.loads))"
    step = f"element_at(transform(array({lightest}), k -> named_struct('loads', transform(a.loads, (l, i) -> if(i = k - 1, l + x.bytes, l)), 'at', concat(a.at, array(cast(k - 1 as int))))), 1)"
    begin = f"named_struct('loads', {start}, 'at', cast(array() as array<int>))"
    one = sums.agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "virtual_slot", "bytes"))).alias("s"))
    folded = one.select("s", F.expr(f"aggregate(s, {begin}, (a, x) -> {step}, a -> a.at)").alias("at"))
    return folded.select(F.explode(F.arrays_zip(F.col("s.virtual_slot").alias("virtual_slot"), F.col("at").alias("shard"))).alias("x")).select("x.*").toDF("virtual_slot", "shard")


def assign(sums: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """A map of all slots: virtual_slot, shard. Slots without bytes are dealt evenly too, by a byte each."""
    full = _all_slots(sums, slots).withColumn("bytes", F.greatest("bytes", F.lit(1)))
    return _dealt(full, f"array_repeat(0L, {int(shards)})")


def _released(slot_map: DataFrame, sums: DataFrame, target: int) -> DataFrame:
    """The map with the slots' bytes and ``stays``: whether a slot's shard holds it and all heavier ones within ``target`` bytes."""
    weighed = slot_map.join(F.broadcast(sums), "virtual_slot", "left").na.fill(0, ["bytes"])
    order = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    return weighed.withColumn("stays", F.sum("bytes").over(order) <= target)


def rebalance(slot_map: DataFrame, sums: DataFrame, shards: int, slack: float = 0.02) -> DataFrame:
    """A new map for new sums of bytes: shards above the mean by more than ``slack`` give slots up, the lightest of theirs first, and these go to the lightest shards."""
    total = sums.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first().n
    found = _released(slot_map, sums, int(total / shards * (1 + slack)))
    kept, free = found.where("stays").select("virtual_slot", "shard"), found.where("NOT stays").select("virtual_slot", "bytes")
    held = {r.shard: r.b for r in found.where("stays").groupBy("shard").agg(F.sum("bytes").alias("b")).collect()}  # a row per shard
    return kept.unionByName(_dealt(free, "array(" + ", ".join(f"{held.get(k, 0)}L" for k in range(shards)) + ")"))


def grow(slot_map: DataFrame, sums: DataFrame, shards: int) -> DataFrame:
    """A new map with the further shard ``shards``: each old shard gives it slots until none is above the new mean; no slot moves between old shards."""
    total = sums.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first().n
    found = _released(slot_map, sums, total // (shards + 1))
    return found.select("virtual_slot", F.when(F.col("stays"), F.col("shard")).otherwise(shards).cast("int").alias("shard"))


def save_map(slot_map: DataFrame, path: str, version: int) -> None:
    """Write a version of the map; a version is never overwritten."""
    slot_map.coalesce(1).write.mode("error").parquet(f"{path}/version={int(version)}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the map, the latest by default."""
    if version is None:
        version = spark.read.parquet(path).agg(F.max("version")).first()[0]
    return spark.read.schema("virtual_slot int, shard int").parquet(f"{path}/version={int(version)}")


def place(parts: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``parts`` with their shard and slot: the position there, gapless from 0, by virtual slot, sub-slot and id."""
    at = ["virtual_slot", "sub"]
    counts = parts.groupBy(*at).agg(F.count(F.lit(1)).alias("n"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    per_slot = counts.groupBy("virtual_slot").agg(F.sum("n").alias("n")).join(F.broadcast(slot_map), "virtual_slot")
    per_slot = per_slot.select("virtual_slot", "shard", F.coalesce(F.sum("n").over(before(Window.partitionBy("shard").orderBy("virtual_slot"))), F.lit(0)).alias("first"))
    offsets = counts.select(*at, F.coalesce(F.sum("n").over(before(Window.partitionBy("virtual_slot").orderBy("sub"))), F.lit(0)).alias("skip"))
    offsets = offsets.join(F.broadcast(per_slot), "virtual_slot").select(*at, "shard", (F.col("first") + F.col("skip")).alias("first"))
    rank = F.row_number().over(Window.partitionBy(*at).orderBy("doc_id", "text_crc32", "size"))
    numbered = parts.withColumn("rank", rank).join(offsets, at)
    return numbered.select(*parts.columns, "shard", (F.col("first") + F.col("rank") - 1).alias("slot"))


def shard(docs: DataFrame, shards: int = SHARDS, made: list | None = None) -> DataFrame:
    """Every document's shard, by a first version of the map, which is stored. ``made`` gets the paths of stored tables."""
    made = [] if made is None else made
    parts = stored(records(docs), "records", made)
    path = f"{shared_dir(docs.sparkSession)}/panelcast-shards-{made[-1][-32:]}"
    save_map(assign(loads(parts), shards), path, 0)
    made.append(path)
    out = place(parts, load_map(docs.sparkSession, path))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def oracle_sql(shards: int = SHARDS) -> str:
    """``shard`` over the table documents in DuckDB's SQL."""
    table = [0] * 256
    for c in range(256):
        k = c
        for _ in range(8):
            k = k >> 1 ^ (k & 1) * 0xEDB88320
        table[c] = k
    digit = "instr('0123456789ABCDEF', substr(x, {}, 1)) - 1"
    octets = f"list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: CAST(16 * ({digit.format(1)}) + {digit.format(2)} AS BIGINT))"
    crc = f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, {table}[CAST(xor(c & 255, b) AS INTEGER) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"
    number = "CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || t), {}, {}) AS BIGINT)"
    loads = f"list_resize(CAST([] AS BIGINT[]), {shards}, 0)"
    return f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
r AS MATERIALIZED (SELECT CAST(doc_id AS BIGINT) AS doc_id, strlen(t) + 1 AS size, {crc} AS text_crc32, CAST({number.format(1, 8)} % {SLOTS} AS INTEGER) AS virtual_slot, {number.format(9, 2)} % {SUB} AS sub FROM d),
s AS (SELECT CAST(i AS INTEGER) AS virtual_slot, greatest(coalesce(b, 0), 1) AS bytes FROM range({SLOTS}) g(i) LEFT JOIN (SELECT virtual_slot, CAST(sum(size) AS BIGINT) AS b FROM r GROUP BY 1) q ON q.virtual_slot = i),
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY bytes DESC, virtual_slot) AS k FROM s),
f AS (SELECT 0 AS k, {loads} AS loads, -1 AS v, -1 AS shard
  UNION ALL SELECT o.k, list_transform(loads, lambda l, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN l + bytes ELSE l END), o.virtual_slot, list_position(loads, list_min(loads)) - 1 FROM f JOIN o ON o.k = f.k + 1)
SELECT doc_id, size, text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY virtual_slot, sub, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard, virtual_slot
FROM r JOIN f ON f.v = r.virtual_slot"""
