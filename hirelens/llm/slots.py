"""Sharding through fixed virtual slots.

Every document hashes into one of ``n_slots`` virtual slots, bytes are summed per
slot, and a versioned slot-to-shard map says which shard holds which slot. The
map has ``n_slots`` rows whatever the size of the corpus, so it is edited on the
driver and joined back as a small table. Rebalancing writes a new version of the map and
moves whole slots, never single documents: version 1 is the map for the shards asked for, version 2 the one with a shard more.

The slot is that of the id, the text's crc32 and, for rows alike in id, size and crc32, their ordinal, so that no number of
null or repeated ids or of equal texts weighs on one slot.

* Null ids hash as the empty string, null texts have size 8 and crc32 0.
* An empty table gives an empty result (and a map of empty slots).
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hirelens.session import ensure_checkpoint_dir

from .common import id_text, materialize, text_of

N_SLOTS = 4096
N_SHARDS = 24
#: Rows alike are numbered in blocks of so many, dealt over the tasks.
REPEATS = 10_000


def slot_of(key: Column, n_slots: int = N_SLOTS) -> Column:
    """Virtual slot of a key: the first 32 bits of its MD5 modulo the number of slots."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), F.lit(n_slots)).cast("int")


def sized(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes + 8), text_crc32, virtual_slot of every document. Rows alike are counted before the
    shuffle and written out again with their ordinals after it: each is as good as the other."""
    text = text_of("text")
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    alike = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    blocks = alike.select("*", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {REPEATS}"))).alias("block"))
    blocks = blocks.repartition("doc_id", "text_crc32", "block")
    first = F.col("block") * REPEATS
    each = blocks.select("doc_id", "size", "text_crc32", F.explode(F.sequence(first, F.least(first + REPEATS, F.col("n")) - 1)).alias("ordinal"))
    key = F.concat_ws(":", id_text(), F.col("text_crc32").cast("string"), F.col("ordinal").cast("string"))
    return each.select("doc_id", "size", "text_crc32", slot_of(key, n_slots).alias("virtual_slot"))


def slot_loads(rows: DataFrame) -> DataFrame:
    """Bytes and rows of each slot in use (at most ``n_slots`` rows)."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))


def assign(loads: dict[int, int], n_slots: int, n_shards: int) -> dict[int, int]:
    """First map: largest slot first to the least loaded shard (ties: smaller slot, smaller shard)."""
    heap = [(0, s) for s in range(n_shards)]
    out = {}
    for slot in sorted(range(n_slots), key=lambda k: (-loads.get(k, 0), k)):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + loads.get(slot, 0), shard))
    return out


def grow(mapping: dict[int, int], loads: dict[int, int]) -> dict[int, int]:
    """Next version with one more shard: slots move into the new shard only, out of
    the fullest shard each time, until it holds its even share of the bytes."""
    shards = max(mapping.values()) + 1
    held: dict[int, list[int]] = {}
    for slot, shard in sorted(mapping.items(), key=lambda m: (loads.get(m[0], 0), -m[0])):
        held.setdefault(shard, []).append(slot)
    total = {s: sum(loads.get(k, 0) for k in ks) for s, ks in held.items()}
    share, new, out = sum(loads.values()) / (shards + 1), 0, dict(mapping)
    while new < share:
        full = max(total, key=lambda s: (total[s], -s))
        fits = [k for k in held[full] if 0 < loads.get(k, 0) <= share - new]
        if not fits:
            break
        slot = fits[-1]
        held[full].remove(slot)
        total[full] -= loads[slot]
        new += loads[slot]
        out[slot] = shards
    return out


def write_map(spark: SparkSession, path: str, version: int, mapping: dict[int, int], loads: dict[int, int]) -> None:
    """Store one version of the map; earlier versions stay readable."""
    rows = [(slot, shard, int(loads.get(slot, 0))) for slot, shard in sorted(mapping.items())]
    df = spark.createDataFrame(rows, "virtual_slot int, shard int, bytes long").coalesce(1)
    df.write.mode("overwrite").parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The given version of the map, the newest by default."""
    maps = spark.read.parquet(path)
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    return maps.where(F.col("version") == version).drop("version")


def shard(docs: DataFrame, n_shards: int = N_SHARDS, n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """Put every document into a shard so that shard bytes are nearly equal (law ``bytes``).

    Returns doc_id, size, text_crc32, law, shard, slot (position inside the shard,
    gapless from 0), grown_shard (null: this law promises nothing for a shard more; where its slots
    would go says version 2 of the map), virtual_slot. Only small columns are shuffled, never the texts.
    """
    spark = docs.sparkSession
    rows = materialize(sized(docs, n_slots), "sizes")
    loads = slot_loads(rows).collect()  # one row a slot: n_slots at most
    size = {r["virtual_slot"]: r["bytes"] for r in loads}
    count = {r["virtual_slot"]: r["n"] for r in loads}
    path = map_path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/slot-map-{uuid.uuid4().hex}"
    mapping = assign(size, n_slots, n_shards)
    for version, m in ((1, mapping), (2, grow(mapping, size))):
        write_map(spark, path, version, m, size)
    seen = dict.fromkeys(range(n_shards), 0)
    first = []
    for r in sorted(read_map(spark, path, 1).collect(), key=lambda r: r["virtual_slot"]):
        first.append((r["virtual_slot"], r["shard"], seen[r["shard"]]))
        seen[r["shard"]] += count.get(r["virtual_slot"], 0)
    placed = spark.createDataFrame(first, "virtual_slot int, shard int, first long")
    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("at", F.row_number().over(order) - 1)
        .join(F.broadcast(placed), "virtual_slot")  # n_slots rows
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                (F.col("first") + F.col("at")).cast("long").alias("slot"),
                F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
    )


#: The same placement in DuckDB SQL (crc32 by its table, the greedy map by recursion).
def oracle(docs: str = "documents", n_shards: int = N_SHARDS, n_slots: int = N_SLOTS) -> str:
    return f"""
WITH RECURSIVE crc_bits AS (
  SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)),
                        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM range(256) t(i)),
crc_table AS (SELECT list(v ORDER BY i) AS tab FROM crc_bits),
hexes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM {docs}),
texts AS (SELECT DISTINCT h FROM hexes),
crcs AS (
  SELECT h, xor(4294967295, list_reduce(
     list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2),
                  lambda k: ('0x' || h[2 * k + 1 : 2 * k + 2])::BIGINT)),
     lambda c, b: xor(c >> 8, tab[1 + xor(c & 255, b)]))) AS crc
  FROM texts, crc_table),
alike AS (
  SELECT doc_id, (length(h) // 2 + 8)::BIGINT AS size, crc::BIGINT AS text_crc32,
         row_number() OVER (PARTITION BY doc_id, length(h), crc) - 1 AS ordinal
  FROM hexes JOIN crcs USING (h)),
rows_ AS (
  SELECT doc_id, size, text_crc32,
         (('0x' || md5(coalesce(doc_id::VARCHAR, '') || ':' || text_crc32 || ':' || ordinal)[1:8])::BIGINT % {n_slots})::INTEGER AS virtual_slot
  FROM alike),
loads AS (SELECT virtual_slot, sum(size)::BIGINT AS bytes, count(*) AS n FROM rows_ GROUP BY 1),
queue AS (
  SELECT s::INTEGER AS virtual_slot, coalesce(bytes, 0)::BIGINT AS bytes, coalesce(n, 0)::BIGINT AS n,
         row_number() OVER (ORDER BY coalesce(bytes, 0) DESC, s) AS k
  FROM range({n_slots}) t(s) LEFT JOIN loads ON virtual_slot = s),
step AS (
  SELECT 0::BIGINT AS k, -1 AS virtual_slot, -1 AS shard, list_transform(range({n_shards}), lambda x: 0::BIGINT) AS load
  UNION ALL
  SELECT q.k, q.virtual_slot, (list_position(load, list_min(load)) - 1)::INTEGER,
         list_transform(load, lambda x, i: CASE WHEN i = list_position(load, list_min(load)) THEN x + q.bytes ELSE x END)
  FROM step JOIN queue q ON q.k = step.k + 1),
placed AS (
  SELECT s.virtual_slot, s.shard,
         coalesce(sum(n) OVER (PARTITION BY s.shard ORDER BY s.virtual_slot
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
  FROM step s JOIN queue USING (virtual_slot))
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       (first + row_number() OVER (PARTITION BY virtual_slot ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1)::BIGINT AS slot,
       NULL::INTEGER AS grown_shard, virtual_slot
FROM rows_ JOIN placed USING (virtual_slot)"""
