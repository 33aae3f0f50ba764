"""Sharding by fixed virtual slots and a versioned slot-to-shard map."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import base

RECORD_OVERHEAD = 16


def record_slots(docs: DataFrame, n_slots: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, virtual_slot``; the record hash takes id and text checksum."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + RECORD_OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    return rows.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n_slots)).cast("int"))


def first_map(slot_bytes: dict[int, int], n_slots: int, n_shards: int) -> list[int]:
    """Version 1: slots by falling bytes, each to the shard with the fewest bytes so far."""
    shards = [(0, s) for s in range(n_shards)]
    heapq.heapify(shards)
    owner = [0] * n_slots
    for slot in sorted(range(n_slots), key=lambda s: (-slot_bytes.get(s, 0), s)):
        load, shard = heapq.heappop(shards)
        owner[slot] = shard
        heapq.heappush(shards, (load + slot_bytes.get(slot, 0), shard))
    return owner


def edited_map(owner: list[int], slot_bytes: dict[int, int], n_shards: int) -> list[int]:
    """The next version for ``n_shards``: slots leave shards above the mean (or shards that are gone), no others move.

    Slots of removed shards go first, then the largest slots of overfull shards
    that still fit, each to the shard with the fewest bytes.
    """
    owner, load = list(owner), [0] * n_shards
    homeless = []
    for slot, shard in enumerate(owner):
        if shard < n_shards:
            load[shard] += slot_bytes.get(slot, 0)
        else:
            homeless.append(slot)
    mean = sum(slot_bytes.values()) / n_shards
    least = [(b, s) for s, b in enumerate(load)]
    heapq.heapify(least)

    def settle(slot):
        while least[0][0] != load[least[0][1]]:
            heapq.heapreplace(least, (load[least[0][1]], least[0][1]))
        shard = least[0][1]
        owner[slot] = shard
        load[shard] += slot_bytes.get(slot, 0)

    for slot in sorted(homeless, key=lambda s: (-slot_bytes.get(s, 0), s)):
        settle(slot)
    for slot in sorted(range(len(owner)), key=lambda s: (-slot_bytes.get(s, 0), s)):
        size, shard = slot_bytes.get(slot, 0), owner[slot]
        low = min(load)
        if size and load[shard] - size >= mean and low + size <= mean:
            load[shard] -= size
            settle(slot)
    return owner


def write_map(spark: SparkSession, path: str, version: int, owner: list[int], slot_rows: dict[int, int]) -> None:
    """Append one version: ``virtual_slot, shard, first`` (rows of the shard in its earlier slots)."""
    seen: dict[int, int] = {}
    rows = []
    for slot, shard in enumerate(owner):
        rows.append((slot, shard, seen.get(shard, 0)))
        seen[shard] = seen.get(shard, 0) + slot_rows.get(slot, 0)
    base.small_table(spark, rows, "virtual_slot int, shard int, first long").coalesce(1).write.parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/version={version}")


def shard_documents(
    docs: DataFrame, n_shards: int, n_slots: int = 8192, map_path: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot, virtual_slot, next_shard`` for every row; shard sizes are near equal.

    Records are hashed into ``n_slots`` fixed virtual slots; bytes and rows are
    summed per slot (``n_slots`` rows reach the driver, whatever the input), and a
    greedy map gives slots to shards. The map is stored under ``map_path`` as
    version 1; version 2 is its edit for one more shard and yields ``next_shard``.
    ``slot`` numbers the rows of a shard from 0 without gaps, by virtual slot and id.

    A null text has no bytes; null ids are hashed as such. Ties and repeated rows
    share a virtual slot and are numbered in no set order among themselves. A record
    is never split, so shards differ by about one slot's bytes; shards may stay empty.
    """
    if not 0 < n_shards <= n_slots:
        raise ValueError("n_shards must be between 1 and n_slots")
    spark = docs.sparkSession
    rows = record_slots(docs, n_slots, id_col, text_col)
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    slot_bytes, slot_rows = {r.virtual_slot: r.b for r in sums}, {r.virtual_slot: r.n for r in sums}
    path = map_path or base.fresh_path(spark, "slot-map")
    owner = first_map(slot_bytes, n_slots, n_shards)
    write_map(spark, path, 1, owner, slot_rows)
    write_map(spark, path, 2, edited_map(owner, slot_bytes, n_shards + 1), slot_rows)
    both = read_map(spark, path, 1).join(
        F.broadcast(read_map(spark, path, 2).select("virtual_slot", F.col("shard").alias("next_shard"))), "virtual_slot"
    )
    numbered = rows.selectExpr(
        "*", "row_number() OVER (PARTITION BY virtual_slot ORDER BY doc_id, text_crc32) - 1 AS place"
    )
    # n_slots rows of three integers: bounded by the parameter, so safe to broadcast
    return numbered.join(F.broadcast(both), "virtual_slot").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("place")).cast("long").alias("slot"), "virtual_slot", "next_shard"
    )


def op3_sharding(spark, sf_dir):
    """Contract query: 40 shards under the law of near equal bytes."""
    found = shard_documents(base.table(spark, sf_dir, "documents"), 40)
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "next_shard"
    )
