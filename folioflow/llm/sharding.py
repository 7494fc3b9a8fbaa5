"""Sharding by fixed virtual slots: records hash to slots, a versioned map says which shard holds a slot.

The number of slots never changes, so neither does the slot of a record. Bytes are counted per slot, the map
is made from these counts, and rebalancing edits the map: only slots move, and as few as will do.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioflow.llm.common import written
from folioflow.llm.ranges import dealt_by_range, with_running
from folioflow.session import work_dir

SLOTS = 16_384
SHARDS = 40
RECORD_BYTES = 16  # counted for a record beside its text


@dataclass
class SlotMap:
    """Shard of every slot, with its version and the bytes it was made from."""

    version: int
    shards: int
    shard_of: list[int]
    bytes_of: list[int] = field(repr=False)

    def loads(self) -> list[int]:
        loads = [0] * self.shards
        for slot, shard in enumerate(self.shard_of):
            loads[shard] += self.bytes_of[slot]
        return loads


def first_map(bytes_of: list[int], shards: int = SHARDS) -> SlotMap:
    """Version 1: slots from large to small, each to the shard with the fewest bytes so far."""
    heap = [(0, 0, shard) for shard in range(shards)]
    shard_of = [0] * len(bytes_of)
    for slot in sorted(range(len(bytes_of)), key=lambda s: (-bytes_of[s], s)):
        load, held, shard = heapq.heappop(heap)
        shard_of[slot] = shard
        heapq.heappush(heap, (load + bytes_of[slot], held + 1, shard))
    return SlotMap(1, shards, shard_of, list(bytes_of))


def rebalance(old: SlotMap, bytes_of: list[int], shards: int | None = None, slack: float = 0.002) -> SlotMap:
    """The next version for new byte counts, or for another number of shards.

    Slots leave removed shards and shards more than ``slack`` above the mean, largest fitting slot first, for
    the shard with the fewest bytes; all other slots stay where they are.
    """
    shards = shards or old.shards
    shard_of = list(old.shard_of)
    loads, held = [0] * shards, [[] for _ in range(shards)]
    homeless = []
    for slot, shard in enumerate(shard_of):
        if shard < shards:
            loads[shard] += bytes_of[slot]
            held[shard].append(slot)
        else:
            homeless.append(slot)
    mean = sum(bytes_of) / shards
    low = [(load, shard) for shard, load in enumerate(loads)]
    heapq.heapify(low)

    def put(slot: int) -> None:
        load, shard = heapq.heappop(low)
        while load != loads[shard]:
            load, shard = heapq.heappop(low)
        shard_of[slot] = shard
        loads[shard] += bytes_of[slot]
        heapq.heappush(low, (loads[shard], shard))

    for shard in range(shards):
        for slot in sorted(held[shard], key=lambda s: (-bytes_of[s], s)):
            if loads[shard] <= mean * (1 + slack):
                break
            if 0 < bytes_of[slot] <= loads[shard] - mean:
                loads[shard] -= bytes_of[slot]
                homeless.append(slot)
        heapq.heappush(low, (loads[shard], shard))
    for slot in sorted(homeless, key=lambda s: (-bytes_of[s], s)):
        put(slot)
    return SlotMap(old.version + 1, shards, shard_of, list(bytes_of))


MAP_ROWS = "version int, shards int, slot int, shard int, bytes long"


def save_map(spark: SparkSession, slots: SlotMap, path: str) -> None:
    """Write a version beside the earlier ones, as ``version=N``; a version is never changed."""
    rows = [
        (slots.version, slots.shards, slot, shard, slots.bytes_of[slot])
        for slot, shard in enumerate(slots.shard_of)
    ]
    spark.createDataFrame(rows, MAP_ROWS).coalesce(1).write.partitionBy("version").mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A version of the map, by default the latest. As many rows as there are slots are collected."""
    saved = spark.read.schema(MAP_ROWS).parquet(path)
    if version is None:
        version = saved.agg(F.max("version")).first()[0]
    rows = sorted(saved.filter(F.col("version") == version).collect(), key=lambda r: r["slot"])
    return SlotMap(version, rows[0]["shards"], [r["shard"] for r in rows], [r["bytes"] for r in rows])


def slot_of(doc_id: Column, text_crc32: Column, size: Column, copy: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a record. Id, content and the number of the copy decide, so that copies of one text, rows of
    one id and repeated rows do not meet in one slot."""
    first = F.xxhash64(doc_id, text_crc32, size)
    return F.pmod(F.when(copy == 0, first).otherwise(F.xxhash64(first, copy)), F.lit(slots)).cast("int")


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) of every row: what sharding needs to know of it.

    Rows that are equal in id and text are numbered over ranges, so any number of them spreads like other rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + RECORD_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_row"),
    )
    given = found.select(F.col("doc_id").isNull().alias("_none"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("_id"), "*")
    same = ["_id", "_none", "text_crc32", "size"]
    ranged = dealt_by_range(written(given, "sharding-rows"), *same, "_row")
    numbered = with_running(ranged, same, ["_row"], {"copy": F.lit(1)})
    slot = slot_of(F.col("doc_id"), F.col("text_crc32"), F.col("size"), F.col("copy"), slots)
    return numbered.select("doc_id", "size", "text_crc32", slot.alias("virtual_slot"))


def slot_bytes(recs: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows per slot; combined before the shuffle, ``slots`` rows come to the driver."""
    sizes, counts = [0] * slots, [0] * slots
    for r in recs.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        sizes[r["virtual_slot"]], counts[r["virtual_slot"]] = r["b"], r["n"]
    return sizes, counts


def assign(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Every row of (doc_id, text) with its shard, near equal in bytes, and its place in the shard.

    Returns doc_id, size, text_crc32, virtual_slot, shard and slot, the place from 0 without gaps. The map
    is stored under ``map_path`` (a new folder by default); an existing map there is rebalanced into
    its next version. Null ids, null and empty texts are records like others, and texts of any length are one record. Rows that
    are equal in id and text are records of their own, in any order; an empty table gives no rows.
    Texts are read once and not shuffled. Places come from row counts per slot and a numbering
    inside each slot, so no shard is gathered in one task.
    """
    spark: SparkSession = docs.sparkSession
    recs = written(records(docs, slots), "records")
    sizes, counts = slot_bytes(recs, slots)
    fresh = map_path is None
    path = work_dir(spark, "slot-map") if fresh else map_path
    slot_map = first_map(sizes, shards) if fresh else rebalance(load_map(spark, path), sizes, shards)
    save_map(spark, slot_map, path)
    before, rows = [0] * shards, []
    for slot, shard in enumerate(slot_map.shard_of):
        if counts[slot]:
            rows.append((slot, shard, before[shard]))
            before[shard] += counts[slot]
    starts = F.broadcast(spark.createDataFrame(rows, "virtual_slot int, shard int, first long"))
    place = F.expr("row_number() over (partition by virtual_slot order by doc_id, text_crc32, size) - 1")
    return (
        recs.withColumn("_place", place)
        .join(starts, "virtual_slot")
        .withColumn("slot", F.col("first") + F.col("_place"))
        .select("doc_id", "size", "text_crc32", "virtual_slot", "shard", "slot")
    )
