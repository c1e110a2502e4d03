"""Sharding by fixed virtual slots.

Every record is hashed by its id into one of ``slots`` virtual slots, a number that never changes. Bytes and
rows are summed by slot; a slot-to-shard map, a table of ``slots`` rows with a version, says where each
slot's records live. The first map deals slots to the shard with the fewest bytes, largest slot first.
Rebalancing edits the map: it moves slots only from shards above the mean to those below, and stores the result as the next version.

The law is ``bytes``: near equal sizes. Groups of equal texts are therefore spread, not kept together: a text's copies hash by their own
ids, so a group with a third of all rows adds to every shard alike. A record's place depends on its id and on the map, not on its text.

Defined cases: a null text has no bytes; rows with a null key hash by their text; repeated rows share a slot, and each has its own place, in
no certain order where id and text are the same; a text of any length counts with all its bytes and isn't moved; slots of the same size are
dealt in order of their number; an empty table gives an empty table; extra columns, also those named like a result, are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roundforge.llm.common import as_text, scratch

OVERHEAD = 16  # bytes of a record besides its text


@dataclass(frozen=True)
class SlotMap:
    """shard_of[slot]; a bounded table: its length is the number of virtual slots."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, self.shards, s, k) for s, k in enumerate(self.shard_of)]
        return spark.createDataFrame(rows, "version int, shards int, virtual_slot int, shard int")

    def store(self, spark: SparkSession, path: str) -> None:
        """Writes this version beside the earlier ones."""
        self.frame(spark).coalesce(1).write.mode("errorifexists").parquet(f"{path.rstrip('/')}/version={self.version}")

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A stored version, the last one by default."""
        table = spark.read.parquet(path)
        version = version if version is not None else table.agg(F.max("version")).first()[0]
        rows = table.filter(F.col("version") == version).orderBy("virtual_slot").collect()
        return SlotMap(version, rows[0]["shards"], tuple(r["shard"] for r in rows))


def sized(docs: DataFrame, slots: int, key: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of each row; the text itself goes no further."""
    text = as_text().cast("binary")
    return docs.select(key, (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.pmod(F.when(F.col(key).isNull(), F.xxhash64(F.lit("null"), text)).otherwise(F.xxhash64(F.lit("slot"), key)), F.lit(slots)).cast("int").alias("virtual_slot"))


def slot_sums(rows: DataFrame, slots: int) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot. The result has ``slots`` rows at most, whatever the input."""
    bytes_, count = [0] * slots, [0] * slots
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect():
        bytes_[r["virtual_slot"]], count[r["virtual_slot"]] = r["bytes"], r["rows"]
    return bytes_, count


def first_map(slot_bytes: list[int], shards: int) -> SlotMap:
    heap = [(0, k) for k in range(shards)]
    shard_of = [0] * len(slot_bytes)
    for slot in sorted(range(len(slot_bytes)), key=lambda s: (-slot_bytes[s], s)):
        load, k = heapq.heappop(heap)
        shard_of[slot] = k
        heapq.heappush(heap, (load + slot_bytes[slot], k))
    return SlotMap(1, shards, tuple(shard_of))


def rebalanced(old: SlotMap, slot_bytes: list[int], shards: int | None = None, tolerance: float = 0.01) -> SlotMap:
    """The next version, for as many shards or more: each move takes the slot that fits best
    from the fullest shard to the emptiest, until they differ by ``tolerance`` of the mean at most or no move helps."""
    shards = max(shards or old.shards, old.shards)
    shard_of, load = list(old.shard_of), [0] * shards
    members: list[list[int]] = [[] for _ in range(shards)]
    for slot, k in enumerate(shard_of):
        load[k] += slot_bytes[slot]
        members[k].append(slot)
    for _ in range(len(shard_of)):
        full, low = max(range(shards), key=lambda k: (load[k], -k)), min(range(shards), key=lambda k: (load[k], k))
        gap = load[full] - load[low]
        if gap <= tolerance * sum(load) / shards:
            break
        fits = [s for s in members[full] if 0 < slot_bytes[s] < gap]
        if not fits:
            break
        slot = min(fits, key=lambda s: (abs(slot_bytes[s] - gap / 2), s))
        members[full].remove(slot)
        members[low].append(slot)
        load[full] -= slot_bytes[slot]
        load[low] += slot_bytes[slot]
        shard_of[slot] = low
    return SlotMap(old.version + 1, shards, tuple(shard_of))


def placed(rows: DataFrame, slot_map: SlotMap, slot_rows: list[int]) -> DataFrame:
    """``rows`` (of sized) with shard, and slot: the row's place in its shard, gapless from 0."""
    first, used = [0] * len(slot_rows), [0] * slot_map.shards
    for s, k in enumerate(slot_map.shard_of):
        first[s], used[k] = used[k], used[k] + slot_rows[s]
    spark = rows.sparkSession
    table = spark.createDataFrame(list(zip(range(len(first)), slot_map.shard_of, first, strict=True)), "virtual_slot int, shard int, first long")
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32")) - 1
    # the map has as many rows as there are virtual slots, whatever the input
    return rows.withColumn("place", place).join(F.broadcast(table), "virtual_slot").withColumn("slot", (F.col("first") + F.col("place")).cast("long")).drop("first", "place")


def shard(docs: DataFrame, shards: int = 40, slots: int = 16_384, path: str | None = None) -> DataFrame:
    """Rows of sized() with shard and slot, near equal in bytes by shard. The map is stored at ``path`` as version 1 and read back."""
    rows = sized(docs, slots)
    slot_bytes, slot_rows = slot_sums(rows, slots)
    path = path or scratch(docs.sparkSession, "slot-map")
    first_map(slot_bytes, shards).store(docs.sparkSession, path)
    return placed(rows, SlotMap.load(docs.sparkSession, path), slot_rows)
