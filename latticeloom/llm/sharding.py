"""Sharding by fixed virtual slots.

The hash of a record's key names one of ``SLOTS`` virtual slots, for ever. A small versioned table maps slots to shards; it
is written to shared storage, and rebalancing writes a new version in which some slots have another shard:

* ``grown`` adds a shard: the new one takes its share of slots from the shards that have most. Which slots a number of
  shards has depends on nothing but that number, so a record's shard is decided by its key and the number of shards, and one
  more shard takes records only into itself;
* ``rebalanced`` moves slots from the heaviest to the lightest shards by the bytes counted in each slot.

The map has ``SLOTS`` rows whatever the data, so it is edited on the driver and broadcast. Bytes are summed per slot before
anything is shuffled.

Defined cases: a null text has no bytes; a null key hashes like any other value, so all such records share a slot. Repeated
rows take a place each. A hot key is one slot and so one shard by law, but its places are numbered by many tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeloom.distributed import row_index
from latticeloom.session import cut_lineage, scratch_path

SLOTS = 4096


def slot_of(key: str, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(slots)).cast("int")


def grown(owners: Sequence[int]) -> list[int]:
    """The map with one more shard, which takes floor(slots / shards) slots, one by one from the shard with most."""
    new, held = max(owners, default=-1) + 1, {}
    for slot, shard in enumerate(owners):
        held.setdefault(shard, []).append(slot)
    heap = [(-len(s), shard) for shard, s in held.items()]
    heapq.heapify(heap)
    out = list(owners)
    for _ in range(len(owners) // (new + 1)):
        size, shard = heapq.heappop(heap)
        out[held[shard].pop()] = new
        heapq.heappush(heap, (size + 1, shard))
    return out


def slot_map(shards: int, slots: int = SLOTS) -> list[int]:
    """Shard of each slot for a number of shards: grown from one shard, step by step."""
    owners = [0] * slots
    for _ in range(shards - 1):
        owners = grown(owners)
    return owners


def slot_bytes(records: DataFrame, slot: str = "virtual_slot", size: str = "size") -> DataFrame:
    return records.groupBy(slot).agg(F.sum(size).alias("slot_bytes"), F.count(F.lit(1)).alias("slot_rows"))


def rebalanced(owners: Sequence[int], sizes: Mapping[int, int], shards: int, tolerance: float = 0.02) -> list[int]:
    """Edit the map: while the heaviest shard is over the mean by more than ``tolerance``, its best slot goes to the lightest."""
    out, weight, held = list(owners), [0] * shards, [set() for _ in range(shards)]
    for slot, shard in enumerate(out):
        weight[shard] += sizes.get(slot, 0)
        held[shard].add(slot)
    mean = sum(weight) / shards
    for _ in range(len(out)):
        high, low = max(range(shards), key=weight.__getitem__), min(range(shards), key=weight.__getitem__)
        gap = weight[high] - weight[low]
        fit = [s for s in held[high] if 0 < sizes.get(s, 0) < gap]
        if weight[high] <= mean * (1 + tolerance) or not fit:
            break
        slot = min(fit, key=lambda s: (abs(sizes[s] - gap / 2), s))
        out[slot] = low
        held[high].remove(slot)
        held[low].add(slot)
        weight[high] -= sizes[slot]
        weight[low] += sizes[slot]
    return out


def store_map(spark: SparkSession, path: str, owners: Sequence[int], version: int) -> None:
    """Write one version of the map below ``path``; a version never changes, so writing one again is an error."""
    rows = spark.createDataFrame(list(enumerate(map(int, owners))), "virtual_slot int, shard int")
    rows.coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def stored_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("virtual_slot int, shard int").parquet(f"{path}/version={version}")


def shard(records: DataFrame, shards: int, key: str = "doc_id", size: str = "size", slots: int = SLOTS,
          path: str | None = None) -> DataFrame:
    """Add ``virtual_slot, slot_bytes, shard, slot, grown_shard`` to records ``(key, size, ...)``.

    ``slot`` is the record's place in its shard, from 0 without gaps. Version 1 of the map has ``shards`` shards, version 2
    one more; both are stored below ``path``.
    """
    spark = records.sparkSession
    path = path or scratch_path(spark, "slot-map")
    owners = slot_map(shards, slots)
    for version, edited in ((1, owners), (2, grown(owners))):
        store_map(spark, path, edited, version)
    placed = cut_lineage(records.withColumn("virtual_slot", slot_of(key, slots)).withColumn("_row", F.monotonically_increasing_id()))
    # each of the three has at most `slots` rows
    both = (stored_map(spark, path, 1).join(stored_map(spark, path, 2).withColumnRenamed("shard", "grown_shard"), "virtual_slot")
            .join(F.broadcast(slot_bytes(placed, size=size).drop("slot_rows")), "virtual_slot", "left"))
    placed = placed.join(F.broadcast(both), "virtual_slot")
    return row_index(placed, ["virtual_slot", key, "_row"], ["shard"], "slot").drop("_row")
