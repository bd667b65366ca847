"""Sharding by fixed virtual slots.

A record is hashed into one of thousands of virtual slots, for good. The bytes of each slot are summed, and a small
versioned map sends slots to shards. Rebalancing edits the map: it moves whole slots, as few as it can, from heavy to
light shards and keeps the version before; records never need a new hash. The map of `n_slots` entries is the only
thing that is brought to the driver.

A record that is repeated so often that its copies outweigh a sixteenth of a mean slot would tip its slot: its copies are
dealt out over the slots that follow. No more records than sixteen times the slots can be so heavy.

Rows: a null text has no bytes (size 1, CRC 0); a null id hashes like any value; repeated rows are counted as one record
with copies, and stay apart by their position; empty tables give empty tables and an even map. Extra columns stay in `with_shard` and in the
written shards; columns there named virtual_slot or shard are replaced.
"""

from __future__ import annotations

import heapq
import json
from bisect import bisect_left
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenekiln.session import materialize

N_SLOTS = 4096
#: Copies are dealt out if they outweigh this part of a mean slot.
HEAVY = 16


@dataclass(frozen=True)
class SlotMap:
    """A version of the slot-to-shard map, and the slots it moved against the version before: slot -> (from, to)."""

    version: int
    n_shards: int
    shard_of: tuple[int, ...]
    moved: tuple[tuple[int, int, int], ...] = ()

    @classmethod
    def initial(cls, n_shards: int, n_slots: int = N_SLOTS) -> SlotMap:
        if not 0 < n_shards <= n_slots:
            raise ValueError("there must be shards, and no more than slots")
        return cls(1, n_shards, tuple(i % n_shards for i in range(n_slots)))

    def _edited(self, shard_of: list[int], n_shards: int) -> SlotMap:
        moved = tuple((i, a, b) for i, (a, b) in enumerate(zip(self.shard_of, shard_of)) if a != b)
        return SlotMap(self.version + 1, n_shards, tuple(shard_of), moved)

    def rebalance(self, slot_bytes: dict[int, int], n_shards: int | None = None, tolerance: float = 0.0) -> SlotMap:
        """The next version, for `n_shards` shards: slots go from shards above the mean to the lightest one.

        Each step moves the largest slot that lowers the heaviest shard without lifting the lightest above it; where
        no move helps, it looks for a swap. It ends when all are within `tolerance` of the mean, nothing helps, or after
        four steps a slot, with the loads reached by then.
        """
        n = n_shards or self.n_shards
        shard_of = list(self.shard_of)
        held: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        homeless = []
        for slot, shard in enumerate(shard_of):
            (held[shard] if shard < n else homeless).append((slot_bytes.get(slot, 0), slot))
        load = [sum(b for b, _ in h) for h in held]
        heap = [(b, i) for i, b in enumerate(load)]
        heapq.heapify(heap)
        for size, slot in sorted(homeless, reverse=True):
            at, i = heapq.heappop(heap)
            held[i].append((size, slot))
            load[i], shard_of[slot] = at + size, i
            heapq.heappush(heap, (load[i], i))
        mean = sum(load) / n
        for _ in range(4 * len(shard_of)):
            high, low = max(range(n), key=load.__getitem__), min(range(n), key=load.__getitem__)
            gap = load[high] - load[low]
            if gap <= max(1, 2 * tolerance * mean):
                break
            best = max((x for x in held[high] if 0 < x[0] <= gap // 2), default=None)
            out, back = best, None
            if best is None or 2 * best[0] < gap // 2:  # a swap may come nearer to half the gap
                theirs = sorted(held[low])
                for x in held[high]:
                    i = bisect_left(theirs, (x[0] - gap // 2, -1))  # the lightest that leaves no more than half the gap
                    if i < len(theirs) and x[0] - theirs[i][0] > (out[0] - (back[0] if back else 0) if out else 0):
                        out, back = x, theirs[i]
            if out is None:
                break
            for x, a, b in [(out, high, low), *([(back, low, high)] if back else [])]:
                held[a].remove(x)
                held[b].append(x)
                load[a], load[b], shard_of[x[1]] = load[a] - x[0], load[b] + x[0], b
        return self._edited(shard_of, n)

    def column(self, slot: Column) -> Column:
        return F.get(F.lit(list(self.shard_of)), slot).cast("int")

    def save(self, spark: SparkSession, folder: str) -> str:
        """Write this version beside the earlier ones; a version is never written twice."""
        path = f"{folder.rstrip('/')}/slot_map/version={self.version:08d}"
        row = (self.n_shards, list(self.shard_of), json.dumps(self.moved))
        spark.createDataFrame([row], "n_shards int, shard_of array<int>, moved string").coalesce(1).write.mode("errorifexists").parquet(path)
        return path

    @classmethod
    def load(cls, spark: SparkSession, folder: str, version: int) -> SlotMap:
        row = spark.read.parquet(f"{folder.rstrip('/')}/slot_map/version={version:08d}").first()
        return cls(version, row.n_shards, tuple(row.shard_of), tuple(map(tuple, json.loads(row.moved))))

    def undone(self) -> SlotMap:
        """The next version, with this one's moves taken back."""
        shard_of = list(self.shard_of)
        for slot, before, _ in self.moved:
            shard_of[slot] = before
        return replace(self._edited(shard_of, self.n_shards), n_shards=max(self.n_shards, max(shard_of) + 1))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """id, size, text_crc32, virtual_slot and copies of the distinct records: all that sharding needs, in one pass over
    the texts. A heavy record has a row for each of the `parts` slots that its copies are dealt to."""
    text, key = F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.col(f"`{id_col}`")
    rows = docs.select(key.alias(id_col), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    same = materialize(rows.groupBy(id_col, "size", "text_crc32").agg(F.count("*").alias("copies")), "shard-records")
    total = same.agg(F.coalesce(F.sum(F.col("size") * F.col("copies")), F.lit(0))).first()[0]
    heavy = (F.col("copies") > 1) & (F.col("size") * F.col("copies") * (HEAVY * n_slots) > total)
    df = same.withColumn("parts", F.when(heavy, F.least("copies", F.lit(n_slots))).otherwise(1).cast("int"))
    df = df.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    df = df.withColumn("virtual_slot", _dealt(slot_of(F.col(f"`{id_col}`"), F.col("text_crc32"), n_slots), F.col("part"), n_slots))
    own = F.floor(F.col("copies") / F.col("parts")) + (F.col("part") < F.col("copies") % F.col("parts")).cast("long")
    return df.withColumn("copies", own).drop("part")


def slot_of(key: Column, crc: Column, n_slots: int) -> Column:
    return F.pmod(F.xxhash64(key, crc), F.lit(n_slots)).cast("int")


def _dealt(slot: Column, part: Column, n_slots: int) -> Column:
    return F.pmod(slot + part, F.lit(n_slots)).cast("int")


def slot_bytes(records: DataFrame) -> dict[int, int]:
    """Bytes of each slot. At most one row a slot comes to the driver."""
    return {r.virtual_slot: r.b for r in records.groupBy("virtual_slot").agg(F.sum(F.col("size") * F.col("copies")).alias("b")).collect()}


def positions(records: DataFrame, slot_map: SlotMap, id_col: str = "doc_id") -> DataFrame:
    """One row a copy of `records` (as made by `digest`) with shard and slot, its position in its shard, gapless from 0.

    Records are numbered within virtual slots, and only the slots' counts within shards. So no task numbers a shard.
    """
    ends = F.sum("copies").over(Window.partitionBy("virtual_slot").orderBy(F.col(f"`{id_col}`"), "text_crc32", "size"))
    counts = {r.virtual_slot: r.n for r in records.groupBy("virtual_slot").agg(F.sum("copies").alias("n")).collect()}
    starts, at = [], [0] * slot_map.n_shards
    for slot, shard in enumerate(slot_map.shard_of):
        starts.append(at[shard])
        at[shard] += counts.get(slot, 0)
    first = F.get(F.lit(starts), F.col("virtual_slot")) + F.col("end") - F.col("copies")
    df = records.withColumn("end", ends).withColumns({"shard": slot_map.column(F.col("virtual_slot")), "first": first})
    return df.withColumn("slot", F.explode(F.sequence("first", F.col("first") + F.col("copies") - 1))).drop("first", "end", "copies", "parts")


def with_shard(docs: DataFrame, slot_map: SlotMap, records: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with virtual_slot and shard; no shuffle. With `records`, copies of heavy ones are dealt out in turn; each
    task deals its own, so a slot's share of a heavy record is even but not that of `positions` to the row."""
    n_slots = len(slot_map.shard_of)
    crc = F.crc32(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"))
    df = docs.withColumns({"__id": F.col(f"`{id_col}`"), "__crc": crc})
    if records is None:
        df = df.withColumn("__part", F.lit(0))
    else:  # HEAVY * n_slots rows at most
        heavy = records.filter("parts > 1").select(F.col(f"`{id_col}`").alias("__i"), F.col("text_crc32").alias("__c"), "parts").distinct().withColumnRenamed("parts", "__parts")
        df = df.join(F.broadcast(heavy), F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__crc") == F.col("__c")), "left")
        df = df.withColumn("__part", F.pmod(F.monotonically_increasing_id(), F.coalesce("__parts", F.lit(1)))).drop("__i", "__c", "__parts")
    df = df.withColumn("virtual_slot", _dealt(slot_of(F.col("__id"), F.col("__crc"), n_slots), F.col("__part"), n_slots))
    return df.withColumn("shard", slot_map.column(F.col("virtual_slot"))).drop("__id", "__crc", "__part")


def write_shards(docs: DataFrame, slot_map: SlotMap, folder: str, records: DataFrame | None = None, **cols: str) -> None:
    """One folder of Parquet files a shard, whole records."""
    with_shard(docs, slot_map, records, **cols).write.partitionBy("shard").parquet(f"{folder.rstrip('/')}/version={slot_map.version}")
