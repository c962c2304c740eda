"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of virtual slots.  Bytes and rows are summed per slot, and a
versioned map says which shard holds each slot.  The map has as many entries as there are slots,
whatever the corpus; it is made from the slot sums (largest slot to the lightest shard) and edited
when shards are added or get out of balance, moving only the slots that must move.  Versions of the map
are stored as a table and read back; an edit adds a version.  Everything that
touches records is DataFrame functions.

Defined results: a null text has no bytes and the check sum of no bytes; a null id hashes like an empty
one; repeated rows go to the same shard, one place each; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from heapq import heapify, heapreplace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 4096
SHARDS = 24
ROW_BYTES = 8


def slot_of(id_col: str, slots: int = SLOTS) -> Column:
    """Virtual slot of a record, from its id alone."""
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int")


@dataclass(frozen=True)
class SlotMap:
    """Shard of every slot; ``version`` grows with each edit."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    def loads(self, sizes: list[int]) -> list[int]:
        out = [0] * self.shards
        for slot, shard in enumerate(self.shard_of):
            out[shard] += sizes[slot]
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        """Rows (version, virtual_slot, shard), as the map is stored."""
        rows = spark.range(len(self.shard_of), numPartitions=1).withColumnRenamed("id", "virtual_slot")
        return rows.select(F.lit(self.version).alias("version"), F.col("virtual_slot").cast("int").alias("virtual_slot"),
                           self.column(F.col("virtual_slot").cast("int")).alias("shard"))

    def column(self, slot: Column) -> Column:
        return _lookup(self.shard_of, slot, "int")


def _lookup(values, slot: Column, kind: str) -> Column:
    """Entry of a constant array; Catalyst folds the text into one literal."""
    entries = F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")
    return F.get(entries, slot)


def save_map(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """Add a version to the stored map; a version that is there already is an error."""
    if slot_map.version in _versions(spark, path):
        raise ValueError(f"version {slot_map.version} is stored already")
    slot_map.frame(spark).withColumn("shards", F.lit(slot_map.shards)).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap | None:
    """A version of the stored map, the newest by default; None if there is none.  It has one row per slot."""
    known = _versions(spark, path)
    version = max(known, default=None) if version is None else version
    if version not in known:
        return None
    rows = spark.read.schema(_MAP).parquet(path).where(F.col("version") == version).collect()
    shard_of = dict(sorted((r["virtual_slot"], r["shard"]) for r in rows))
    return SlotMap(version, rows[0]["shards"], tuple(shard_of.values()))


_MAP = "virtual_slot int, shard int, shards int, version int"


def _versions(spark: SparkSession, path: str) -> set[int]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return set()
    return {r["version"] for r in spark.read.schema(_MAP).parquet(path).select("version").distinct().collect()}


def slot_sums(records: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows per slot of records with ``virtual_slot`` and ``size``: at most ``slots`` rows reach the driver."""
    sizes, rows = [0] * slots, [0] * slots
    for r in records.groupBy("virtual_slot").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect():
        sizes[r["virtual_slot"]], rows[r["virtual_slot"]] = r["s"], r["n"]
    return sizes, rows


def first_map(sizes: list[int], shards: int = SHARDS) -> SlotMap:
    """Slots by falling size, each to the lightest shard; ties go to lower numbers."""
    loads = [(0, shard) for shard in range(shards)]
    heapify(loads)
    shard_of = [0] * len(sizes)
    for slot in sorted(range(len(sizes)), key=lambda s: (-sizes[s], s)):
        load, shard = loads[0]
        shard_of[slot] = shard
        heapreplace(loads, (load + sizes[slot], shard))
    return SlotMap(1, shards, tuple(shard_of))


def rebalanced(old: SlotMap, sizes: list[int], shards: int | None = None, tolerance: float = 0.02) -> SlotMap:
    """The next version of a map for new slot sums and possibly more shards.

    Slots move only from shards above the mean by more than ``tolerance`` to the lightest shard, the
    largest that fits first; all other slots stay where they are.
    """
    shards = shards or old.shards
    if shards < old.shards:
        raise ValueError("removing shards is not an edit of the map; make a first map instead")
    shard_of, loads = list(old.shard_of), old.loads(sizes) + [0] * (shards - old.shards)
    mean = sum(sizes) / shards
    for slot in sorted(range(len(sizes)), key=lambda s: (-sizes[s], s)):
        source, target = shard_of[slot], min(range(shards), key=lambda k: (loads[k], k))
        if sizes[slot] and loads[source] > mean * (1 + tolerance) and loads[target] + sizes[slot] <= mean * (1 + tolerance):
            loads[source] -= sizes[slot]
            loads[target] += sizes[slot]
            shard_of[slot] = target
    return SlotMap(old.version + 1, shards, tuple(shard_of))


def sized(docs: DataFrame, id_col: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """Rows (id, size, text_crc32, virtual_slot): what sharding needs of a document, without its text."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"),
                       F.crc32(body.cast("binary")).alias("text_crc32"), slot_of(id_col, slots).alias("virtual_slot"))


def assign(records: DataFrame, slot_map: SlotMap, rows: list[int]) -> DataFrame:
    """Adds ``shard`` and ``place``, which counts the rows of a shard from 0 without a gap.

    Rows are numbered inside their slot, beginning at the sum of the shard's lower slots, so no task
    sees more than one slot at a time.
    """
    from pyspark.sql import Window

    first, filled = [0] * len(rows), [0] * slot_map.shards
    for slot, shard in enumerate(slot_map.shard_of):
        first[slot] = filled[shard]
        filled[shard] += rows[slot]
    slot = F.col("virtual_slot")
    inside = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return records.select("*", slot_map.column(slot).alias("shard"),
                          (_lookup(first, slot, "bigint") + inside - 1).alias("place"), F.lit(slot_map.version).alias("map_version"))
