"""Shards by fixed virtual slots and a versioned slot-to-shard map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wagerframe.llm.registry import query, table
from wagerframe.llm.shared import save, shared_folder

SLOTS = 4096


def record_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def virtual_slot(slots: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(slots)).cast("int")


def first_map(spark: SparkSession, slots: int, shards: int) -> DataFrame:
    """Version 0: slots dealt to the shards in turn."""
    return spark.range(slots).select(F.col("id").cast("int").alias("slot"), (F.col("id") % shards).cast("int").alias("shard"))


def slot_loads(records: DataFrame, slots: int) -> DataFrame:
    """(slot, load, n): bytes and rows of every slot, empty ones included; ``slots`` rows."""
    loads = records.groupBy("slot").agg(F.sum("size").alias("load"), F.count(F.lit(1)).alias("n"))
    every = records.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"))
    return every.join(loads, "slot", "left").select(
        "slot", F.coalesce("load", F.lit(0)).alias("load"), F.coalesce("n", F.lit(0)).alias("n")
    )


def _deal(items: Column, loads: Column) -> Column:
    """The shard of each of ``items`` (load, slot), taken in order, each to the least loaded shard."""

    def step(state: Column, item: Column) -> Column:
        to = (F.array_position(state["loads"], F.array_min(state["loads"])) - 1).cast("int")
        return F.struct(
            F.transform(state["loads"], lambda x, i: F.when(i == to, x + item["load"]).otherwise(x)).alias("loads"),
            F.concat(state["to"], F.array(to)).alias("to"),
        )

    return F.aggregate(items, F.struct(loads.alias("loads"), F.array().cast("array<int>").alias("to")), step)["to"]


def fair_level(loads: DataFrame, shards: int) -> DataFrame:
    """One row (level): the load that shards can share, apart from slots that are larger than it by themselves."""
    largest = Window.orderBy(F.desc("load"), "slot")
    before = F.sum("load").over(largest.rowsBetween(Window.unboundedPreceding, 0)) - F.col("load")
    ranked = loads.select(
        "load", (F.row_number().over(largest) - 1).alias("above"), (F.sum("load").over(Window.partitionBy()) - before).alias("rest")
    ).filter(F.col("above") < shards)
    level = F.col("rest") / (shards - F.col("above"))
    return ranked.withColumn("level", level).filter(F.col("load") <= F.col("level")).agg(F.min_by("level", "above").alias("level"))


def rebalance(current: DataFrame, loads: DataFrame, shards: int, slack: float = 0.05) -> DataFrame:
    """An edited map with near equal bytes per shard.

    A shard keeps its largest slots up to ``1 - slack`` of the fair level; only the
    slots beyond that move, largest first, each to the least loaded shard. All
    tables here have one row per virtual slot, so one row can hold them.
    """
    fair = fair_level(loads, shards).first()["level"]  # one number
    held = current.join(loads, "slot")
    order = Window.partitionBy("shard").orderBy(F.desc("load"), "slot").rowsBetween(Window.unboundedPreceding, 0)
    marked = held.withColumn("_stays", F.sum("load").over(order) <= (1 - slack) * fair)
    entry = F.struct("load", "slot", "shard")
    row = marked.agg(
        F.collect_list(F.when(F.col("_stays"), entry)).alias("kept"),
        F.sort_array(F.collect_list(F.when(~F.col("_stays"), entry)), asc=False).alias("moved"),
    )
    start = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda s: F.aggregate(F.filter("kept", lambda x: x["shard"] == s), F.lit(0).cast("long"), lambda a, x: a + x["load"]),
    )
    moved = F.transform(
        F.arrays_zip("moved", F.col("to")), lambda x: F.struct(x["moved"]["load"].alias("load"), x["moved"]["slot"].alias("slot"), x["to"].alias("shard"))
    )
    return (
        row.withColumn("to", _deal(F.col("moved"), start))
        .select(F.explode(F.concat("kept", moved)).alias("x"))
        .select("x.slot", "x.shard")
    )


def grow(current: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """A map for one shard more: each shard hands over slots up to its share; none move between old shards."""
    share = F.sum("load").over(Window.partitionBy("shard")) / (shards + 1)
    order = Window.partitionBy("shard").orderBy(F.xxhash64("slot"), "slot").rowsBetween(Window.unboundedPreceding, 0)
    held = current.join(loads, "slot")
    return held.select("slot", F.when(F.sum("load").over(order) <= share, F.lit(shards)).otherwise(F.col("shard")).alias("shard"))


class SlotMap:
    """Versions of the slot-to-shard map, one Parquet folder each below ``path``; none is overwritten."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def store(self, version: int, slot_map: DataFrame) -> DataFrame:
        slot_map.select("slot", "shard").coalesce(1).write.parquet(f"{self.path}/version={version}")
        return self.load(version)

    def load(self, version: int) -> DataFrame:
        return self.spark.read.schema("slot int, shard int").parquet(f"{self.path}/version={version}")


def shard_documents(docs: DataFrame, shards: int = 16, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Shard every row of ``docs`` by the law ``bytes``: shards hold near equal bytes.

    Records are hashed by id and text into ``slots`` fixed virtual slots, so copies
    of a text spread out. Version 0 of the map deals slots in turn, version 1 is
    edited by the bytes per slot. ``place`` numbers the rows of a shard from 0:
    by virtual slot, then id and checksum within it, from counts per slot, so no
    shard is ordered as a whole. The map has ``slots`` rows, which bounds its
    broadcast (``slots`` may be at most 65,536).

    Null texts have size 1 and checksum 0; null ids are hashed like any; equal rows
    share a slot and get places of their own; no rows give no rows. Other columns
    are not read.
    """
    if not shards <= slots <= 65_536:
        raise ValueError("slots must be at least the number of shards and at most 65536")
    spark = docs.sparkSession
    records = save(
        docs.select(
            "doc_id",
            record_size(F.col("text")).alias("size"),
            F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
            virtual_slot(slots, "doc_id", "text").alias("slot"),
        ),
        "shard-records",
    )
    maps = SlotMap(spark, map_path or shared_folder(spark, "slot-map"))
    loads = save(slot_loads(records, slots), "slot-loads")
    current = maps.store(0, first_map(spark, slots, shards))
    edited = maps.store(1, rebalance(current, loads, shards))
    before = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = edited.join(loads, "slot").select(
        "slot", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )
    in_slot = Window.partitionBy("slot").orderBy("doc_id", "text_crc32", "size")
    return records.join(F.broadcast(placed), "slot").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first") + F.row_number().over(in_slot) - 1).cast("long").alias("place"),
        F.col("slot").alias("virtual_slot"),
    )


@query("op2_shards")
def op2_shards(spark: SparkSession, folder: str) -> DataFrame:
    return shard_documents(table(spark, folder, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        "law",
        "shard",
        F.col("place").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )
