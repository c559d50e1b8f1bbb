"""Sharding by fixed virtual slots.

A record's key is hashed into one of SLOTS virtual slots, whatever the number of shards.
Bytes are aggregated by slot, and a map says in which shard a slot is.  The map is stored by
version; rebalancing edits the last one: each shard keeps its largest slots up to the mean,
and only what is over moves, largest first, to the shard that holds least.

A slot that holds far more than others (a key of very many rows) is split into parts, which
the map places one by one; a row's part is decided by its number in the stored table.  Slots
and parts are at most twice SLOTS, so the map may be broadcast and edited in one row.
Everything is made of DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, shared_path, staged

SLOTS = 4096
#: A slot with more than this share of a shard's mean is split into parts of about a mean slot.
HOT = 1 / 64
MAP = "slot long, part int, parts int, shard int"


def records(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """``key, size, text_crc32, virtual_slot, row`` of every row, written once.

    ``size`` is the text's UTF-8 bytes plus one (null text: none, its checksum is 0).  Null keys share
    a slot.  ``row`` numbers the written rows, so repeated rows are told apart.
    """
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    slot = F.pmod(F.xxhash64(F.col(key)), F.lit(slots)).alias("virtual_slot")
    rows = docs.select(F.col(key).alias("key"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), slot)
    return staged(rows.withColumn("row", F.monotonically_increasing_id()), "records")


def fresh_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """The map before any bytes are known: slots in turn."""
    return spark.range(slots).select(F.col("id").alias("slot"), F.lit(0).alias("part"), F.lit(1).alias("parts"), F.pmod("id", F.lit(shards)).cast("int").alias("shard"))


def store_map(slot_map: DataFrame, folder: str, version: int) -> None:
    """Write a version; one that exists stays and raises an error."""
    slot_map.coalesce(1).write.mode("errorifexists").parquet(f"{folder}/version={version}")


def last_version(spark: SparkSession, folder: str) -> int:
    return spark.read.schema(f"{MAP}, version int").parquet(folder).agg(F.max("version")).first()[0]


def read_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A version of the map, the last one by default."""
    version = last_version(spark, folder) if version is None else version
    return spark.read.schema(MAP).parquet(f"{folder}/version={version}")


def _part(parts: Column) -> Column:
    return F.pmod(F.xxhash64("row"), parts).cast("int")


def split_hot(slot_map: DataFrame, rows: DataFrame, shards: int) -> DataFrame:
    """The map with hot slots in parts; a part begins in the shard of its slot's first part.

    A slot that has parts already keeps them, so parts never move by a split.
    """
    loads = rows.groupBy(F.col("virtual_slot").alias("slot")).agg(F.sum("size").alias("bytes"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    slots = slot_map.agg(F.countDistinct("slot")).first()[0]
    hot = loads.where(F.col("bytes") > total / shards * HOT).select("slot", F.ceil(F.col("bytes") / (total / slots)).cast("int").alias("wanted"))
    joined = slot_map.join(F.broadcast(hot), "slot", "left")
    grown = joined.where((F.col("parts") == 1) & (F.col("wanted") > 1))
    more = grown.select("slot", F.explode(F.sequence(F.lit(0), F.col("wanted") - 1)).alias("part"), F.col("wanted").alias("parts"), "shard")
    return joined.where(~((F.col("parts") == 1) & F.coalesce(F.col("wanted") > 1, F.lit(False)))).select("slot", "part", "parts", "shard").unionByName(more)


def part_bytes(slot_map: DataFrame, rows: DataFrame) -> DataFrame:
    """``slot, part, bytes``; rows are summed before anything is shuffled."""
    parts = slot_map.select("slot", "parts").distinct()
    placed = rows.join(F.broadcast(parts), rows["virtual_slot"] == F.col("slot"))
    return placed.groupBy("slot", _part(F.col("parts")).alias("part")).agg(F.sum("size").alias("bytes"))


def rebalanced(slot_map: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """The map edited for ``shards`` shards of near equal bytes.

    ``loads``: slot, part, bytes.  A shard keeps its largest slots while their sum is within the mean;
    empty slots stay.  The others go, by falling bytes, each to the shard that holds least then.  Slots
    of shards that no longer exist all go.
    """
    held = slot_map.join(loads, ["slot", "part"], "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    target = (held.agg(F.sum("bytes")).first()[0] or 0) / shards
    falling = Window.partitionBy("shard").orderBy(F.desc("bytes"), "slot", "part").rowsBetween(Window.unboundedPreceding, 0)
    marked = held.withColumn("stays", (F.col("shard") < shards) & ((F.sum("bytes").over(falling) <= target) | (F.col("bytes") == 0)))
    kept = marked.where("stays")
    # empty slots of a shard that goes are dealt in turn
    gone = marked.where("not stays and bytes = 0").withColumn("shard", F.pmod("slot", F.lit(shards)).cast("int"))
    sums = kept.groupBy("shard").agg(F.sum("bytes").alias("bytes")).unionByName(slot_map.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"), F.lit(0).cast("long").alias("bytes")))
    loads_of = sums.groupBy("shard").agg(F.sum("bytes").alias("bytes")).select(F.struct("shard", "bytes").alias("load"), F.lit(None).alias("moving"))
    moving = marked.where("not stays and bytes > 0").select(F.lit(None).alias("load"), F.struct((-F.col("bytes")).alias("less"), "slot", "part", "parts").alias("moving"))
    # one row: what each shard holds, and what moves, by falling bytes, then slot and part
    both = loads_of.unionByName(moving).agg(F.array_sort(F.collect_list("load")).alias("held"), F.array_sort(F.collect_list("moving")).alias("moving"))

    def place(state, x):
        at = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        now = F.transform(state["loads"], lambda y, j: F.when(j == at, y - x["less"]).otherwise(y))
        put = F.struct(x["slot"].alias("slot"), x["part"].alias("part"), x["parts"].alias("parts"), at.alias("shard"))
        return F.struct(now.alias("loads"), F.array_append(state["put"], put).alias("put"))

    first = F.struct(F.transform("held", lambda x: x["bytes"]).alias("loads"), F.array().cast("array<struct<slot:long,part:int,parts:int,shard:int>>").alias("put"))
    moved = both.select(F.inline(F.aggregate("moving", first, place)["put"]))
    return kept.select("slot", "part", "parts", "shard").unionByName(gone.select("slot", "part", "parts", "shard")).unionByName(moved)


def assigned(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``rows`` with ``shard``."""
    places = slot_map.groupBy("slot").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "shard"))), lambda x: x["shard"]).alias("shards"))
    joined = rows.join(F.broadcast(places), rows["virtual_slot"] == F.col("slot"))
    return joined.withColumn("shard", F.get("shards", _part(F.size("shards")))).drop("slot", "shards")


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``slot``: the place in the shard, without gaps from 0, in the order of ``row``.

    Rows are numbered within the parts in which the table was written, and counts of the parts before are
    added, so no task gets a whole shard.
    """
    split = rows.withColumn("written", F.shiftright("row", 33))
    counts = split.groupBy("shard", "written").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("written").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "written", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "written").orderBy("row")) - 1
    return split.withColumn("place", place).join(starts, ["shard", "written"]).withColumn("slot", F.col("place") + F.col("before")).drop("place", "before", "written")


def shard(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", slots: int = SLOTS, folder: str | None = None) -> DataFrame:
    """``key, size, text_crc32, shard, slot, virtual_slot`` of every row: shards of near equal bytes.

    ``folder`` holds the map's versions: the last one is edited for these rows and stored as the next; without
    one, a folder of this run begins with slots in turn.  Null text counts one byte, a very long text is
    one record that only its own slot feels; null and repeated keys are kept, each row has its place; an empty
    table gives no rows; other columns of any name are not looked at.
    """
    spark = docs.sparkSession
    rows = records(docs, key, text, slots)
    if folder is None:
        folder = shared_path(spark, "slot-map")
        store_map(fresh_map(spark, shards, slots), folder, 0)
    version = last_version(spark, folder)
    parted = staged(split_hot(read_map(spark, folder, version), rows, shards), "parted")
    store_map(rebalanced(parted, part_bytes(parted, rows), shards), folder, version + 1)
    dropped(spark, parted)
    placed = numbered(assigned(rows, read_map(spark, folder, version + 1)))
    return placed.select(F.col("key").alias(key), "size", "text_crc32", "shard", "slot", "virtual_slot")
