"""Sharding by fixed virtual slots.

Every record is hashed into one of a fixed number of slots; bytes are summed per slot, and a small
versioned table maps each slot to a shard. Rebalancing edits that table; no record is hashed anew.
DataFrame operations only.

Nulls: a null text has no bytes, a null id hashes as such. Empty table: an empty plan. Repeated rows:
each is placed, beside its twin, in the same slot. Ties: of equal loads the lower shard takes the next slot, of equal slots the higher number goes first. Long texts: a
slot with one may be larger than a fair share, which the others make up for. Other columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.common import scratch, stored

SLOTS = 4096
MAP = "vslot int, shard int, bytes long, n long, version int"


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(id, size, crc, vslot): size is the text's UTF-8 bytes plus 1."""
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(
        docs[id_col].cast("long").alias("id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.pmod(F.xxhash64(docs[id_col], text), F.lit(slots)).cast("int").alias("vslot"),
    )


def slot_sizes(rows: DataFrame) -> DataFrame:
    """(vslot, bytes, n) of each slot that has rows: at most as many rows as there are slots."""
    return rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))


def first_map(sizes: DataFrame, shards: int) -> DataFrame:
    """(version 1, vslot, shard, bytes, n): slots by descending bytes, each to the shard with the fewest bytes so far."""
    packed = sizes.agg(F.sort_array(F.collect_list(F.struct("bytes", "vslot", "n")), asc=False).alias("slots"))
    placed = packed.select(
        F.expr(f"""
        aggregate(slots,
          named_struct('loads', array_repeat(0L, {shards}), 'out', cast(array() as array<struct<vslot:int,shard:int,bytes:bigint,n:bigint>>)),
          (acc, x) -> named_struct(
            'loads', transform(acc.loads, (v, i) -> if(i = array_position(acc.loads, array_min(acc.loads)) - 1, v + x.bytes, v)),
            'out', array_append(acc.out, named_struct('vslot', x.vslot, 'shard', cast(array_position(acc.loads, array_min(acc.loads)) - 1 as int), 'bytes', x.bytes, 'n', x.n)))).out
        """).alias("out")
    )
    return placed.select(F.inline("out")).select(F.lit(1).alias("version"), "vslot", "shard", "bytes", "n")


def edited_map(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version for one more shard (shards counts it): from each shard, its smallest slots beyond its fair share move to the new one; no others move.

    The moved slots are the last in each shard by descending bytes whose running sum stays within
    what the shard holds above total / shards.
    """
    fair = F.sum("bytes").over(W.partitionBy("version")) / F.lit(shards)
    held = F.sum("bytes").over(W.partitionBy("shard"))
    tail = F.sum("bytes").over(W.partitionBy("shard").orderBy(F.asc("bytes"), F.asc("vslot")).rowsBetween(W.unboundedPreceding, 0))
    moves = slot_map.select("*", fair.alias("_fair"), held.alias("_held"), tail.alias("_tail"))
    return moves.select(
        (F.col("version") + 1).alias("version"),
        "vslot",
        F.when(F.col("_tail") <= F.col("_held") - F.col("_fair"), F.lit(shards - 1)).otherwise(F.col("shard")).cast("int").alias("shard"),
        "bytes",
        "n",
    )


def save_map(slot_map: DataFrame, path: str) -> None:
    """Adds the map's version to the stored history; a version that is there already is written over, so a retry changes nothing."""
    slot_map.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version, by default the newest."""
    kept = spark.read.schema(MAP).parquet(path)
    version = kept.agg(F.coalesce(F.max("version"), F.lit(1))).first()[0] if version is None else version
    return kept.where(F.col("version") == version).select("version", "vslot", "shard", "bytes", "n")


def place(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """rows with shard and their gapless place in it from 0.

    The place is the row's rank in its slot plus the rows of the shard's earlier slots, so ranks are
    taken over thousands of small groups and never over a whole shard. The map has a row a slot at
    most, which bounds what is broadcast.
    """
    before = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("vslot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = slot_map.select("vslot", "shard", before.alias("before"))
    rank = F.row_number().over(W.partitionBy("vslot").orderBy("id", "crc", "size"))
    return rows.withColumn("rank", rank).join(F.broadcast(offsets), "vslot").withColumn("place", (F.col("before") + F.col("rank") - 1).cast("long"))


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """(id, size, crc, vslot, shard, place) of all rows under version 1 of a new map, stored at map_path (by default a new path of the shared folder) and read from there."""
    spark = docs.sparkSession
    map_path = map_path or scratch(spark, "slot-maps")
    rows = stored(records(docs, id_col, text_col, slots), "shard-rows")
    save_map(first_map(slot_sizes(rows), shards), map_path)
    return place(rows, load_map(spark, map_path, 1))


def grown(spark: SparkSession, map_path: str, shards: int) -> DataFrame:
    """The stored newest map edited for one more shard (shards counts it), stored as the next version and read from there."""
    save_map(edited_map(load_map(spark, map_path), shards), map_path)
    return load_map(spark, map_path)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of near equal bytes under the stored version 1; next_shard: under version 2, edited for a ninth shard."""
    path = scratch(spark, "slot-maps")
    out = shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"), 8, map_path=path)
    later = grown(spark, path, 9).select("vslot", F.col("shard").alias("next_shard"))
    return out.join(F.broadcast(later), "vslot").select(
        F.col("id").alias("doc_id"),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        F.col("place").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.lit(1).alias("map_version"),
        "next_shard",
    )
