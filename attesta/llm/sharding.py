"""Balanced contiguous shards from global prefix sums of byte sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.lineage import cut
from attesta.llm.common import texts


def assign_shards(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): every row, in key order, cut where the running size passes k/shards of all.

    The narrow rows are sorted into ranges of the key. One total per range (its rows and bytes) gives the offsets of
    the ranges; inside a range a running sum finishes the prefix. A row belongs to the shard in which its first byte
    lies, so shards are contiguous and differ from the target by less than one row. slot counts from 0 in each shard.
    size is the UTF-8 length (null text: none) plus 8. Rows with null keys come first; rows with equal keys are
    ordered by size and checksum, and equal ones among these may swap places. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), shards)
    sized = texts(docs, key, text).select(
        "doc_id", (F.octet_length("text") + 8).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("tie"),
    )
    order = [F.col("doc_id").asc_nulls_first(), "size", "text_crc32", "tie"]
    # Written once: the ranges come from a sample, and both passes below must see the same ones.
    ranged = cut(sized.repartitionByRange(n, *order).select("*", F.spark_partition_id().alias("part")))
    totals = ranged.groupBy("part").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(  # one row for each range
        "part",
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("row0"),
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte0"),
        F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy(*order)
    placed = ranged.select(
        "*", (F.row_number().over(inside) - 1).alias("row"), (F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("start")
    ).join(F.broadcast(offsets), "part")
    shard = F.expr(f"cast((byte0 + start) * cast({shards} as decimal(20,0)) div all_bytes as int)")
    placed = cut(placed.select("doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("row0") + F.col("row")).alias("place")))
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first"))  # one row for each shard
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot")
    )


def write_shards(docs: DataFrame, path: str, shards: int, key: str = "doc_id", text: str = "text") -> None:
    """Writes all columns of `docs` under `path`, one folder `part_of=<k>` for each shard; the key must be unique there."""
    placed = assign_shards(docs, shards, key, text).select(F.col("doc_id").alias("__key"), F.col("shard").alias("part_of"))
    joined = docs.join(placed, docs[key].eqNullSafe(placed["__key"])).drop("__key")
    joined.repartition("part_of").write.partitionBy("part_of").parquet(path)
