"""Contiguous shards of equal bytes from a global prefix sum."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framedrift.llm.common import blank_null, settle

ROW_BYTES = 8


def shard_by_bytes(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Assign every row to one of ``shards`` contiguous runs of near equal bytes.

    Rows are ordered by (key, checksum, size), cut into ranges, and each range's totals give where it
    starts in the corpus; inside a range a running sum does the rest. The shard is where the middle of
    a row falls when all bytes are cut at ``shards`` equal targets, so a shard misses its target by at
    most half a row at either end. ``slot`` counts from 0 inside a shard.

    The size of a row is its UTF-8 bytes plus ROW_BYTES; null texts have none. Null keys come first.
    Rows equal in key and text may take each other's slots. A text longer than a shard is one row of it. Other columns are not read; an empty
    table gives an empty result. Returns (key, size, text_crc32, shard, slot).
    """
    order = ["_key", "text_crc32", "size"]
    narrow = docs.select(
        F.col(key).alias("_key"),
        (F.octet_length(blank_null(text)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(blank_null(text).cast("binary")).alias("text_crc32"),
    )
    # Settled, since ranges are drawn from a sample and must be the same for totals and rows.
    ranged = settle(narrow.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))

    # One row per range: bounded by the number of tasks, whatever the number of rows.
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = ranged.groupBy("_range").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows")).select(
        "_range",
        F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
        F.sum("_bytes").over(everything).alias("_total"),
    )
    before = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        ranged.withColumn("_inside", F.coalesce(F.sum("size").over(before), F.lit(0)))
        .withColumn("_row", F.count(F.lit(1)).over(upto) - 1)
        .join(F.broadcast(starts), "_range")
        .withColumn("_twice", 2 * (F.col("_bytes_before") + F.col("_inside")) + F.col("size"))
        .withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"(_twice * {shards}) div (2 * _total)")).cast("int"))
        .withColumn("_row", F.col("_row") + F.col("_rows_before"))
        .select("_key", "size", "text_crc32", "shard", "_row")
    )
    placed = settle(placed)
    firsts = placed.groupBy("shard").agg(F.min("_row").alias("_first"))
    return placed.join(F.broadcast(firsts), "shard").select(
        F.col("_key").alias(key), "size", "text_crc32", "shard", (F.col("_row") - F.col("_first")).alias("slot")
    )
