"""Operator 5, sharding by bytes: global prefix sums from per-partition totals, cut at equal targets.

Rows are ordered by (id, size, CRC, place in the input) over a sampled range partitioning of
narrow rows; texts are read once and never shuffled. Each partition adds up its own bytes and
rows; a prefix sum over the partitions' totals (one row a partition) and a running sum inside
each partition give every row its global byte and row offset. A row belongs to the shard in
whose byte range its middle lies, so shards are contiguous and differ from the target by less
than one row at either end.

Defined cases: a null text has no bytes and counts 1; null ids come first; rows that repeat an
id (or agree in everything) are separate rows, dealt over partitions by their place in the
input, so a hot id is split; an empty table gives no rows; a row larger than a shard's target
leaves neighbouring shards empty; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritab.llm.common import cut, whole

SHARDS = 16


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, size, text_crc32, shard, slot)``; ``slot`` counts from 0 within a shard."""
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(whole(text_col)) + F.lit(1)).cast("long").alias("size"),
        F.crc32(whole(text_col)).alias("text_crc32"),
        F.monotonically_increasing_id().alias("place"),
    )
    order = ["id", "size", "text_crc32", "place"]
    rows = cut(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumns({"upto": F.sum("size").over(inside), "nth": F.row_number().over(inside)}).join(totals, "part")
    placed = placed.select(
        "id", "size", "text_crc32",
        (F.col("rows_before") + F.col("nth") - 1).alias("at"),
        # twice the row's middle in bytes, times shards, over twice all bytes
        F.expr(f"cast({shards} * (2 * (bytes_before + upto) - size) div (2 * all_bytes) as int)").alias("shard"),
    )
    placed = cut(placed)
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))  # at most `shards` rows
    return placed.join(F.broadcast(first), "shard").select(
        "id", "size", "text_crc32", "shard", (F.col("at") - F.col("first")).alias("slot")
    )
