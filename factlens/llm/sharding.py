"""Operator 7: contiguous shards of near equal bytes from global prefix sums. DataFrame functions only.

Rows are put in id order by a range exchange of a few numbers a row (never the text). Each partition's total is summed, the
totals' prefix sums (one row a partition) are joined to the rows, and a running sum inside each partition gives every row's
global byte offset. The shard is where the row's middle byte lies among the equal targets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_partitions, written


def shard_by_bytes(docs: DataFrame, shards: int = 16, *, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, byte_start, row_index of every row.

    Size is the text's UTF-8 bytes plus 1, so a null or empty text has size 1. Null ids come first. Rows that share an id
    are ordered by a hash of their text, then by a number given in the scan, so repeated rows get slots of their own, a hot
    id is split over partitions, and a shard may end inside it. No rows give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    p = partitions or n_partitions(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    order = ["doc_id", "tie", "seen"]
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("seen"))
    # Written once: the partition numbers must be the same for the totals and for the rows.
    rows = written(rows.repartitionByRange(p, *order).withColumn("part", F.spark_partition_id()), "shard-sizes")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))  # as many rows as partitions
    totals = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"), F.sum("bytes").over(every).alias("all_bytes"))
    inside = Window.partitionBy("part").orderBy(*order)
    run = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.withColumn("run", F.coalesce(F.sum("size").over(run), F.lit(0)))
        .withColumn("nth", F.row_number().over(inside) - 1)
        .join(F.broadcast(totals), "part")
        .withColumn("byte_start", F.col("bytes_before") + F.col("run"))
        .withColumn("row_index", F.col("rows_before") + F.col("nth"))
        .withColumn("shard", F.floor(((F.col("byte_start").cast("decimal(38,0)") * 2 + F.col("size")) * shards) / (F.col("all_bytes").cast("decimal(20,0)") * 2)).cast("int"))
        .withColumn("shard", F.least("shard", F.lit(shards - 1)))
    )
    starts = placed.groupBy("shard").agg(F.min("row_index").alias("first"))  # at most `shards` rows
    return placed.join(F.broadcast(starts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row_index") - F.col("first")).alias("slot"), "byte_start", "row_index")
