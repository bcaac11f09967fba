"""Contiguous shards of nearly equal size, from global prefix sums.

Documents are put in order by ranges. Each range's bytes are summed, the sums
of the ranges before it give every range its offset, and a running sum inside
the range gives every document its place on one line of ``total`` bytes. The
line is cut at equal targets. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .staging import staged


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, size, text_crc32, shard, slot.

    size: UTF-8 bytes of the text plus 1 (null text: 1); text_crc32: unsigned,
    of the UTF-8 bytes (null text: of none). A document goes to the shard on
    whose stretch its middle lies, so shards are contiguous in id order and
    differ from the target by less than one document at each end. slot counts
    from 0 in each shard, without gaps.

    Null ids come first; rows with one id stand by checksum, then size; equal
    rows are interchangeable. An empty table gives no rows. Other columns are
    not read, whatever their names.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"))
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.asc_nulls_first("id"), F.col("crc"), F.col("size")]
    # The range of each row is pinned in a table: sums and rows must agree on it.
    # Neither the number of ranges nor the rows of the sums below grow with it.
    ranged = staged(sized.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()), "shard-ranges")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    sums = sums.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"), F.sum("bytes").over(W.partitionBy(F.lit(0))).alias("total"))
    inside = W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = ranged.withColumns({"upto": F.sum("size").over(inside), "nth": F.row_number().over(inside)}).join(F.broadcast(sums), "part")
    placed = placed.select("id", "size", "crc", (F.col("rows_before") + F.col("nth") - 1).alias("row"), F.least(F.lit(shards - 1).cast("long"), F.expr("(2 * (bytes_before + upto) - size) * %d div (2 * total)" % shards)).cast("int").alias("shard"))
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first"))  # at most ``shards`` rows
    return placed.join(F.broadcast(firsts), "shard").select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("row") - F.col("first")).alias("slot"))
