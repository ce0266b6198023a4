"""Contiguous shards of near-equal bytes by prefix sums (operator 3).

Rows are put in order of doc_id (null first; ties by checksum and size), dealt into ranges, and each range's
byte and row totals are summed up over the ranges. A row's place in the whole is then its range's offset plus
its prefix within the range, and the shard is where the middle of the row falls among n_shards equal targets:
no shard is further from its target than the longest document. Only a number for each range meets in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tasklore.llm.common import cut, parts, text_or_empty


def shard_by_bytes(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs (doc_id, text).

    A null text has size 1 (as an empty one). Repeated rows each get a slot of their own. A null doc_id sorts
    first. An empty table gives an empty result. Other columns are ignored.
    """
    text = text_or_empty()
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    order = ["doc_id", "text_crc32", "size", "tie"]
    ranged = cut(
        cut(rows.withColumn("tie", F.monotonically_increasing_id()))
        .repartitionByRange(parts(docs.sparkSession), *order)
        .withColumn("part", F.spark_partition_id())
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        ranged.groupBy("part")
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        .select(
            "part",
            F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
            F.sum("bytes").over(Window.partitionBy()).alias("total"),
        )
    )
    inside = Window.partitionBy("part").orderBy(*order)
    # one row for each range of the exchange above: its number of partitions bounds this broadcast
    placed = ranged.join(F.broadcast(totals), "part").select(
        "doc_id",
        "size",
        "text_crc32",
        "total",
        (F.col("bytes_before") + F.sum("size").over(inside) - F.col("size")).alias("start"),
        (F.col("rows_before") + F.row_number().over(inside) - 1).alias("at"),
    )
    middle = f"cast(((2 * start + size) * {n_shards}) div (2 * total) as int)"
    placed = placed.withColumn("shard", F.least(F.lit(n_shards - 1), F.expr(middle)))
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))  # n_shards rows
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("at") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
