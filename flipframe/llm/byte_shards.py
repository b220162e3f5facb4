"""Sharding by global byte-size prefix sums (DataFrame operations only).

Rows are put in one total order (id, then text checksum, then input position) by range
partitioning, so no key's rows need share a partition.  Every partition's byte and row totals
give its global offsets; a running sum inside the partition gives each row's own.  The byte
line is then cut at equal targets into contiguous shards.

A row's size is the UTF-8 bytes of its text plus 1; null text counts 1.  Repeated rows are
sharded as often as they occur and are interchangeable.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flipframe.llm.common import ready, written
from flipframe.session import shuffle_partitions


def byte_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot (0.. within the shard, in
    order), grown_shard (null: under this law another shard moves rows of all others too).

    A row belongs to the shard in which the middle of its bytes lies, so a shard's size differs
    from total / ``shards`` by at most the size of one row.
    """
    spark = docs.sparkSession
    ready(spark)
    body = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.coalesce(F.octet_length(body), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("at"),
    )
    order = ["doc_id", "text_crc32", "size", "at"]
    # the narrow rows are fixed in a written table: partition numbers can't shift on a retry
    dealt, _ = written(
        spark,
        rows.repartitionByRange(shuffle_partitions(spark), *order).withColumn("part", F.spark_partition_id()),
        "byte-shards",
    )
    totals = dealt.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
    # one row per partition: the only ungrouped window runs over partition totals
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        F.col("part").alias("p"),
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("part_bytes").over(whole).alias("total"),
    )
    running = Window.partitionBy("part").orderBy(*order)
    prefix = (
        dealt.withColumn("bytes_in", F.sum("size").over(running.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("row_in", F.row_number().over(running) - 1)
        .join(F.broadcast(offsets), F.col("part") == F.col("p"))  # as many rows as shuffle partitions
        .select(
            "doc_id", "size", "text_crc32", "total",
            (F.col("bytes_before") + F.coalesce("bytes_in", F.lit(0))).alias("begin"),
            (F.col("rows_before") + F.col("row_in")).alias("row"),
        )
    )
    cut = prefix.withColumn(
        "shard", F.least(F.lit(shards - 1), F.expr(f"({shards} * (2 * begin + size)) div (2 * total)")).cast("int")
    )
    first = cut.groupBy("shard").agg(F.min("row").alias("first_row")).withColumnRenamed("shard", "s")
    return cut.join(F.broadcast(first), F.col("shard") == F.col("s")).select(  # one row per shard
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("row") - F.col("first_row")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
