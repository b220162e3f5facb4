"""Global positions in a total order, from range partitions and their totals.

Rows are range-partitioned on the whole order (ending in a unique id, so no value is too common
to be split), and the partitioned rows are written once to the shared scratch folder: partition
numbers are then plain data that a retry can't change.  A partial aggregate gives each
partition's totals, a running sum over that table (as many rows as partitions and groups) the
totals before each partition, and a window inside a partition the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flipframe.session import scratch_table, shuffle_partitions

PART = "_part"


def in_ranges(df: DataFrame, order: Sequence[Column | str], n_parts: int | None = None) -> DataFrame:
    """``df`` range-partitioned on ``order`` and written out, with its partition number ``_part``."""
    spark = df.sparkSession
    n = n_parts or shuffle_partitions(spark)
    # strings of digits etc. sort as they are; the partition number follows the order
    return scratch_table(df.repartitionByRange(n, *order).withColumn(PART, F.spark_partition_id()), "ranges")


def running_totals(ranged: DataFrame, order: Sequence[Column | str], amount: Column, out_col: str,
                   by: Sequence[str] = (), total_col: str | None = None) -> DataFrame:
    """Sum of ``amount`` over all earlier rows of the row's ``by`` group (exclusive).

    ``ranged`` comes from :func:`in_ranges` on ``by`` followed by ``order``.
    """
    by = list(by)
    d = ranged.withColumn("_amount", amount)
    per = d.groupBy(*by, PART).agg(F.sum("_amount").alias("_sum"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    offs = per.select(*by, PART,
                      F.coalesce(F.sum("_sum").over(group.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
                      F.sum("_sum").over(group).alias("_total"))
    inside = Window.partitionBy(*by, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.join(offs, on=[*by, PART])
    d = d.withColumn(out_col, F.col("_off") + F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
    if total_col:
        d = d.withColumn(total_col, F.col("_total"))
    return d.drop("_amount", "_off", "_total", PART)


def global_position(df: DataFrame, order: Sequence[Column | str], out_col: str, n_parts: int | None = None) -> DataFrame:
    """0-based position of every row in ``order``."""
    return running_totals(in_ranges(df, order, n_parts), order, F.lit(1).cast("long"), out_col)
