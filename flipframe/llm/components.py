"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flipframe.llm.common import remove, written


def connected(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for every node that has an edge; root is the component's smallest node.

    Each round links every node to the smallest node it knows of: a large star moves a node's
    larger neighbours, a small star its smaller ones.  The smallest neighbour is found by an
    aggregate with map-side partial minima and joined back, so that AQE can split the join of a
    node with very many neighbours; no neighbour list is ever gathered.  Rounds end when the
    edge set no longer changes, which takes about log(longest path) rounds; every round's edges
    are written to the shared folder and the previous ones deleted.
    """
    spark = edges.sparkSession
    down = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct()
    table, path = written(spark, down, "edges")
    mark = _mark(table)
    while mark[0]:
        both = table.unionByName(table.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        )
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt, nxt_path = written(spark, small.unionByName(floor.withColumnRenamed("m", "v")).distinct(), "edges")
        new = _mark(nxt)
        remove(spark, path)
        table, path, same, mark = nxt, nxt_path, new == mark, new
        if same:
            break
    return table.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        table.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _mark(edges: DataFrame) -> tuple[int, str]:
    """Count and hash sum of the edge set, by which a round that changes nothing is known."""
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return int(r[0]), str(r[1])
