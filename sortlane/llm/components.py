"""Connected components of an edge table by alternating star operations.

Both operations only need the smallest neighbour of each node, which partial
aggregation finds, and a join of the edges with it; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, staged


def components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """``node, component`` (the smallest reachable node) of nodes that have an edge in ``edges`` (a, b: long).

    Rounds grow with the logarithm of the longest path; more than ``most_rounds`` raise an error.
    """
    spark = edges.sparkSession
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, before = staged(e, "edges"), None
    for _ in range(most_rounds):
        now = e.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
        if now == before or now.n == 0:
            break
        before = now
        # large star: larger neighbours of a node move to its smallest neighbour
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = staged(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        # small star: smaller neighbours of a node, and the node, move to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = staged(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        dropped(spark, e, large)
        e = new
    else:
        raise RuntimeError(f"components are not complete after {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
