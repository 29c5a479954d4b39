"""Connected components of an edge table by alternating large-star and small-star steps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechlake.sources.shared import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of u to the smallest of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    linked = both.where("v > u").join(least, "u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link u and its smaller neighbours to the smallest of them; edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for each node of an edge, component being its smallest reachable node.

    Nodes may be of any ordered type. Edges with a null end and loops count for nothing; an empty table
    gives an empty one. Each round is written to the shared folder; rounds grow with the logarithm of
    the longest path. The smallest neighbours are pre-aggregated; the edges of a hub meet its one row in a join, whose large
    partitions Spark splits where adaptive execution is on.
    """
    e = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"), F.col(u).alias("_a"), F.col(v).alias("_b"))
    e = written(e.where("_a is not null and _b is not null and u <> v").select("u", "v").distinct(), "edges")
    mark = None
    while True:
        e = written(_small_star(_large_star(e)), "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
