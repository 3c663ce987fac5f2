"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, remove


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): for every node of an undirected edge table, the smallest node that links reach.

    Alternating large-star and small-star steps: each node hands its smallest neighbour to the others.  A step is two
    aggregates with map-side partial results and one join on the node, so a node of very many links is no group that one
    task must hold; the optimiser may split it.  Each step ends in a table in the shared folder.  Nodes that no edge
    names are not in the result.  Null ends and loops are ignored; an empty table gives an empty result.
    """
    spark = edges.sparkSession
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    now = materialize(now, "edges")
    for _ in range(max_rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v")
        # small-star: now every edge runs from the larger to the smaller end
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        after = materialize(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        # done when no node has two parents and no parent has a parent: one aggregate over the ends of all edges
        ends = after.select(F.col("u").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("parent")).union(after.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("x").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
        done = ends.where("child > 1 or child = 1 and parent = 1").isEmpty()
        for old in {p.rsplit("/", 1)[0] for p in now.inputFiles()}:
            remove(spark, old)
        now = after
        if done:
            break
    else:
        raise RuntimeError("components: no convergence")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
