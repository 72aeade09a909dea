"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import cut, drop


def components(edges: DataFrame, a: str = "a", b: str = "b", limit: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge.

    Alternates large-star and small-star steps, each written to the shared folder. Every
    step aggregates with map-side combination first, so a hub costs no more than its
    edges. Self-loops and nulls are dropped; no edges give an empty table. Node type: long.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    for _ in range(limit):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.where("m < u").select("u", F.col("m").alias("v")))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        before, e = e, cut(small.where("u <> v").distinct(), "edges")
        drop(before)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if tuple(now) == state:
            roots = e.select(F.col("v").alias("node")).distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.withColumn("component", F.col("node")))
        state = tuple(now)
    raise RuntimeError("components did not settle")
