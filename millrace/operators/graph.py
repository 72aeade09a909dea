"""Traversal of an edge table (src, dst): degree, hops, reach, triangles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .recursion import fixpoint, written


def degrees(edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree)."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def hops(edges: DataFrame, start: DataFrame, n: int) -> DataFrame:
    """Distinct nodes at the end of a walk of exactly n edges from the start ids."""
    out = start.select(F.col(start.columns[0]).alias("id"))
    for _ in range(n):
        out = out.join(edges, out["id"] == edges["src"]).select(F.col("dst").alias("id")).distinct()
    return out


def reach(edges: DataFrame, start: DataFrame, n: int | None = None) -> DataFrame:
    """(id, depth) of all nodes within n edges (all reachable, without n), at least depth. The
    edges are written once, so that no step computes them again."""
    edges = written(edges.select("src", "dst"), "edges")
    first = start.select(F.col(start.columns[0]).alias("id"), F.lit(0).alias("depth"))

    def step(new: DataFrame) -> DataFrame:
        go = new if n is None else new.where(F.col("depth") < n)
        return go.join(edges, go["id"] == edges["src"]).select(F.col("dst").alias("id"), (F.col("depth") + 1).alias("depth"))

    return fixpoint(first, step, key=["id"])


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c), each undirected triangle once. Edges point from lower to higher degree, so
    a hub's wedges are made by its neighbours and their number stays small."""
    both = edges.where("src <> dst").select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).distinct()
    deg = both.select(F.explode(F.array("x", "y")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    e = both.join(deg.select(F.col("id").alias("x"), F.col("d").alias("dx")), "x").join(deg.select(F.col("id").alias("y"), F.col("d").alias("dy")), "y")
    up = F.struct("dx", "x") < F.struct("dy", "y")
    e = e.select(F.when(up, F.col("x")).otherwise(F.col("y")).alias("u"), F.when(up, F.col("y")).otherwise(F.col("x")).alias("v"))
    wedge = e.alias("p").join(e.alias("q"), F.col("p.u") == F.col("q.u")).where("p.v < q.v").select(F.col("p.u").alias("u"), F.col("p.v").alias("v"), F.col("q.v").alias("w"))
    closed = wedge.join(both, (wedge["v"] == both["x"]) & (wedge["w"] == both["y"]), "left_semi")
    s = F.array_sort(F.array("u", "v", "w"))
    return closed.select(s[0].alias("a"), s[1].alias("b"), s[2].alias("c"))


def reverse_edges(edges: DataFrame) -> DataFrame:
    """The derived reverse-edge structure."""
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])
