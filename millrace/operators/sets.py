"""Compound queries: left to right with one precedence, arms of equal types only."""

from __future__ import annotations

from pyspark.sql import DataFrame


def compound(first: DataFrame, *arms: tuple[str, DataFrame]) -> DataFrame:
    """``compound(a, ("union", b), ("intersect", c))`` is (a UNION b) INTERSECT c: Spark SQL
    would bind INTERSECT tighter. NULLs are equal. Types must agree exactly, names come from
    the first arm."""
    out, kinds = first, [f.dataType for f in first.schema]
    for kind, arm in arms:
        if [f.dataType for f in arm.schema] != kinds:
            raise TypeError("arms of a compound query must have the same types")
        arm = arm.toDF(*first.columns)
        if kind == "union all":
            out = out.union(arm)
        elif kind == "union":
            out = out.union(arm).distinct()
        elif kind == "except":
            out = out.subtract(arm)
        elif kind == "intersect":
            out = out.intersect(arm)
        else:
            raise ValueError(f"unknown set operation {kind!r}")
    return out
