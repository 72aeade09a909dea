"""Order, limits and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def limit_offset(df: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """A negative or absent limit means all rows; a negative offset means 0."""
    if offset and offset > 0:
        df = df.offset(offset)
    return df if limit is None or limit < 0 else df.limit(limit)


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """Plans as TakeOrderedAndProject: k rows a task, then k rows."""
    return df.orderBy(*order).limit(k)


def top_k_each(df: DataFrame, keys: list[str], k: int, *order: Column, name: str = "rank") -> DataFrame:
    """The first k rows of each group; the planner limits each group map-side first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
