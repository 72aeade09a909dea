"""Exact nearest neighbours of one query vector: filter first, then a bounded top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors


def nearest(df: DataFrame, vec: str, query: list[float], k: int, pk: str, metric: str = "l2", where: Column | None = None, keep_null: bool = True) -> DataFrame:
    """k rows of least distance, NULL distances first (or left out), ties by ``pk``. Plans as
    TakeOrderedAndProject, so only k rows a task move."""
    measure = {"l2": vectors.l2, "cosine": vectors.cosine}[metric]
    if where is not None:
        df = df.where(where)
    out = df.withColumn("distance", measure(F.col(vec), vectors.literal(query)))
    if not keep_null:
        out = out.where(F.col("distance").isNotNull())
    return out.orderBy(F.asc_nulls_first("distance"), pk).limit(k)
