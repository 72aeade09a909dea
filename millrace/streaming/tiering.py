"""Tiering: rows older than a limit move to a cold, partitioned store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drain(hot: DataFrame, old: Column, path: str, partition: dict[str, Column]) -> DataFrame:
    """Append the rows that are ``old`` to the cold store and return those that stay; rows
    for which the condition is NULL stay. Write the result before draining again."""
    cold = hot.where(F.coalesce(old, F.lit(False)))
    for name, c in partition.items():
        cold = cold.withColumn(name, c)
    cold.write.mode("append").partitionBy(*partition).parquet(path)
    return hot.where(~F.coalesce(old, F.lit(False)))


def both_tiers(hot: DataFrame, cold: DataFrame) -> DataFrame:
    return hot.unionByName(cold.select(*hot.columns))
