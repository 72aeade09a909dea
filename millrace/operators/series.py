"""Row sources without a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def generate_series(spark: SparkSession, start: int | None, stop: int | None, step: int | None = 1, name: str = "value") -> DataFrame:
    """Integers from start to stop. A zero step raises; a NULL bound, or a step that leads
    away from stop, gives no rows. Made on the executors, not on the driver."""
    if step == 0:
        raise ValueError("generate_series: step must not be zero")
    if start is None or stop is None or step is None or (stop - start) * step < 0:
        return spark.range(0).select(F.col("id").alias(name))
    return spark.range(start, stop + (1 if step > 0 else -1), step).select(F.col("id").alias(name))


def series_of(df: DataFrame, start: Column, stop: Column, step: int = 1, name: str = "value") -> DataFrame:
    """One row for each integer of each row's own range (lateral); empty ranges give none."""
    if step == 0:
        raise ValueError("generate_series: step must not be zero")
    fits = (stop >= start) if step > 0 else (stop <= start)
    values = F.when(fits, F.sequence(start.cast("long"), stop.cast("long"), F.lit(step).cast("long")))
    return df.withColumn(name, F.explode(values))


def subscripts(df: DataFrame, array: Column, name: str = "i") -> DataFrame:
    """generate_subscripts(a, 1): 1 to the array's size."""
    return series_of(df, F.lit(1), F.size(array), 1, name)


def dual(spark: SparkSession) -> DataFrame:
    """The one row of a SELECT without FROM."""
    return spark.range(1).select()


def values(spark: SparkSession, rows: list[tuple], types: list[str]) -> DataFrame:
    """Standalone VALUES, columns named column1, column2, ..."""
    return spark.createDataFrame(rows, ", ".join(f"column{i + 1} {t}" for i, t in enumerate(types)))
