"""Aggregates with embedded-SQL semantics, as Columns for ``groupBy().agg()``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    """A real, 0.0 over no values."""
    return F.coalesce(F.sum(x.cast("double")), F.lit(0.0))


def group_concat(x: Column, *order: Column, separator: str = ",", distinct: bool = False) -> Column:
    """Non-NULL values as text in the order given (always give one: scans have none);
    NULL over no values."""
    if distinct:
        items = F.array_sort(F.collect_set(x.cast("string")))
    else:
        items = F.transform(F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], x.cast("string").alias("v"))))), lambda r: r["v"])
    return F.when(F.size(items) > 0, F.array_join(items, separator))


def array_agg(x: Column, *order: Column) -> Column:
    """Keeps NULLs, in the order given; NULL over no rows."""
    items = F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], x.alias("v")))
    return F.when(F.size(items) > 0, F.transform(F.array_sort(items), lambda r: r["v"]))


def filtered(agg, x: Column, where: Column) -> Column:
    """agg(x) FILTER (WHERE ...), for aggregates that skip NULLs."""
    return agg(F.when(where, x))


def bool_and(x: Column) -> Column:
    return F.min(x)


def bool_or(x: Column) -> Column:
    return F.max(x)


def bare_with_max(bare: str, key: str, pk: str) -> Column:
    """The bare column of the row that holds the maximum; ties go to the lowest pk, a group
    of NULLs only to its last row."""
    best = F.max_by(F.struct(F.col(bare)), F.when(F.col(key).isNotNull(), F.struct(F.col(key), -F.col(pk))))
    return F.coalesce(best, F.max_by(F.struct(F.col(bare)), F.col(pk)))[bare]


def bare_with_min(bare: str, key: str, pk: str) -> Column:
    best = F.min_by(F.struct(F.col(bare)), F.when(F.col(key).isNotNull(), F.struct(F.col(key), F.col(pk))))
    return F.coalesce(best, F.max_by(F.struct(F.col(bare)), F.col(pk)))[bare]


def bare_first(bare: str, pk: str) -> Column:
    """Without min or max, the row of lowest pk speaks for its group."""
    return F.min_by(F.struct(F.col(bare)), F.col(pk))[bare]


def salted_count(df: DataFrame, keys: list[str], distinct: str, salts: int = 32) -> DataFrame:
    """count(DISTINCT x) by keys where one key holds a large share of all rows: values are
    counted in ``salts`` parts by their own hash first, whose counts add up exactly."""
    part = df.where(F.col(distinct).isNotNull()).groupBy(*keys, F.pmod(F.xxhash64(distinct), F.lit(salts)).alias("_s")).agg(F.countDistinct(distinct).alias("_n"))
    return part.groupBy(*keys).agg(F.sum("_n").alias("n"))
