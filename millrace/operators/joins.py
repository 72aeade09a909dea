"""Joins that need more than ``DataFrame.join``: null-aware anti joins, range and as-of joins.

Plain inner, left, right, full, cross, USING, NATURAL and self joins are Spark's own. Sizes
decide broadcasts at run time (AQE); nothing here forces one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def using(left: DataFrame, right: DataFrame, *names: str, how: str = "inner") -> DataFrame:
    """USING: the named columns appear once, first."""
    return left.join(right, list(names), how)


def natural(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """All common columns; none makes it a cross join."""
    common = [c for c in left.columns if c in right.columns]
    return left.join(right, common, how) if common else left.crossJoin(right)


def semi(left: DataFrame, right: DataFrame, on: list[str] | Column) -> DataFrame:
    return left.join(right, on, "left_semi")


def anti(left: DataFrame, right: DataFrame, on: list[str] | Column) -> DataFrame:
    """NOT EXISTS: a NULL key never matches, so its row stays."""
    return left.join(right, on, "left_anti")


def not_in(left: DataFrame, key: str, right: DataFrame, right_key: str) -> DataFrame:
    """NOT IN (SELECT ...), three-valued: a NULL on the right leaves no row; an empty right
    leaves all, even those with a NULL key. The right side's NULL and row counts are one
    aggregate row, so the join stays an equi-join instead of a nested loop."""
    facts = right.agg(F.count("*").alias("_n"), F.count(F.when(F.col(right_key).isNull(), 1)).alias("_nulls"))
    keys = right.where(F.col(right_key).isNotNull()).select(F.col(right_key).alias("_k")).distinct()
    kept = left.join(keys, left[key] == keys["_k"], "left_anti").crossJoin(facts)
    return kept.where((F.col("_n") == 0) | ((F.col("_nulls") == 0) & F.col(key).isNotNull())).select(*left.columns)


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """point BETWEEN low AND high, by bins of ``width``: the interval side is exploded over its
    bins, so the join is an equi-join whose rows grow with the intervals' length in bins.
    Choose a width near the usual interval; NULL bounds match nothing."""
    binned = left.withColumn("_bin", F.floor(F.col(point) / width))
    span = F.when(F.col(high) >= F.col(low), F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width)))
    wide = right.withColumn("_bin", F.explode(span))
    return binned.join(wide, "_bin").where(F.col(point).between(F.col(low), F.col(high))).drop("_bin")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], time: str, values: list[str], bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """For each left row the right row of its key with the greatest time at or before its own
    (an extension). A union and one window replace the pairs of a join. A key that holds much
    of the table is one window's; ``bucket``, a function of the time that never falls (a day,
    say), cuts each key into windows of their own, and the last right row of earlier buckets,
    one row for each key and bucket, is carried into them."""
    tag = F.lit
    a = left.select("*", *[F.lit(None).cast(right.schema[v].dataType).alias(f"_{v}") for v in values], tag(1).alias("_side"))
    b = right.select(*[F.col(c) if c in [*by, time] else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], *[F.col(v).alias(f"_{v}") for v in values], tag(0).alias("_side"))
    both = a.unionByName(b)
    keys = list(by)
    if bucket:
        both = both.withColumn("_b", bucket(F.col(time)))
        keys.append("_b")
    w = Window.partitionBy(*keys).orderBy(F.col(time), F.col("_side")).rowsBetween(Window.unboundedPreceding, 0)
    found = F.when(F.col("_side") == 0, F.struct(*[F.col(f"_{v}") for v in values]))
    out = both.withColumn("_r", F.last(found, ignorenulls=True).over(w)).where("_side = 1")
    if bucket:
        ends = both.groupBy(*keys).agg(F.max_by(found, F.when(found.isNotNull(), F.col(time))).alias("_end"))
        earlier = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.withColumn("_end", F.last("_end", ignorenulls=True).over(earlier)).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_end")
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        out = out.join(carried, same, "left").withColumn("_r", F.coalesce("_r", "_end"))
    return out.select(*left.columns, *[F.col(f"_r._{v}").alias(v) for v in values])
