"""Change capture: the last operation of each key, applied in batches or as a stream."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dirty_set(changes: DataFrame, key: list[str], version: str) -> DataFrame:
    """The last change of each key: an aggregate, so hot keys combine map-side."""
    rest = [c for c in changes.columns if c not in key and c != version]
    return changes.groupBy(*key).agg(F.max(version).alias(version), F.max_by(F.struct(*rest), version).alias("_r")).select(*key, version, *[F.col(f"_r.{c}").alias(c) for c in rest])


def apply(target: DataFrame, changes: DataFrame, key: list[str], version: str, op: str = "op") -> DataFrame:
    """Upserts and deletes of a change feed, last one by ``version``."""
    last = dirty_set(changes, key, version)
    live = last.where(F.col(op) != "delete").select(*target.columns)
    return target.join(last.select(*key), key, "left_anti").select(*target.columns).unionByName(live)


def apply_parking(target: DataFrame, changes: DataFrame, key: list[str], version: str, op: str = "op") -> tuple[DataFrame, DataFrame]:
    """(target, parked): changes that do not fit the target are set aside instead of applied,
    with a ``reason``: an insert of a key that is there, an update or delete of one that is
    not, an unknown operation or a null key. Of a key's changes the last counts; an insert
    followed by an update is an insert."""
    first = changes.groupBy(*key).agg(F.min_by(op, version).alias("_first"))
    null = F.lit(False)
    for c in key:
        null = null | F.col(c).isNull()
    last = dirty_set(changes.where(~null), key, version).join(first, key)
    last = last.join(target.select(*key, F.lit(True).alias("_there")), key, "left")
    there = F.coalesce(F.col("_there"), F.lit(False))
    reason = F.when(~F.col("_first").isin("insert", "update", "delete"), "unknown operation").when((F.col("_first") == "insert") & there, "key exists").when((F.col("_first") != "insert") & ~there, "no such key")
    marked = last.withColumn("reason", reason)
    cols = [c for c in changes.columns]
    fit = marked.where(F.col("reason").isNull()).select(*cols)
    out = apply(target, fit, key, version, op)
    parked = marked.where(F.col("reason").isNotNull()).select(*cols, "reason").unionByName(changes.where(null).select(*cols, F.lit("null key").alias("reason")))
    return out, parked


@dataclass
class Cursor:
    """A place in a change feed, as plain values that can be kept anywhere."""

    column: str
    value: object = None

    def after(self, feed: DataFrame) -> DataFrame:
        return feed if self.value is None else feed.where(F.col(self.column) > F.lit(self.value))

    def moved(self, taken: DataFrame) -> Cursor:
        """The cursor behind what was taken; it never goes back."""
        top = taken.agg(F.max(self.column)).first()[0]
        return self if top is None or (self.value is not None and top <= self.value) else Cursor(self.column, top)


def changes_between(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """(key, op) of two snapshots: what a listener would have been told."""
    row = lambda d, n: d.select(*key, F.struct(*[c for c in d.columns if c not in key]).alias(n))
    both = row(old, "a").join(row(new, "b"), key, "full")
    op = F.when(F.col("a").isNull(), "insert").when(F.col("b").isNull(), "delete").when(~F.col("a").eqNullSafe(F.col("b")), "update")
    return both.withColumn("op", op).where(F.col("op").isNotNull()).select(*key, "op")


def listen(stream: DataFrame, key_filter, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Run ``handle`` on each micro-batch of a change feed; the checkpoint folder is the
    resumable cursor. Processes what is there and stops."""
    rows = stream if key_filter is None else stream.where(key_filter)
    return rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counter(changes: DataFrame, key: list[str]) -> DataFrame:
    """The derived counter structure: rows of each key, from inserts and deletes."""
    delta = F.sum(F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).otherwise(0))
    return changes.groupBy(*key).agg(delta.alias("n"))
