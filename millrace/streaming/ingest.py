"""Receipts of a source table: classify what is new, changed, unchanged, deleted, in conflict.

A *dump* shows the whole table, so keys it never shows are deleted when it closes. A *delta*
shows changed rows only and moves a cursor. Both are one full or left join on the key with
a null-safe comparison of the rest; counts are one aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INSERT, UPDATE, DELETE, SAME, CONFLICT = "insert", "update", "delete", "unchanged", "conflict"


@dataclass
class Receipt:
    """``changes`` has the key, ``op`` and the new values as ``new``; ``table`` is the result."""

    table: DataFrame
    changes: DataFrame
    conflicts: DataFrame

    def counts(self) -> DataFrame:
        return self.changes.groupBy("op").agg(F.count("*").alias("n"))


def _checked(target: DataFrame, rows: DataFrame, key: list[str]) -> list[str]:
    unknown = [c for c in rows.columns if c not in target.columns]
    missing = [k for k in key if k not in rows.columns]
    if unknown or missing:
        raise ValueError(f"unknown columns {unknown}, missing key columns {missing}")
    return [c for c in target.columns if c not in key and c in rows.columns]


def receive(target: DataFrame, rows: DataFrame, key: list[str], dump: bool, policy: str = "source", edited: DataFrame | None = None) -> Receipt:
    """Apply one receipt. ``edited`` lists keys changed locally since the last one: where the
    source changes or deletes such a row, it is a conflict, recorded, and ``policy`` says who
    wins (``source`` or ``local``). Columns the rows lack keep their values; a key shown
    several times counts once, by its last row in column order.
    """
    if policy not in ("source", "local"):
        raise ValueError(f"policy {policy}?")
    values = _checked(target, rows, key)
    one = rows.groupBy(*key).agg(F.max(F.struct(*values)).alias("new")) if values else rows.select(*key).distinct().withColumn("new", F.struct(F.lit(1).alias("_")))
    old = target.select(*key, F.struct(*values).alias("old") if values else F.struct(F.lit(1).alias("_")).alias("old"), F.struct(*target.columns).alias("row"))
    both = old.join(one, key, "full" if dump else "right")
    if edited is not None:
        both = both.join(edited.select(*key, F.lit(True).alias("mine")).distinct(), key, "left")
    else:
        both = both.withColumn("mine", F.lit(None).cast("boolean"))
    op = F.when(F.col("row").isNull(), INSERT).when(F.col("new").isNull(), DELETE).when(F.col("old").eqNullSafe(F.col("new")), SAME).otherwise(UPDATE)
    both = both.withColumn("op", op)
    clash = F.coalesce(F.col("mine"), F.lit(False)) & F.col("op").isin(UPDATE, DELETE)
    both = both.withColumn("clash", clash)
    keep_old = F.col("clash") if policy == "local" else F.lit(False)
    final = [F.when(keep_old | F.col("new").isNull(), F.col(f"row.{c}")).otherwise(F.col(f"new.{c}")).alias(c) if c in values else F.col(c) if c in key else F.col(f"row.{c}").alias(c) for c in target.columns]
    stays = (F.col("op") != DELETE) | keep_old
    seen = both.where(stays).select(*final)
    table = seen if dump else target.join(one.select(*key), key, "left_anti").select(*target.columns).unionByName(seen)
    changes = both.select(*key, F.when(F.col("clash"), CONFLICT).otherwise(F.col("op")).alias("op"), "new")
    conflicts = both.where("clash").select(*key, "op", "old", "new")
    return Receipt(table, changes, conflicts)


def sweep(target: DataFrame, presented: DataFrame, key: list[str]) -> DataFrame:
    """Keys that a dump never presented."""
    return target.select(*key).join(presented.select(*key), key, "left_anti")


def next_cursor(rows: DataFrame, column: str, current=None):
    """The greatest cursor value seen, never less than the current one."""
    top = rows.agg(F.max(column)).first()[0]
    return current if top is None else top if current is None else max(top, current)


def judge_cursor(changes: DataFrame, rows: DataFrame, key: list[str], column: str, watermark) -> DataFrame | None:
    """How a dump judges the delta edge's cursor: of the changed rows, those whose cursor passed
    the watermark are caught, the others missed. None while there is no watermark."""
    if watermark is None:
        return None
    moved = rows.join(changes.where(F.col("op").isin(INSERT, UPDATE)).select(*key), key, "left_semi")
    hit = F.coalesce(F.col(column) > F.lit(watermark), F.lit(False))
    return moved.agg(F.count(F.when(hit, 1)).alias("caught"), F.count(F.when(~hit, 1)).alias("missed"))


def derived_calls(changes: DataFrame, key: list[str], done: DataFrame | None = None) -> DataFrame:
    """Keys of a receipt as child calls, each once, without those already made."""
    calls = changes.where(F.col("op") != SAME).select(*key).distinct()
    return calls if done is None else calls.join(done.select(*key), key, "left_anti")


def plan_budget(edges: list[dict], calls: int, size: int, seconds: float) -> list[dict]:
    """Share a budget over edges: by value for cost, most valuable first. An edge needs
    ``name``, ``calls``, ``bytes``, ``seconds`` and ``value`` (for one run)."""
    out = []
    for e in sorted(edges, key=lambda e: (-e["value"] / max(e["seconds"], 1e-9), e["name"])):
        runs = min(calls // max(e["calls"], 1), size // max(e["bytes"], 1), int(seconds // max(e["seconds"], 1e-9)), 1)
        if runs:
            calls, size, seconds = calls - e["calls"], size - e["bytes"], seconds - e["seconds"]
            out.append(e)
    return out
