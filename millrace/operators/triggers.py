"""Row triggers as batch steps of one write, and their backtest.

A trigger sees the changed rows as a DataFrame with ``old`` and ``new`` structs. BEFORE
triggers may change ``new`` or raise; AFTER triggers derive rows for other tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Trigger:
    name: str
    table: str
    event: str  # insert, update or delete
    timing: str = "after"
    when: Column | None = None
    sets: dict[str, Column] | None = None
    raises: str | None = None
    into: str | None = None
    derive: Callable[[DataFrame], DataFrame] | None = None


class Triggers:
    def __init__(self) -> None:
        self.known: dict[str, Trigger] = {}

    def create(self, trigger: Trigger) -> None:
        if trigger.name in self.known:
            raise ValueError(f"trigger {trigger.name} already exists")
        self.known[trigger.name] = trigger

    def drop(self, name: str) -> None:
        del self.known[name]

    def _of(self, table: str, event: str, timing: str) -> list[Trigger]:
        return [t for t in self.known.values() if (t.table, t.event, t.timing) == (table, event, timing)]

    def fire(self, table: str, event: str, changed: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
        """(changed rows after BEFORE triggers, derived rows by table)."""
        for t in self._of(table, event, "before"):
            hit = F.lit(True) if t.when is None else F.coalesce(t.when, F.lit(False))
            if t.raises:
                changed = changed.where(F.when(hit, F.raise_error(F.lit(t.raises)).cast("boolean")).otherwise(True))
            for name, value in (t.sets or {}).items():
                kind = next(f.dataType for f in changed.schema["new"].dataType if f.name == name)
                changed = changed.withColumn("new", F.col("new").withField(name, F.when(hit, value).otherwise(F.col(f"new.{name}")).cast(kind)))
        out: dict[str, DataFrame] = {}
        for t in self._of(table, event, "after"):
            rows = t.derive(changed if t.when is None else changed.where(t.when))
            out[t.into] = out[t.into].unionByName(rows) if t.into in out else rows
        return changed, out

    def backtest(self, name: str, table: DataFrame) -> DataFrame:
        """How often a trigger would have fired on the rows there are, with no effect."""
        t = self.known[name]
        side = "old" if t.event == "delete" else "new"
        rows = table.select(F.struct(*table.columns).alias(side), F.struct(*table.columns).alias("old" if side == "new" else "new"))
        hit = F.lit(True) if t.when is None else F.coalesce(t.when, F.lit(False))
        return rows.agg(F.count("*").alias("rows"), F.count(F.when(hit, 1)).alias("fires"))
