"""Lenses: column transforms that can be taken back.

A *bijective* lens has an inverse; a *residual* lens keeps what its forward direction loses
in a side table; a *lossy* one has no way back.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Lens:
    name: str
    forward: Callable[[Column], Column]
    inverse: Callable[[Column], Column] | None = None
    residual: Callable[[Column], Column] | None = None
    restore: Callable[[Column, Column], Column] | None = None

    @property
    def kind(self) -> str:
        return "bijective" if self.inverse else "residual" if self.residual and self.restore else "lossy"

    def back(self, value: Column, residue: Column | None = None) -> Column:
        if self.inverse:
            return self.inverse(value)
        if self.kind == "residual":
            return self.restore(value, residue)
        raise ValueError(f"lens {self.name} is lossy")


@dataclass
class Applied:
    table: DataFrame
    residuals: DataFrame | None


def verify(lens: Lens, probes: DataFrame, column: str) -> DataFrame:
    """Probes that do not come back as they were."""
    x = F.col(column)
    back = lens.back(lens.forward(x), lens.residual(x) if lens.residual else None)
    return probes.where(~back.eqNullSafe(x))


def apply(lens: Lens, df: DataFrame, column: str, key: list[str]) -> Applied:
    x = F.col(column)
    rest = df.select(*key, lens.residual(x).alias("residue")) if lens.kind == "residual" else None
    return Applied(df.withColumn(column, lens.forward(x)), rest)


def revert(lens: Lens, applied: Applied, column: str, key: list[str]) -> DataFrame:
    """The original content; putback of edited values works the same way."""
    df = applied.table
    if applied.residuals is None:
        return df.withColumn(column, lens.back(F.col(column)))
    joined = df.join(applied.residuals, key, "left")
    return joined.withColumn(column, lens.back(F.col(column), F.col("residue"))).select(*df.columns)


def putback(lens: Lens, applied: Applied, edited: DataFrame, column: str, key: list[str]) -> Applied:
    """``applied`` after some of its values were edited ((key, column) rows): an edited value
    takes the row, and its residue is made anew from what the value goes back to, so that
    ``revert`` gives the edit. Keys that are not there are refused."""
    stray = edited.select(*key).join(applied.table.select(*key), key, "left_anti")
    if not stray.isEmpty():
        raise ValueError("an edited key is not in the table")
    new = edited.select(*key, F.col(column).alias("_new"), F.lit(True).alias("_hit"))
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    table = applied.table.join(new, key, "left").withColumn(column, F.when(hit, F.col("_new")).otherwise(F.col(column))).select(*applied.table.columns)
    if applied.residuals is None:
        lens.back(F.col(column))  # a lossy lens has no way back
        return Applied(table, None)
    kept = applied.residuals.join(new, key, "left")
    back = lens.back(F.col("_new"), F.col("residue"))
    kept = kept.withColumn("residue", F.when(hit, lens.residual(back)).otherwise(F.col("residue"))).select(*applied.residuals.columns)
    return Applied(table, kept)


#: The ledger of a table's lenses, oldest first.
LEDGER = "seq long, lens string, kind string, column string, action string, rows long, content string"


def log(ledger: DataFrame, lens: Lens, applied: Applied, column: str, action: str = "apply") -> DataFrame:
    """The ledger with one entry more: what was done, on how many rows, and a hash of the
    content it left, in no order of rows."""
    content = F.sum(F.xxhash64(*applied.table.columns).cast("decimal(38,0)")).cast("string")
    made = applied.table.agg(F.count("*").alias("rows"), F.coalesce(content, F.lit("0")).alias("content"))
    top = ledger.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("_top"))
    entry = made.crossJoin(top).select((F.col("_top") + 1).alias("seq"), F.lit(lens.name).alias("lens"), F.lit(lens.kind).alias("kind"), F.lit(column).alias("column"), F.lit(action).alias("action"), "rows", "content")
    return ledger.unionByName(entry)


def untouched(ledger: DataFrame, applied: Applied) -> bool:
    """Whether the table is what the ledger's last entry left."""
    last = ledger.orderBy(F.desc("seq")).first()
    now = applied.table.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*applied.table.columns).cast("decimal(38,0)")).cast("string"), F.lit("0")).alias("c")).first()
    return last is not None and (last["rows"], last["content"]) == (now["n"], now["c"])


def fsck(applied: Applied, key: list[str]) -> DataFrame:
    """Rows without their residue, and residues without a row."""
    if applied.residuals is None:
        return applied.table.select(*key).limit(0).withColumn("fault", F.lit(""))
    missing = applied.table.select(*key).join(applied.residuals, key, "left_anti").withColumn("fault", F.lit("no residue"))
    stray = applied.residuals.select(*key).join(applied.table.select(*key), key, "left_anti").withColumn("fault", F.lit("no row"))
    return missing.unionByName(stray)


#: Ready-made lenses.
REVERSE = Lens("reverse", F.reverse, F.reverse)
CENTS = Lens("cents", lambda x: F.round(x * 100).cast("long"), residual=lambda x: x, restore=lambda v, r: F.when(F.round(r * 100).cast("long").eqNullSafe(v), r).otherwise(v / F.lit(100.0)))
LOWER = Lens("lower", F.lower, residual=lambda x: x, restore=lambda v, r: F.when(F.lower(r).eqNullSafe(v), r).otherwise(v))
FIRST_WORD = Lens("first word", lambda x: F.split_part(x, F.lit(" "), F.lit(1)))
