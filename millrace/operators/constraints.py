"""Constraints as queries: each check returns the rows that break it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .recursion import fixpoint


def not_null(df: DataFrame, *columns: str) -> DataFrame:
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull()
    return df.where(bad)


def unique(df: DataFrame, columns: list[str], where: Column | None = None) -> DataFrame:
    """Keys held more than once, with ``n``; keys with a NULL never clash. ``where`` makes the
    uniqueness partial."""
    rows = df if where is None else df.where(where)
    for c in columns:
        rows = rows.where(F.col(c).isNotNull())
    return rows.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def check(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is FALSE; NULL passes."""
    return df.where(~F.coalesce(condition, F.lit(True)))


def foreign_key(child: DataFrame, columns: list[str], parent: DataFrame, parent_columns: list[str]) -> DataFrame:
    """Child rows without a parent; a NULL in the key passes."""
    rows = child
    for c in columns:
        rows = rows.where(F.col(c).isNotNull())
    keys = parent.select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(parent_columns)])
    on = F.lit(True)
    for i, c in enumerate(columns):
        on = on & (F.col(c) == F.col(f"_p{i}"))
    return rows.join(keys, on, "left_anti")


@dataclass
class ForeignKey:
    """Columns are a name, or a list of names for a composite key."""

    child: str
    column: str | list[str]
    parent: str
    parent_column: str | list[str]
    action: str = "restrict"  # restrict, cascade, set null

    @property
    def columns(self) -> list[str]:
        return [self.column] if isinstance(self.column, str) else list(self.column)

    @property
    def parent_columns(self) -> list[str]:
        return [self.parent_column] if isinstance(self.parent_column, str) else list(self.parent_column)

    def of(self, child: DataFrame, parents: DataFrame, how: str) -> DataFrame:
        """Child rows joined with the keys of some parents, which come as ``_p0``, ``_p1``..."""
        keys = parents.select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(self.parent_columns)]).distinct()
        on = F.lit(True)
        for i, c in enumerate(self.columns):
            on = on & (F.col(c) == F.col(f"_p{i}"))
        return child.join(keys, on, how)


@dataclass
class Cascade:
    tables: dict[str, DataFrame]
    deleted: dict[str, DataFrame] = field(default_factory=dict)


def delete_cascade(tables: dict[str, DataFrame], keys: list[ForeignKey], start: str, doomed: DataFrame, depth: int = 64) -> Cascade:
    """Delete ``doomed`` rows of a table with what depends on them. RESTRICT raises when an
    action runs; a self reference is followed to its fixpoint."""
    out = Cascade(dict(tables))

    def go(name: str, rows: DataFrame, level: int) -> None:
        if level > depth:
            raise RuntimeError("foreign keys are nested too deeply")
        for k in [k for k in keys if k.parent == name and k.child == name and k.action == "cascade"]:
            rows = fixpoint(rows, lambda new, k=k: k.of(out.tables[name], new, "left_semi"))
        own_key = next((k for k in keys if k.parent == name), None)
        out.deleted[name] = rows
        own = out.tables[name]
        if own_key:
            same = ForeignKey(name, own_key.parent_columns, name, own_key.parent_columns)
            out.tables[name] = same.of(own, rows, "left_anti")
        else:
            mark = rows.select(F.struct(*rows.columns).alias("_row")).distinct()
            out.tables[name] = own.join(mark, F.struct(*own.columns).eqNullSafe(F.col("_row")), "left_anti")
        for k in [k for k in keys if k.parent == name and k.child != name]:
            child = out.tables[k.child]
            hit = k.of(child, rows, "left_semi")
            if k.action == "cascade":
                go(k.child, hit, level + 1)
            elif k.action == "set null":
                marked = k.of(child, rows, "left")
                kept = [F.when(F.col("_p0").isNull(), F.col(c)).alias(c) if c in k.columns else F.col(c) for c in child.columns]
                out.tables[k.child] = marked.select(*kept)
            elif not hit.isEmpty():
                raise ValueError(f"FOREIGN KEY constraint failed: {k.child}.{', '.join(k.columns)}")

    go(start, doomed, 0)
    return out


def generated(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Generated columns, in order: later ones may use earlier ones."""
    for name, c in columns.items():
        df = df.withColumn(name, c)
    return df
