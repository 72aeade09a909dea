"""Changes of a table as new snapshots: every function takes DataFrames and returns the next.

Keys are compared with equi-joins, so a change costs one shuffle of the table at most;
Spark broadcasts a small change by itself. ``affected`` rows (RETURNING) come with each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Change:
    table: DataFrame
    affected: DataFrame


ORDINAL = "_ordinal"


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with their order as proposed, fixed by writing them once."""
    from .recursion import written

    return written(rows.withColumn(ORDINAL, F.monotonically_increasing_id()), "rows")


def with_defaults(df: DataFrame, rows: DataFrame, defaults: dict[str, Column] | None = None, autofill: str | None = None) -> DataFrame:
    """``rows`` with the columns of ``df`` (and their ordinal, if they have one): absent ones
    take their default, and a NULL or absent integer key continues from the greatest one, in
    no stated order. The numbering counts rows by partition first and never gathers them in
    one task."""
    defaults = defaults or {}
    more = [ORDINAL] if ORDINAL in rows.columns else []
    out = rows.select(*[F.col(c) if c in rows.columns else defaults.get(c, F.lit(None)).cast(df.schema[c].dataType).alias(c) for c in df.columns], *more)
    if autofill is None:
        return out
    from .recursion import written

    open_ = written(out.where(F.col(autofill).isNull()).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()), "rows")
    counts = open_.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    given = out.where(F.col(autofill).isNotNull())
    top = df.select(autofill).unionAll(given.select(autofill)).agg(F.coalesce(F.max(autofill), F.lit(0)).alias("_top"))
    numbered_ = open_.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy("_m"))).join(counts, "_p").crossJoin(top)
    return given.unionByName(numbered_.withColumn(autofill, (F.col("_top") + F.col("_before") + F.col("_r")).cast(df.schema[autofill].dataType)).select(*df.columns, *more))


def _without(rows: DataFrame, others: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key none of the others has; a NULL in it never clashes."""
    return rows.join(others.select(*key), key, "left_anti").select(*rows.columns)


def _firsts(rows: DataFrame, keys: list[list[str]]) -> DataFrame:
    """Proposals kept one after another: each that clashes, on any key, with none kept before.
    One pass where there is one key; else a pass keeps all that are first for each of their
    keys, and the rest are held against those."""
    from .recursion import written

    out = None
    while True:
        first = F.lit(True)
        for key in keys:
            known = F.lit(True)
            for c in key:
                known = known & F.col(c).isNotNull()
            first = first & (~known | (F.col(ORDINAL) == F.min(ORDINAL).over(Window.partitionBy(*key))))
        marked = rows.withColumn("_first", first)
        kept = marked.where("_first").drop("_first")
        if len(keys) == 1:
            return kept
        marked = written(marked, "proposals")
        kept, rows = marked.where("_first").drop("_first"), marked.where("not _first").drop("_first")
        out = kept if out is None else out.unionByName(kept)
        for key in keys:
            rows = _without(rows, kept, key)
        if rows.isEmpty():
            return out


def insert(df: DataFrame, rows: DataFrame, key: list[str] | None = None, on_conflict: str = "abort", defaults: dict[str, Column] | None = None, autofill: str | None = None, order: list[Column] | None = None, unique: list[list[str]] | None = None) -> Change:
    """INSERT [OR ABORT | IGNORE | REPLACE], on the key and on all of ``unique``. Rows count in
    ``order`` (as proposed, without one): ignore skips a row that clashes with one there or
    kept before; replace takes away all that a row clashes with, so the last stays; abort
    raises when an action runs."""
    keys = [k for k in (key, *(unique or [])) if k]
    if not keys:
        new = with_defaults(df, rows, defaults, autofill)
        return Change(df.unionByName(new.select(*df.columns)), new.select(*df.columns))
    if on_conflict == "abort":
        new = with_defaults(df, rows, defaults, autofill).select(*df.columns)
        checked = new
        for k in keys:
            known = F.lit(True)
            for c in k:
                known = known & F.col(c).isNotNull()
            seen = df.select(*k).unionAll(new.select(*k)).where(known).groupBy(*k).count().where("count > 1")
            bad = seen.agg(F.count("*").alias("_clashes"))
            checked = checked.crossJoin(F.broadcast(bad)).where(F.when(F.col("_clashes") > 0, F.raise_error(F.lit("UNIQUE constraint failed")).cast("boolean")).otherwise(True)).drop("_clashes")
        return Change(df.unionByName(checked), checked)
    if on_conflict not in ("ignore", "replace"):
        raise ValueError(f"OR {on_conflict}?")
    if ORDINAL not in rows.columns:
        # ties in the given order keep the order of the rows
        rows = numbered(rows if order is None else rows.orderBy(*order))
    new = with_defaults(df, rows, defaults, autofill)
    if autofill:
        from .recursion import written

        new = written(new, "rows")
    if on_conflict == "replace":
        last, left = F.lit(True), df
        for k in keys:
            known = F.lit(True)
            for c in k:
                known = known & F.col(c).isNotNull()
            last = last & (~known | (F.col(ORDINAL) == F.max(ORDINAL).over(Window.partitionBy(*k))))
            left = _without(left, new, k)
        kept = new.withColumn("_last", last).where("_last").select(*df.columns)
        return Change(left.unionByName(kept), kept)
    for k in keys:
        new = _without(new, df, k)
    added = _firsts(new, keys).select(*df.columns)
    return Change(df.unionByName(added), added)


def upsert(df: DataFrame, rows: DataFrame, key: list[str], update: dict[str, Column], where: Column | None = None, repeats: bool = False) -> Change:
    """ON CONFLICT (key) DO UPDATE SET ... [WHERE ...]: expressions may use ``t.col`` (the row
    there) and ``excluded.col`` (the proposed one). Proposals of one key take effect one after
    another, in order: with ``repeats`` they are numbered by key and applied a number at a
    time, so there is a pass for every repetition; without it they must be unique."""
    if not repeats:
        return _upsert_once(df, rows, key, update, where)
    from .recursion import written

    if ORDINAL not in rows.columns:
        rows = numbered(rows)
    known = F.lit(True)
    for c in key:
        known = known & F.col(c).isNotNull()
    turn = F.when(known, F.row_number().over(Window.partitionBy(*key).orderBy(ORDINAL))).otherwise(1)
    rows = written(rows.withColumn("_turn", turn), "proposals")
    out, did = df, None
    for i in range(1, (rows.agg(F.max("_turn")).first()[0] or 0) + 1):
        change = _upsert_once(out, rows.where(F.col("_turn") == i).select(*df.columns), key, update, where)
        out = written(change.table, "upserted")
        affected = written(change.affected, "affected")
        did = affected if did is None else _without(did, affected, key).unionByName(affected)
    return Change(out, did if did is not None else df.limit(0))


def _upsert_once(df: DataFrame, rows: DataFrame, key: list[str], update: dict[str, Column], where: Column | None) -> Change:
    flag = rows.withColumn("_new", F.lit(True)).alias("excluded")
    old = df.withColumn("_old", F.lit(True)).alias("t")
    on = F.lit(True)
    for k in key:
        on = on & (F.col(f"t.{k}") == F.col(f"excluded.{k}"))
    both = old.join(flag, on, "full")
    hit = F.col("_old").isNotNull() & F.col("_new").isNotNull()
    if where is not None:
        hit = hit & F.coalesce(where, F.lit(False))
    cols = [F.when(F.col("_old").isNull(), F.col(f"excluded.{c}")).when(hit, update[c] if c in update else F.col(f"t.{c}")).otherwise(F.col(f"t.{c}")).cast(df.schema[c].dataType).alias(c) for c in df.columns]
    made = both.select(*cols, (hit | F.col("_old").isNull()).alias("_did"))
    return Change(made.drop("_did"), made.where("_did").drop("_did"))


def update(df: DataFrame, sets: list[tuple[str, Column]], where: Column | None = None) -> Change:
    """SET sees the old row; of two settings of one column the last wins."""
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    final = dict(sets)
    cols = [F.when(hit, final[c]).otherwise(F.col(c)).cast(df.schema[c].dataType).alias(c) if c in final else F.col(c) for c in df.columns]
    after = df.select(*cols, hit.alias("_did"))
    return Change(after.drop("_did"), after.where("_did").drop("_did"))


def delete(df: DataFrame, where: Column | None = None) -> Change:
    """Rows for which the condition is NULL stay."""
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    return Change(df.where(~hit), df.where(hit))
