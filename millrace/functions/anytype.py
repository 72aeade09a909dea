"""Columns whose values carry their own class: a struct (i, f, s, b) with one field set.

NULL is the null struct. Ordering ranks NULL < numbers < text < blob; integers and reals are
compared exactly, and 1 and 1.0 are one group. Comparison across classes is NULL, as the
rigid semantics has it; ``order_key`` is for sorting and grouping.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPE = "struct<i:bigint,f:double,s:string,b:binary>"
_FIELDS = {"i": "bigint", "f": "double", "s": "string", "b": "binary"}


def pack(x: Column, kind: str) -> Column:
    """A column of the static Spark type ``kind`` as an any-typed one."""
    at = "i" if kind in ("bigint", "int", "smallint", "tinyint", "boolean") else "f" if kind in ("double", "float") else "b" if kind == "binary" else "s"
    made = F.struct(*[(x.cast(t) if n == at else F.lit(None).cast(t)).alias(n) for n, t in _FIELDS.items()])
    return F.when(x.isNotNull(), made)


def typeof(x: Column) -> Column:
    return F.when(x.isNull(), "null").when(x["i"].isNotNull(), "integer").when(x["f"].isNotNull(), "real").when(x["s"].isNotNull(), "text").otherwise("blob")


def order_key(x: Column) -> Column:
    """Sorts and groups as values do. A number is its double and what an integer lost in
    becoming one, so neighbours above 2^53 stay apart."""
    real = F.coalesce(x["f"], x["i"].cast("double"))
    rest = F.when(x["i"].isNotNull(), x["i"].cast("decimal(38,0)") - real.cast("decimal(38,0)")).otherwise(F.lit(0).cast("decimal(38,0)"))
    rank = F.when(x["s"].isNotNull(), 2).when(x["b"].isNotNull(), 3).otherwise(1)
    key = F.struct(rank.alias("rank"), real.alias("real"), F.when(rank == 1, rest).cast("decimal(38,0)").alias("rest"), x["s"].alias("s"), x["b"].alias("b"))
    return F.when(x.isNotNull(), key)


def _class(x: Column) -> Column:
    return F.when(x["s"].isNotNull(), 2).when(x["b"].isNotNull(), 3).otherwise(1)


def equals(a: Column, b: Column) -> Column:
    return F.when(_class(a) == _class(b), order_key(a) == order_key(b)).otherwise(F.lit(None).cast("boolean"))


def less(a: Column, b: Column) -> Column:
    return F.when(_class(a) == _class(b), order_key(a) < order_key(b)).otherwise(F.lit(None).cast("boolean"))


def to_text(x: Column) -> Column:
    return F.coalesce(x["s"], x["i"].cast("string"), x["f"].cast("string"), x["b"].cast("string"))
