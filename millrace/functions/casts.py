"""Affinity casts: the longest numeric prefix of a text, saturating; strict casts beside."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_REAL = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
_INT = r"^\s*([+-]?\d+)"
_MAX, _MIN = (1 << 63) - 1, -(1 << 63)


def to_real(x: Column) -> Column:
    """A text's numeric prefix as a real, 0.0 without one."""
    got = F.regexp_extract(x, _REAL, 1)
    return F.when(x.isNotNull(), F.coalesce(got.try_cast("double"), F.lit(0.0)))


def to_integer(x: Column, kind: str = "string") -> Column:
    """A text's integer prefix, or a real cut toward zero; both saturate at 64 bits."""
    if kind != "string":
        x = x.cast("double")
        return F.when(x >= float(_MAX), _MAX).when(x <= float(_MIN), F.lit(_MIN)).otherwise(x.try_cast("long"))
    got = F.regexp_extract(x, _INT, 1)
    wide = got.try_cast("decimal(38,0)")
    cut = F.when(wide > _MAX, F.lit(_MAX)).when(wide < _MIN, F.lit(_MIN)).otherwise(wide.try_cast("long"))
    far = F.when(F.substring(F.trim(x), 1, 1) == "-", F.lit(_MIN)).otherwise(F.lit(_MAX))
    return F.when(x.isNull(), None).when(got == "", F.lit(0)).when(wide.isNull(), far).otherwise(cut)


def to_numeric(x: Column) -> Column:
    """NUMERIC affinity of a text that is a whole number or real, else NULL: as a real."""
    return F.trim(x).try_cast("double")


def strict(x: Column, kind: str) -> Column:
    """All or nothing: text that is not wholly a value of ``kind`` raises (ANSI cast)."""
    return x.cast(kind)


def affinity(declared: str) -> str:
    """INTEGER, TEXT, BLOB, REAL or NUMERIC for a declared type name, by its substrings."""
    name = declared.upper()
    for words, result in ((("INT",), "INTEGER"), (("CHAR", "CLOB", "TEXT"), "TEXT"), (("BLOB",), "BLOB"), (("REAL", "FLOA", "DOUB"), "REAL")):
        if any(w in name for w in words):
            return result
    return "NUMERIC" if name else "BLOB"
