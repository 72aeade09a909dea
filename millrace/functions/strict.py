"""The strict dialect: domain errors and zero divisors raise, casts are all or nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _must(test: Column, value: Column, message: str) -> Column:
    return F.when(test, value).when(test.isNull(), None).otherwise(F.raise_error(F.lit(message)).cast("double"))


def sqrt(x: Column) -> Column:
    return _must(x >= 0, F.sqrt(x), "cannot take the square root of a negative number")


def ln(x: Column) -> Column:
    return _must(x > 0, F.log(x), "cannot take the logarithm of zero or a negative number")


def log10(x: Column) -> Column:
    return _must(x > 0, F.log10(x), "cannot take the logarithm of zero or a negative number")


def power(x: Column, y: Column) -> Column:
    return _must(~F.isnan(F.pow(x, y)), F.pow(x, y), "a negative number raised to a non-integer power")


def asin(x: Column) -> Column:
    return _must(F.abs(x) <= 1, F.asin(x), "input is out of range")


def acos(x: Column) -> Column:
    return _must(F.abs(x) <= 1, F.acos(x), "input is out of range")


def like(x: Column, pattern: str, escape: str = "\\") -> Column:
    """Case-sensitive, with the backslash as the usual escape."""
    from .predicates import like as loose

    return loose(x, pattern, escape, case=True)


def regex(x: Column, pattern: str, negate: bool = False, fold: bool = False) -> Column:
    """``~``, ``!~``, ``~*``, ``!~*``."""
    found = x.rlike(("(?si)" if fold else "(?s)") + pattern)
    return ~found if negate else found


def format_type(kind: str) -> str:
    """The catalogue's name of a Spark type."""
    names = {"bigint": "bigint", "int": "integer", "double": "double precision", "boolean": "boolean", "string": "text", "binary": "bytea", "timestamp": "timestamp with time zone", "date": "date"}
    return names.get(kind, f"numeric{kind[7:]}" if kind.startswith("decimal") else kind)


char_length = character_length = F.char_length


def strpos(text: Column, part: Column) -> Column:
    from .strings import instr

    return instr(text, part)


def position(part: Column, text: Column) -> Column:
    return strpos(text, part)
