"""Predicates: LIKE, GLOB, REGEXP, IN, row values, null-safe and quantified comparisons."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import nocase


def _like_regex(pattern: str, escape: str | None) -> str:
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if escape and c == escape:
            i += 1
            if i == len(pattern):
                return r"(?!)"
            out.append(re.escape(pattern[i]))
        else:
            out.append({"%": ".*", "_": "."}.get(c) or re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + r"\z"


def like(x: Column, pattern: str, escape: str | None = None, case: bool = False) -> Column:
    """ASCII case-insensitive unless ``case``. Without ESCAPE there is no escape character
    (Spark's own LIKE would take the backslash for one)."""
    return x.rlike(_like_regex(pattern, escape)) if case else nocase(x).rlike(_like_regex(pattern.translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})), escape))


def glob_regex(pattern: str) -> str:
    """GLOB as a regular expression: * ? [..] [^..]; a ] right after [ is itself a member."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            j = i + 1 + (pattern[i + 1 : i + 2] == "^")
            end = pattern.find("]", j + 1 if pattern[j : j + 1] == "]" else j)
            if end < 0:
                return r"(?!)"
            body = re.sub(r"([\\\[\]&^])", r"\\\1", pattern[j:end])
            out.append(f"[{'^' if j > i + 1 else ''}{body}]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + r"\z"


def glob(x: Column, pattern: str) -> Column:
    return x.rlike(glob_regex(pattern))


def regexp(x: Column, pattern: str) -> Column:
    """Unanchored; the dot matches line ends."""
    return x.rlike("(?s)" + pattern)


def distinct_from(a: Column, b: Column) -> Column:
    """IS DISTINCT FROM: two-valued."""
    return ~a.eqNullSafe(b)


def in_list(x: Column, values: list) -> Column:
    """Three-valued; the empty list is FALSE even for NULL."""
    return x.isin(*values) if values else F.lit(False)


def not_in_list(x: Column, values: list) -> Column:
    """Three-valued: NULL among the values leaves no row TRUE."""
    if not values:
        return F.lit(True)
    plain = [v for v in values if v is not None]
    found = x.isin(*plain) if plain else F.lit(False)
    return F.when(found, False).when(x.isNull() | F.lit(len(plain) < len(values)), F.lit(None).cast("boolean")).otherwise(True)


def row_eq(a: list[Column], b: list[Column]) -> Column:
    """(a1, a2) = (b1, b2) by three-valued AND; Spark's struct equality is two-valued."""
    out = a[0] == b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out & (x == y)
    return out


def row_lt(a: list[Column], b: list[Column], or_equal: bool = False) -> Column:
    """Lexicographic, three-valued."""
    if len(a) == 1:
        return a[0] <= b[0] if or_equal else a[0] < b[0]
    return (a[0] < b[0]) | ((a[0] == b[0]) & row_lt(a[1:], b[1:], or_equal))


def between(x: Column, lo: Column, hi: Column) -> Column:
    return (x >= lo) & (x <= hi)
