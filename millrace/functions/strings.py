"""String functions with embedded-SQL semantics, as Column builders.

Every function returns NULL on any NULL argument unless its docstring says otherwise. All
are built-in expressions: nothing here leaves the JVM.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
_SPACE = r"\p{IsWhite_Space}"


def col(x) -> Column:
    """A Column as it is, a str as a column name, anything else as a literal."""
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def nocase(x: Column) -> Column:
    """The key of the NOCASE collation: only A-Z fold (``UTF8_LCASE`` would fold É too)."""
    return F.translate(x, UPPER, LOWER)


def rtrim_key(x: Column) -> Column:
    """The key of the RTRIM collation: trailing spaces do not count."""
    return F.regexp_replace(x, " +$", "")


def length(x: Column) -> Column:
    return F.char_length(x)


def trim(x: Column, chars: Column | None = None) -> Column:
    return rtrim(ltrim(x, chars), chars)


def ltrim(x: Column, chars: Column | None = None) -> Column:
    return F.regexp_replace(x, f"^{_SPACE}+", "") if chars is None else F.ltrim(x, chars)


def rtrim(x: Column, chars: Column | None = None) -> Column:
    return F.regexp_replace(x, f"{_SPACE}+$", "") if chars is None else F.rtrim(x, chars)


def substr(x: Column, start: Column, size: Column | None = None) -> Column:
    """1-based; a negative start counts from the end, a negative size goes to the left, and
    what lies before the first character is clipped from the window."""
    start = start.cast("long")
    n = F.char_length(x).cast("long")
    size = n + F.abs(start) + 1 if size is None else size.cast("long")
    begin = F.when(start < 0, start + n).when(start > 0, start - 1).otherwise(F.lit(0))
    count = F.when((start < 0) & (begin < 0), F.when(size < 0, 0).otherwise(size + begin)).when((start == 0) & (size > 0), size - 1).otherwise(size)
    begin = F.greatest(begin, F.lit(0))
    back = F.when(count < -begin, begin).otherwise(-count)
    at, take = F.when(count < 0, begin - back).otherwise(begin), F.when(count < 0, back).otherwise(count)
    # a left-going window can pull in nothing before the first character
    take = F.least(F.greatest(take, F.lit(0)), F.greatest(n - at, F.lit(0)))
    known = x.isNotNull() & start.isNotNull() & size.isNotNull()
    return F.when(known, F.substring(x, (at + 1).cast("int"), take.cast("int")))


def replace(x: Column, needle: Column, by: Column) -> Column:
    return F.when(needle == "", F.when(by.isNotNull(), x)).otherwise(F.replace(x, needle, by))


def instr(hay: Column, needle: Column) -> Column:
    return F.when(needle == "", F.when(hay.isNotNull(), 1)).otherwise(F.position(needle, hay))


def char(*points: Column) -> Column:
    """The characters of some code points; what is none becomes U+FFFD."""

    def one(p: Column) -> Column:
        bad = (p < 0) | (p > 0x10FFFF) | ((p >= 0xD800) & (p <= 0xDFFF))
        return F.decode(F.unhex(F.lpad(F.hex(F.when(bad, 0xFFFD).otherwise(p).cast("long")), 8, "0")), "UTF-32")

    return F.concat(*[one(p) for p in points]) if points else F.lit("")


def unicode(x: Column) -> Column:
    return F.ascii(F.nullif(x, F.lit("")))


def hex_(x: Column) -> Column:
    return F.hex(x)


def quote(x: Column, kind: str) -> Column:
    """An SQL literal; NULL gives the text NULL. ``kind`` is the static Spark type."""
    if kind == "string":
        text = F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'"))
    elif kind == "binary":
        text = F.concat(F.lit("X'"), F.hex(x), F.lit("'"))
    elif kind == "boolean":
        text = x.cast("int").cast("string")
    else:
        text = x.cast("string")
    return F.coalesce(text, F.lit("NULL"))


def typeof(x: Column, kind: str) -> Column:
    """null, integer, real, text or blob; sees NULLs."""
    name = {"string": "text", "binary": "blob", "double": "real", "float": "real"}.get(kind, "integer")
    name = "real" if kind.startswith("decimal") else name
    return F.when(x.isNull(), "null").otherwise(name)


def splice(x: Column, at: Column, remove: Column, insert: Column) -> Column:
    """Replace ``remove`` bytes at byte offset ``at`` (from 0); a range outside raises."""
    raw, size = x.cast("binary"), F.octet_length(x)
    bad = (at < 0) | (remove < 0) | (at + remove > size)
    done = F.concat(F.substring(raw, F.lit(1), at), insert.cast("binary"), F.substring(raw, at + remove + 1, F.greatest(size, F.lit(1)))).cast("string")
    return F.when(x.isNull() | at.isNull() | remove.isNull() | insert.isNull(), F.lit(None).cast("string")).when(bad, F.raise_error(F.lit("splice: range outside the text")).cast("string")).otherwise(done)


_SPEC = re.compile(r"%([-+ 0,#!]*)(\d*)(?:\.(\d+))?(?:l*)([a-zA-Z%])")


def printf(pattern: str, *args: Column) -> Column:
    """``printf`` for a literal pattern, taken apart when the plan is built.

    d i u s c f e g x X o q Q w and %% with width, precision and the flags ``-+0,``. A NULL
    prints as an empty string for s and q, as 0 for numbers, and as NULL for Q.
    """
    parts, at, rest = [], 0, list(args)
    for m in _SPEC.finditer(pattern):
        if m.start() > at:
            parts.append(F.lit(pattern[at : m.start()]))
        at = m.end()
        flags, width, precision, kind = m[1].replace("!", ""), m[2], m[3], m[4]
        if kind == "%":
            parts.append(F.lit("%"))
            continue
        x = rest.pop(0) if rest else F.lit(None)
        if kind in "diu":
            parts.append(F.format_string(f"%{flags}{width}d", F.coalesce(x.cast("long"), F.lit(0).cast("long"))))
        elif kind in "xXo":
            parts.append(F.format_string(f"%{flags}{width}{kind}", F.coalesce(x.cast("long"), F.lit(0).cast("long"))))
        elif kind in "fFeEgG":
            parts.append(F.format_string(f"%{flags}{width}.{precision or 6}{'f' if kind == 'F' else kind}", F.coalesce(x.cast("double"), F.lit(0.0))))
        else:
            text = F.coalesce(x.cast("string"), F.lit(""))
            if kind == "c":
                text = F.substring(text, 1, 1)
            elif kind == "q":
                text = F.replace(text, F.lit("'"), F.lit("''"))
            elif kind == "Q":
                text = F.when(x.isNull(), "NULL").otherwise(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'")))
            elif kind == "w":
                text = F.replace(text, F.lit('"'), F.lit('""'))
            elif kind != "s":
                raise ValueError(f"printf: %{kind} is not supported")
            if precision is not None:
                text = F.substring(text, 1, int(precision))
            if width:
                pad = F.greatest(F.lit(int(width)), F.char_length(text))
                text = F.rpad(text, pad, F.lit(" ")) if "-" in flags else F.lpad(text, pad, F.lit(" "))
            parts.append(text)
    if at < len(pattern):
        parts.append(F.lit(pattern[at:]))
    return F.concat(*parts) if parts else F.lit("")


def nullif(a: Column, b: Column) -> Column:
    return F.nullif(a, b)


def iif(test: Column, yes: Column, no: Column | None = None) -> Column:
    return F.when(test, yes) if no is None else F.when(test, yes).otherwise(no)


def scalar_max(*xs: Column) -> Column:
    """NULL if any is NULL, unlike ``greatest``."""
    known = xs[0].isNotNull()
    for x in xs[1:]:
        known = known & x.isNotNull()
    return F.when(known, F.greatest(*xs))


def scalar_min(*xs: Column) -> Column:
    known = xs[0].isNotNull()
    for x in xs[1:]:
        known = known & x.isNotNull()
    return F.when(known, F.least(*xs))
