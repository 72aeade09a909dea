"""Numeric functions and operators: NULL for domain errors, integer division, shifts.

``strict=True`` gives the other dialect's behaviour where it differs: an error instead of
NULL, by ANSI arithmetic.
"""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _finite(x: Column) -> Column:
    """NaN to NULL."""
    return F.when(~F.isnan(x), x)


def int_div(a: Column, b: Column, strict: bool = False) -> Column:
    """Integer division toward zero; a zero divisor gives NULL, or an error if strict."""
    whole = F.call_function("div", a, b)
    return whole if strict else F.when(b != 0, whole)


def div(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def mod(a: Column, b: Column) -> Column:
    """Sign of the dividend; a zero divisor gives NULL."""
    return F.try_mod(a, b)


def shift_left(a: Column, n: Column) -> Column:
    """64 or more clears, a negative count shifts right (arithmetically)."""
    a, n = a.cast("long"), n.cast("long")
    sign = F.when(a < 0, F.lit(-1)).otherwise(F.lit(0)).cast("long")
    up = F.when(n >= 64, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", a, n.cast("int")))
    down = F.when(n <= -64, sign).otherwise(F.call_function("shiftright", a, (-n).cast("int")))
    return F.when(n >= 0, up).otherwise(down)


def shift_right(a: Column, n: Column) -> Column:
    return shift_left(a, -n.cast("long"))


def truthy(x: Column, kind: str = "double") -> Column:
    """Numbers are true unless 0; a text counts by its numeric prefix."""
    from .casts import to_real

    return (to_real(x) if kind == "string" else x.cast("double")) != 0


@F.pandas_udf(T.DoubleType())
def _round_exact(x: pd.Series, n: pd.Series) -> pd.Series:
    """Rounds the exact binary value: there are no ties but true ones."""
    step = {k: Decimal(1).scaleb(-int(k)) for k in n.dropna().unique()}
    return pd.Series([float(Decimal(v).quantize(step[k], ROUND_HALF_EVEN)) if v == v and abs(v) < 1e15 else v for v, k in zip(x, n, strict=True)])


def round_(x: Column, n: Column | int = 0) -> Column:
    """Always a real. Halves go away from zero at n = 0; for n > 0 the exact binary value is
    rounded, so round(2.675, 2) is 2.67. n is taken as 0 to 30."""
    x = x.cast("double")
    if isinstance(n, int):
        n = min(max(n, 0), 30)
        return F.round(x) if n == 0 else F.when(x.isNotNull(), _round_exact(x, F.lit(n)))
    n = F.least(F.greatest(n, F.lit(0)), F.lit(30))
    return F.when(x.isNull() | n.isNull(), None).when(n == 0, F.round(x)).otherwise(_round_exact(x, n))


def ceil(x: Column, kind: str = "double") -> Column:
    return F.ceil(x).cast(kind)


def floor(x: Column, kind: str = "double") -> Column:
    return F.floor(x).cast(kind)


def trunc(x: Column, kind: str = "double") -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast(kind)


def sign(x: Column) -> Column:
    return F.signum(x).cast("long")


def sqrt(x: Column) -> Column:
    return _finite(F.sqrt(x))


def power(x: Column, y: Column) -> Column:
    return _finite(F.pow(x, y))


def exp(x: Column) -> Column:
    return F.exp(x)


def ln(x: Column) -> Column:
    return F.when(x > 0, F.log(x))


def log10(x: Column) -> Column:
    return F.when(x > 0, F.log10(x))


def log2(x: Column) -> Column:
    return F.when(x > 0, F.log2(x))


def log(a: Column, b: Column | None = None) -> Column:
    """One argument: base 10. Two: base a (over 1) of b."""
    return log10(a) if b is None else F.when((a > 1) & (b > 0), F.log(b) / F.log(a))


def asin(x: Column) -> Column:
    return _finite(F.asin(x))


def acos(x: Column) -> Column:
    return _finite(F.acos(x))


def fmod(x: Column, y: Column) -> Column:
    return F.try_mod(x.cast("double"), y.cast("double"))


sin, cos, tan, atan, atan2 = F.sin, F.cos, F.tan, F.atan, F.atan2
sinh, cosh, tanh, radians, degrees, pi, abs_ = F.sinh, F.cosh, F.tanh, F.radians, F.degrees, F.pi, F.abs
