"""Vector distances in double precision over arrays of floats, and blobs of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_f32(blob: pd.Series) -> pd.Series:
    """A blob of little-endian 32-bit floats."""
    return blob.map(lambda b: None if b is None else np.frombuffer(b, "<f4").tolist())


def literal(values) -> Column:
    return F.lit([float(v) for v in values]).cast("array<double>")


def _zip_sum(a: Column, b: Column, term) -> Column:
    total = F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), term), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length")).cast("double")).otherwise(total)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_zip_sum(a, b, lambda x, y: (x - y) * (x - y)))


def dot(a: Column, b: Column) -> Column:
    return _zip_sum(a, b, lambda x, y: x * y)


def cosine(a: Column, b: Column) -> Column:
    """1 - cos; NULL for a zero vector."""
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
