"""Collations: keys to compare, group and order by. BINARY is Spark's own order."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .strings import nocase, rtrim_key

_KEYS: dict[str, Callable[[Column], Column]] = {"BINARY": lambda x: x, "NOCASE": nocase, "RTRIM": rtrim_key}


#: Host keys by name, for SQL text.
_RAW: dict[str, Callable[[str], bytes | str]] = {}


def register(name: str, key: Callable[[str], bytes | str]) -> None:
    """A host collation by its sort key, which Spark can shuffle and sort on: an Arrow UDF
    makes the key once a row instead of calling back for every comparison."""

    def make(x: Column) -> Column:
        @F.pandas_udf(T.BinaryType())
        def run(values: pd.Series) -> pd.Series:
            out = [None if v is None else key(v) for v in values]
            return pd.Series([v.encode() if isinstance(v, str) else v for v in out], dtype=object)

        return run(x)

    _KEYS[name.upper()] = make
    _RAW[name.upper()] = key


def collate(x: Column, name: str) -> Column:
    if name.upper() not in _KEYS:
        raise ValueError(f"no such collation sequence: {name}")
    return _KEYS[name.upper()](x)


def equals(a: Column, b: Column, name: str) -> Column:
    return collate(a, name) == collate(b, name)
