"""SQLite database files as a Spark data source, read by rowid ranges and written whole.

``spark.dataSource.register(SqliteSource)`` then
``spark.read.format("sqlite_file").option("path", p).option("table", t).load()``. The file
must be readable at the same path on every executor, as a file format of one machine is.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.casts import affinity

_TYPES = {"INTEGER": "bigint", "TEXT": "string", "REAL": "double", "BLOB": "binary", "NUMERIC": "double"}


def _name(x: str) -> str:
    return '"' + x.replace('"', '""') + '"'


def columns(path: str, table: str) -> list[tuple[str, str]]:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        return [(r[1], r[2]) for r in con.execute(f"PRAGMA table_info({_name(table)})")]


class Range(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path, self.table, self.schema = options["path"], options["table"], schema
        self.parts = int(options.get("partitions", 8))

    def partitions(self) -> list[Range]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            try:
                low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_name(self.table)}").fetchone()
            except sqlite3.OperationalError:  # WITHOUT ROWID: one range
                return [Range(None, None)]
        if low is None:
            return [Range(0, -1)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [Range(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition: Range) -> Iterator[tuple]:
        names = ", ".join(_name(f.name) for f in self.schema.fields)
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            where, args = ("", ()) if partition.low is None else (" WHERE rowid BETWEEN ? AND ?", (partition.low, partition.high))
            kinds = [f.dataType.simpleString() for f in self.schema.fields]
            for row in con.execute(f"SELECT {names} FROM {_name(self.table)}{where}", args):
                yield tuple(_fit(v, k) for v, k in zip(row, kinds, strict=True))


def _fit(value, kind: str):
    """A value of another storage class than its column declares, as text where it can be."""
    if value is None:
        return None
    if kind == "bigint":
        return value if isinstance(value, int) else None
    if kind == "double":
        return float(value) if isinstance(value, (int, float)) else None
    if kind == "binary":
        return value if isinstance(value, bytes) else str(value).encode()
    return value if isinstance(value, str) else value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_file"

    def schema(self) -> str:
        return ", ".join(f"`{n}` {_TYPES[affinity(t)]}" for n, t in columns(self.options["path"], self.options["table"]))

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(self.options, schema)


def read_sqlite(spark: SparkSession, path: str, table: str, partitions: int = 8) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_file").option("path", path).option("table", table).option("partitions", partitions).load()


def write_sqlite(df: DataFrame, path: str, table: str) -> int:
    """Write a table into one file, as such a file is: the driver streams the partitions, one
    at a time in memory, into a transaction. Meant for exports that fit one file."""
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "boolean": "INTEGER", "double": "REAL", "float": "REAL", "binary": "BLOB"}
    decl = ", ".join(f"{_name(c)} {kinds.get(t, 'TEXT')}" for c, t in df.dtypes)
    plain = df.select(*[F.col(f"`{c}`").cast("int").alias(c) if t == "boolean" else F.col(f"`{c}`") if t in kinds else F.col(f"`{c}`").cast("string").alias(c) for c, t in df.dtypes])
    n = 0
    with sqlite3.connect(path) as con:
        con.execute(f"DROP TABLE IF EXISTS {_name(table)}")
        con.execute(f"CREATE TABLE {_name(table)} ({decl})")
        insert = f"INSERT INTO {_name(table)} VALUES ({', '.join('?' * len(df.columns))})"
        for row in plain.toLocalIterator():
            con.execute(insert, tuple(bytes(v) if isinstance(v, bytearray) else v for v in row))
            n += 1
    return n


def validated(df: DataFrame, types: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) for a strict import: text columns cast to ``types``; rejected rows keep
    their text and name the columns that did not fit (``_bad``)."""
    bad = F.array_compact(F.array(*[F.when(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull(), F.lit(c)) for c, t in types.items()]))
    marked = df.withColumn("_bad", bad)
    good = marked.where(F.size("_bad") == 0).select(*[F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns])
    return good, marked.where(F.size("_bad") > 0)


def data_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of only one side, as often as they are more there, with ``side``."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionAll(b.exceptAll(a).withColumn("side", F.lit("right")))
