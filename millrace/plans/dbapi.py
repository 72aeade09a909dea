"""A database connection in the shape of PEP 249, over ``Database``.

``fetchone`` and iteration stream partition by partition; ``fetchall`` collects. Statements
outside BEGIN take effect at once, as the database's own do; ``commit`` and ``rollback`` end
an open transaction and otherwise do nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

from .database import Database

apilevel = "2.0"
threadsafety = 1
paramstyle = "qmark"


class Error(Exception):
    pass


class DatabaseError(Error):
    pass


class IntegrityError(DatabaseError):
    pass


class ProgrammingError(DatabaseError):
    pass


def connect(spark: SparkSession, root: str, strict: bool = False) -> Connection:
    return Connection(Database(spark, root, strict))


class Cursor:
    arraysize = 1

    def __init__(self, connection: Connection):
        self.connection = connection
        self.description: list[tuple] | None = None
        self.rowcount = -1
        self._frame: DataFrame | None = None
        self._rows: Iterator | None = None

    def execute(self, sql: str, params: list | tuple | dict | None = None) -> Cursor:
        self._frame, self._rows, self.description, self.rowcount = None, None, None, -1
        got = self.connection._run(sql, list(params) if isinstance(params, tuple) else params)
        if isinstance(got, DataFrame):
            self._frame = got
            self.description = [(f.name, f.dataType.simpleString(), None, None, None, None, f.nullable) for f in got.schema]
        elif got is not None:
            self.rowcount = got
        return self

    def executemany(self, sql: str, rows: Iterable) -> Cursor:
        """The statement once for each row of parameters, all or none of them."""
        database, total = self.connection.database, 0
        own = not database.catalog.stack
        if own:
            database.execute("BEGIN")
        try:
            for params in rows:
                self.execute(sql, params)
                total += max(self.rowcount, 0)
        except Error:
            if own:
                database.execute("ROLLBACK")
            raise
        if own:
            database.execute("COMMIT")
        self.rowcount = total
        return self

    def executescript(self, sql: str) -> Cursor:
        self.connection._guard(lambda: self.connection.database.script(sql))
        return self

    def _stream(self) -> Iterator:
        if self._frame is None:
            raise ProgrammingError("no rows to fetch")
        if self._rows is None:
            self._rows = self._frame.toLocalIterator()
        return self._rows

    def fetchone(self) -> tuple | None:
        row = next(self._stream(), None)
        return None if row is None else tuple(row)

    def fetchmany(self, size: int | None = None) -> list[tuple]:
        out = []
        while len(out) < (size or self.arraysize) and (row := self.fetchone()) is not None:
            out.append(row)
        return out

    def fetchall(self) -> list[tuple]:
        if self._rows is None and self._frame is not None:
            self._rows = iter(())
            return [tuple(r) for r in self._frame.collect()]
        return [tuple(r) for r in self._stream()]

    def __iter__(self) -> Iterator[tuple]:
        return iter(self.fetchone, None)

    def close(self) -> None:
        self._frame = self._rows = None


class Connection:
    def __init__(self, database: Database):
        self.database = database
        self.closed = False

    def _guard(self, run: Callable):
        if self.closed:
            raise ProgrammingError("the connection is closed")
        try:
            return run()
        except ValueError as e:
            kind = IntegrityError if "constraint" in str(e) or "row-level security" in str(e) else ProgrammingError
            raise kind(str(e)) from e

    def _run(self, sql: str, params: list | dict | None):
        return self._guard(lambda: self.database.execute(sql, params))

    def cursor(self) -> Cursor:
        return Cursor(self)

    def execute(self, sql: str, params: list | tuple | dict | None = None) -> Cursor:
        return self.cursor().execute(sql, params)

    def executemany(self, sql: str, rows: Iterable) -> Cursor:
        return self.cursor().executemany(sql, rows)

    def executescript(self, sql: str) -> Cursor:
        return self.cursor().executescript(sql)

    def create_function(self, name: str, fn: Callable, returns: str) -> None:
        self.database.create_function(name, fn, returns)

    def create_aggregate(self, name: str, fn: Callable, returns: str) -> None:
        self.database.create_aggregate(name, fn, returns)

    def create_window_function(self, name: str, cls: type, returns: str) -> None:
        self.database.create_window(name, cls, returns)

    def create_collation(self, name: str, key: Callable) -> None:
        from ..functions import collation

        collation.register(name, key)

    @property
    def in_transaction(self) -> bool:
        return bool(self.database.catalog.stack)

    def commit(self) -> None:
        if self.in_transaction:
            self.database.execute("COMMIT")

    def rollback(self) -> None:
        if self.in_transaction:
            self.database.execute("ROLLBACK")

    def iterdump(self) -> Iterator[str]:
        return iter(self.database.dump())

    def backup(self, root: str) -> Connection:
        return Connection(self.database.backup(root))

    def close(self) -> None:
        self.rollback()
        self.closed = True

    def __enter__(self) -> Connection:
        return self

    def __exit__(self, kind: object, *rest: object) -> None:
        self.rollback() if kind else self.commit()
