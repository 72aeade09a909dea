"""Stored procedures: SQL scripts (Spark's SQL scripting) and Python bodies over a session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .engine import Engine


class Budget(Exception):
    pass


class Limited:
    """An engine for one call of a Python body: at most so many queries, and so many rows
    handed to Python in all."""

    def __init__(self, engine: Engine, calls: int, rows: int):
        self.engine, self.calls, self.left = engine, calls, rows

    def query(self, sql: str, params: list | dict | None = None) -> DataFrame:
        self.calls -= 1
        if self.calls < 0:
            raise Budget("the budget of queries is used up")
        return self.engine.query(sql, params)

    def rows(self, sql: str, params: list | dict | None = None) -> list:
        """A query's rows; one more than is left is asked for, never all of them."""
        got = self.query(sql, params).limit(self.left + 1).collect()
        self.left -= len(got)
        if self.left < 0:
            raise Budget("the budget of rows is used up")
        return got


class Procedures:
    """Named bodies; ``call`` runs one with arguments. A SQL body is a BEGIN ... END script
    with DECLARE, IF, WHILE, LOOP and cursors by FOR; ``:name`` marks an argument. A Python body
    gets a ``Limited`` engine."""

    def __init__(self, engine: Engine, calls: int = 1000, rows: int = 100_000):
        self.engine, self.calls, self.rows = engine, calls, rows
        self.known: dict[str, tuple[list[str], str | Callable]] = {}

    def create(self, name: str, params: list[str], body: str | Callable) -> None:
        self.known[name] = (params, body)

    def drop(self, name: str) -> None:
        del self.known[name]

    def call(self, name: str, *args: object) -> DataFrame | object:
        if name not in self.known:
            raise ValueError(f"no such procedure: {name}")
        params, body = self.known[name]
        if len(params) != len(args):
            raise ValueError(f"{name} takes {len(params)} arguments")
        if callable(body):
            return body(Limited(self.engine, self.calls, self.rows), *args)
        return self.engine.spark.sql(body, dict(zip(params, args, strict=True)))
