"""The query facade: parameters, session values, macros, row-level security, functions.

Custom operators and ``current_setting`` are replaced outside quotes; then ``dialect`` writes
the statement as Spark SQL with the engine's semantics. Analysis, optimisation and execution
are Spark's. ``native`` takes Spark's own SQL instead.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_QUOTED = r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*"


def outside_quotes(sql: str, change: Callable[[str], str]) -> str:
    """Apply a change to the text between quoted parts and comments."""
    out, at = [], 0
    for m in re.finditer(_QUOTED, sql):
        out += [change(sql[at : m.start()]), m[0]]
        at = m.end()
    return "".join([*out, change(sql[at:])])


class Macros:
    """Custom operators ``a :name: b``: text templates with {left} and {right}, innermost left
    first. Operands are names, calls, parenthesised expressions or literals."""

    def __init__(self) -> None:
        self.templates: dict[str, str] = {}

    def define(self, symbol: str, template: str) -> None:
        if not re.fullmatch(r":[^:\s]+:", symbol):
            raise ValueError("an operator is written :symbol:")
        self.templates[symbol] = template

    def expand(self, sql: str, limit: int = 100) -> str:
        for _ in range(limit):
            plain = re.sub(_QUOTED, lambda m: " " * len(m[0]), sql)
            at = min(((i, s) for s in self.templates if (i := plain.find(s)) >= 0), default=None)
            if at is None:
                return sql
            i, symbol = at
            a, b = _left_operand(sql, i), _right_operand(sql, i + len(symbol))
            sql = sql[:a] + "(" + self.templates[symbol].format(left=sql[a:i].strip(), right=sql[i + len(symbol) : b].strip()) + ")" + sql[b:]
        raise ValueError("macros do not end")


def _left_operand(sql: str, at: int) -> int:
    """Where the operand that ends before ``at`` begins: a literal, or a name, a call or a
    parenthesised expression."""
    i = len(sql[:at].rstrip())
    if i and sql[i - 1] == "'":
        return sql.rindex("'", 0, i - 1)
    if i and sql[i - 1] == ")":
        depth = 0
        while i:
            i -= 1
            depth += (sql[i] == ")") - (sql[i] == "(")
            if not depth:
                break
    while i and (sql[i - 1].isalnum() or sql[i - 1] in "_."):
        i -= 1
    return i


def _right_operand(sql: str, at: int) -> int:
    i = at + len(sql[at:]) - len(sql[at:].lstrip())
    if sql[i : i + 1] == "'":
        return sql.index("'", i + 1) + 1
    while i < len(sql) and (sql[i].isalnum() or sql[i] in "_."):
        i += 1
    if sql[i : i + 1] == "(":
        depth = 0
        while i < len(sql):
            depth += (sql[i] == "(") - (sql[i] == ")")
            i += 1
            if not depth:
                break
    return i


@dataclass
class Policy:
    """Permissive policies of one table are OR-ed; a secured table without any shows nothing."""

    using: list[str] = field(default_factory=list)
    check: list[str] = field(default_factory=list)


class Engine:
    """``strict`` chooses the other dialect (see ``dialect``)."""

    def __init__(self, spark: SparkSession, strict: bool = False):
        self.spark, self.macros, self.strict = spark, Macros(), strict
        self.session: dict[str, object] = {}
        self.tables: dict[str, DataFrame] = {}
        self.policies: dict[str, Policy] = {}

    def register(self, name: str, df: DataFrame) -> None:
        self.tables[name] = df
        self._expose(name)

    def secure(self, name: str, using: str | None = None, check: str | None = None) -> None:
        """Turn on row-level security and add a permissive policy."""
        p = self.policies.setdefault(name, Policy())
        if using:
            p.using.append(using)
        if check or using:
            p.check.append(check or using)
        self._expose(name)

    def setting(self, name: str, value: object) -> None:
        """A scalar, or a list for ``x IN (current_setting('k'))``."""
        self.session[name] = value
        for t in self.policies:
            self._expose(t)

    def _literal(self, value: object) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, (list, tuple)):
            return ", ".join(map(self._literal, value)) or "NULL"
        if isinstance(value, bool):
            return str(value).upper()
        return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"

    def _settings(self, sql: str) -> str:
        found = r"'(?:[^']|'')*'|\bcurrent_setting\(\s*'([^']*)'\s*\)"
        return re.sub(found, lambda m: m[0] if m[1] is None else self._literal(self.session.get(m[1])), sql, flags=re.I)

    def expression_text(self, sql: str, schema: T.StructType, aliases: tuple[str, ...] = ("",)) -> str:
        """An expression of the dialect over columns, as Spark SQL; names may be qualified by
        an alias."""
        from .dialect import Translator

        columns = {f.name: f.dataType.simpleString() for f in schema}
        return Translator(self.spark, strict=self.strict).expression_text(self._settings(self.macros.expand(sql)), columns, aliases)

    def expression(self, sql: str, df: DataFrame, aliases: tuple[str, ...] = ("",)) -> Column:
        return F.expr(self.expression_text(sql, df.schema, aliases))

    def _predicate(self, parts: list[str], df: DataFrame) -> Column:
        out = F.lit(False)
        for p in parts:
            out = out | F.coalesce(self.expression(p, df), F.lit(False))
        return out

    def _expose(self, name: str) -> None:
        """Scans of a secured table read a filtered view; the filter reaches the files."""
        df = self.tables[name]
        if name in self.policies:
            df = df.where(self._predicate(self.policies[name].using, df))
        df.createOrReplaceTempView(name)
        self._owners()[name] = self

    def _owners(self) -> dict[str, Engine]:
        """Whose tables the session's views are: several engines may share a session."""
        if not hasattr(self.spark, "_ml_owners"):
            self.spark._ml_owners = {}
        return self.spark._ml_owners

    def _claim(self) -> None:
        for name in self.tables:
            if self._owners().get(name) is not self:
                self._expose(name)

    def with_check(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows that the table's policies would refuse on write."""
        return rows.where(~self._predicate(self.policies[name].check, rows)) if name in self.policies else rows.limit(0)

    def query(self, sql: str, params: list | dict | None = None) -> DataFrame:
        """A query of the dialect. ``?``, ``?2``, ``$2`` or ``:name`` parameters are bound by
        Spark, never pasted."""
        from .dialect import Translator

        self._claim()
        sql = self._settings(self.macros.expand(sql))
        t = Translator(self.spark, params, self.strict)
        text = t.translate(sql)
        return self.spark.sql(text, t.bound or None)

    def native(self, sql: str, params: dict | None = None) -> DataFrame:
        """Spark's own SQL over the registered tables."""
        self._claim()
        return self.spark.sql(self._settings(self.macros.expand(sql)), params or {})

    def stream(self, sql: str, params: list | dict | None = None):
        """Rows one by one, a partition at a time."""
        return self.query(sql, params).toLocalIterator()

    def explain(self, sql: str, mode: str = "formatted") -> str:
        df = self.query(sql)
        return self.spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)

    def access(self, sql: str) -> dict[str, list[str]]:
        """The tables and columns that a statement names, as the dialect resolves them, inside
        subqueries too. Text in quotes and comments is no name."""
        from .dialect import Translator

        self._claim()
        t = Translator(self.spark, None, self.strict)
        t.translate(self._settings(self.macros.expand(sql)))
        return {name: sorted(cols) for name, cols in sorted(t.reads.items())}

    def create_function(self, name: str, fn: Callable, returns: str) -> None:
        """A host function over Arrow batches of values (None in, None out is the host's own)."""
        self.spark.udf.register(name, F.udf(fn, returns, useArrow=True))

    def create_aggregate(self, name: str, step_finish: Callable, returns: str) -> None:
        """A host aggregate: a function of the group's values as a list, NULLs included."""
        import pandas as pd

        def run(x: pd.Series) -> object:
            return step_finish([None if v is None or v != v else v for v in x.tolist()])

        if not hasattr(self.spark, "_ml_aggregates"):
            self.spark._ml_aggregates = set()
        self.spark._ml_aggregates.add(name.lower())
        run.__annotations__ = {"x": pd.Series, "return": object}
        self.spark.udf.register(name, F.pandas_udf(run, returns, F.PandasUDFType.GROUPED_AGG))

    def create_table_function(self, name: str, rows: Callable, returns: str) -> None:
        """A host table function for FROM: ``rows(*args)`` yields tuples."""

        class Run:
            def eval(self, *args: object):
                yield from rows(*args)

        self.spark.udtf.register(name, F.udtf(Run, returnType=returns))

    def create_window(self, name: str, cls: type, returns: str) -> None:
        """A host window aggregate: a class with ``step(x)`` and ``value()``. Frames are handed
        over whole, so its ``inverse``, which serves to slide a frame, is not called."""

        def run(values: list) -> object:
            state = cls()
            for v in values:
                state.step(v)
            return state.value()

        self.create_aggregate(name, run, returns)

    def create_plpgsql(self, sql: str, returns: str) -> str:
        """A stored function from a PL/pgSQL CREATE FUNCTION statement."""
        from .plpgsql import compile_function

        name, fn = compile_function(sql)
        self.create_function(name, fn, returns)
        return name

    def install_model_operators(self, model: dict) -> list[str]:
        """``a :->: b`` (an edge exists) and ``e :~: q`` (vector distance) from a model's roles:
        an edge table with ``traverse`` [src, dst], an embedding table with ``knn``."""
        out = []
        for name, t in model.get("tables", {}).items():
            if t.get("role") == "edge" and t.get("traverse"):
                src, dst = t["traverse"]
                self.macros.define(":->:", f"EXISTS (SELECT 1 FROM {name} WHERE {name}.{src} = ({{left}}) AND {name}.{dst} = ({{right}}))")
                out.append(":->:")
            elif t.get("role") == "embedding" and t.get("knn"):
                self.macros.define(":~:", "sqrt(aggregate(zip_with(CAST({left} AS ARRAY<DOUBLE>), CAST({right} AS ARRAY<DOUBLE>), (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))")
                out.append(":~:")
        if not out:
            raise ValueError("the model declares no edge or embedding role with traverse or knn access")
        install_functions(self.spark)
        return out

    def create_python(self, source: str, returns: str) -> str:
        """A stored function in a pure subset of Python: one ``def`` with assignments, if,
        while, for over range, return and arithmetic; no imports, attributes or other calls."""
        name, fn = compile_pure(source)
        self.create_function(name, fn, returns)
        return name


_ALLOWED = (
    ast.Module, ast.FunctionDef, ast.arguments, ast.arg, ast.Return, ast.Assign, ast.AugAssign, ast.If, ast.While, ast.For, ast.Break, ast.Continue, ast.Pass,
    ast.Expr, ast.BinOp, ast.UnaryOp, ast.BoolOp, ast.Compare, ast.IfExp, ast.Call, ast.Name, ast.Load, ast.Store, ast.Constant, ast.operator, ast.unaryop, ast.boolop, ast.cmpop,
)
_CALLS = {"range": range, "abs": abs, "min": min, "max": max, "len": len, "int": int, "float": float, "str": str, "round": round}
BUDGET = 1_000_000


def compile_pure(source: str, budget: int = BUDGET, helpers: dict[str, Callable] | None = None) -> tuple[str, Callable]:
    """(name, function) of a checked source, which may also call ``helpers``; loops count
    against a budget of steps."""
    known = {**_CALLS, **(helpers or {})}
    tree = ast.parse(source)
    if len(tree.body) != 1 or not isinstance(tree.body[0], ast.FunctionDef):
        raise ValueError("one def is expected")
    for node in ast.walk(tree):
        if not isinstance(node, _ALLOWED):
            raise ValueError(f"{type(node).__name__} is not allowed")
        if isinstance(node, ast.Call) and not (isinstance(node.func, ast.Name) and node.func.id in known and not node.keywords):
            raise ValueError("only some built-in functions may be called")
        if isinstance(node, ast.Name) and node.id.startswith("_"):
            raise ValueError("names may not begin with _")
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Pow):
            raise ValueError("** is not allowed")
        if isinstance(node, (ast.While, ast.For)):
            node.body.insert(0, ast.parse("_tick()").body[0])
    name = tree.body[0].name
    code = compile(ast.fix_missing_locations(tree), f"<{name}>", "exec")

    def call(*args):
        left = budget

        def tick() -> None:
            nonlocal left
            left -= 1
            if left < 0:
                raise RuntimeError(f"{name}: the step budget is used up")

        scope = {"__builtins__": {}, "_tick": tick, **known}
        exec(code, scope)  # noqa: S102  checked above
        return scope[name](*args)

    return name, call


def install_functions(spark: SparkSession) -> None:
    """SQL names of the engine's functions, for Spark's own SQL too."""
    from .sqlfunctions import install

    install(spark)
