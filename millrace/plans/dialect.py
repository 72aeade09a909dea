"""SQL text of the embedded dialect, rewritten to Spark SQL.

One pass over the tokens by recursive descent; every expression is written out again with
its own parentheses and with the engine's meaning: integer division that gives NULL by zero,
ASCII-folding LIKE, GLOB, MATCH, empty IN lists, row values by three-valued logic, one
precedence for all set operations, aliases in WHERE, bare columns of grouped queries,
negative limits, and the functions of ``functions``. Some of it depends on static types,
which come from the schemas of the tables in scope. Catalyst plans the result as any other
text; nothing is executed here but the steps of ``WITH RECURSIVE ... UNION``.

With ``strict`` the other dialect's rules hold where they differ: ``/`` and ``%`` raise by
zero, LIKE is case-sensitive with a backslash escape, casts are all or nothing, and a column
that is neither grouped nor aggregated is an error.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import casts, predicates, strings
from ..operators import search
from . import sqlfunctions

_TOKEN = re.compile(
    r"(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<blob>[xX]'[0-9A-Fa-f]*')|(?P<text>'(?:[^']|'')*')|(?P<name>\"(?:[^\"]|\"\")*\"|`[^`]*`|\[[A-Za-z_][\w ]*\])"
    r"|(?P<param>\?\d*|[:@$][A-Za-z0-9_]+)|(?P<number>0[xX][0-9A-Fa-f]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?:[dD]\b)?)|(?P<word>[^\W\d]\w*)"
    r"|(?P<op>->>|->|::|\|\||<=>|<<|>>|<>|!=|<=|>=|==|!~\*|!~|~\*|.)",
    re.S,
)
_SET = ("UNION", "EXCEPT", "INTERSECT")
_CLAUSES = {"FROM", "WHERE", "GROUP", "HAVING", "WINDOW", "ORDER", "LIMIT", "OFFSET", *_SET, "ON", "USING", "JOIN", "NATURAL", "LEFT", "RIGHT", "FULL", "INNER", "CROSS", "RETURNING", "AS", "THEN", "ELSE", "END", "WHEN", "AND", "OR", "DESC", "ASC", "NULLS", "PARTITION", "ROWS", "RANGE", "GROUPS", "FILTER", "OVER", "SEPARATOR", "LATERAL", "SET", "DO"}
_AGGREGATES = {"count", "sum", "avg", "min", "max", "total", "group_concat", "string_agg", "array_agg", "bool_and", "bool_or", "every", "stddev", "stddev_pop", "stddev_samp", "variance", "var_pop", "var_samp", "any_value", "max_by", "min_by", "percentile", "median", "collect_list", "collect_set", "approx_count_distinct", "count_if", "mode", "corr"}
_INT = {"count", "length", "char_length", "character_length", "instr", "unicode", "sign", "row_number", "rank", "dense_rank", "ntile", "json_array_length", "json_valid", "position", "strpos", "octet_length", "approx_count_distinct", "count_if", "generate_subscripts", "cardinality", "size"}
_REAL = {"avg", "total", "round", "sqrt", "pow", "power", "exp", "ln", "log", "log10", "log2", "sin", "cos", "tan", "asin", "acos", "atan", "atan2", "sinh", "cosh", "tanh", "radians", "degrees", "pi", "percent_rank", "cume_dist", "julianday", "vec_l2", "vec_cosine", "stddev", "variance", "mod", "try_divide"}
_SAME = {"sum", "min", "max", "abs", "coalesce", "ifnull", "nullif", "lag", "lead", "first_value", "last_value", "nth_value", "any_value", "max_by", "min_by", "ceil", "ceiling", "floor", "trunc", "greatest", "least"}
_BOOL = {"bool_and", "bool_or", "every", "array_contains", "exists", "forall"}


def kind_of(spark_type: str) -> str:
    if spark_type in ("tinyint", "smallint", "int", "bigint"):
        return "int"
    if spark_type in ("float", "double") or spark_type.startswith("decimal"):
        return "real"
    return {"string": "text", "binary": "blob", "boolean": "bool", "void": "null"}.get(spark_type, spark_type)


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass
class Token:
    kind: str
    text: str

    @property
    def up(self) -> str:
        return self.text.upper() if self.kind in ("word", "op") else ""


def tokenize(sql: str) -> list[Token]:
    return [Token(m.lastgroup, m[0]) for m in _TOKEN.finditer(sql) if m.lastgroup != "space"]


@dataclass
class Node:
    """A written expression: its text, its static kind, and what later steps ask about it."""

    sql: str
    kind: str = "other"
    row: list[Node] | None = None
    value: str | None = None  # of a text literal
    collation: str | None = None
    column: str | None = None
    query: bool = False
    aggregate: bool = False
    opposite: str | None = None  # NOT of it, where that is written otherwise


@dataclass
class Scope:
    """Columns by table alias; None where a schema is not known."""

    tables: dict[str, dict[str, str] | None] = field(default_factory=dict)
    outer: Scope | None = None
    names: dict[str, str] = field(default_factory=dict)  # the table behind an alias

    def home(self, name: str, table: str | None = None) -> str | None:
        """The table that a column belongs to."""
        for alias, cols in self.tables.items():
            if (table is None or alias.lower() == table.lower()) and cols is not None and name.lower() in cols:
                return self.names.get(alias)
        return self.outer.home(name, table) if self.outer else None

    def kind(self, name: str, table: str | None = None) -> str | None:
        for alias, cols in self.tables.items():
            if (table is None or alias.lower() == table.lower()) and cols is not None and name.lower() in cols:
                return cols[name.lower()]
        return self.outer.kind(name, table) if self.outer else None

    def whole(self) -> bool:
        return all(c is not None for c in self.tables.values())


class Translator:
    def __init__(self, spark: SparkSession, params: list | dict | None = None, strict: bool = False):
        self.spark, self.strict, self.params = spark, strict, params
        self.bound: dict[str, object] = {}
        self.ctes: dict[str, dict[str, str] | None] = {}
        self.renamed: dict[str, str] = {}
        self.with_text: list[str] = []
        self.bare: Callable[[Node], str] | None = None
        self.aliases: dict[str, Node] = {}
        self.inside = 0
        self.free = 0
        self.reads: dict[str, set[str]] = {}
        sqlfunctions.install(spark)

    # -- tokens

    def translate(self, sql: str) -> str:
        self.toks, self.at = tokenize(sql), 0
        out = self.statement(Scope())
        self.accept(";")
        if self.at < len(self.toks):
            raise ValueError(f"unexpected {self.toks[self.at].text!r}")
        return " ".join([*self._with(), out])

    def expression_text(self, sql: str, columns: dict[str, str], aliases: tuple[str, ...] = ("",)) -> str:
        """One expression over columns of known Spark types; a condition where it is none."""
        self.toks, self.at = tokenize(sql), 0
        kinds = {c.lower(): kind_of(t) for c, t in columns.items()}
        out = self.expr(Scope(dict.fromkeys(aliases, kinds)))
        if self.at < len(self.toks):
            raise ValueError(f"unexpected {self.toks[self.at].text!r}")
        return out.sql

    def _with(self) -> list[str]:
        return [f"WITH {', '.join(self.with_text)}"] if self.with_text else []

    def peek(self, ahead: int = 0) -> Token:
        return self.toks[self.at + ahead] if self.at + ahead < len(self.toks) else Token("end", "")

    def take(self) -> Token:
        t = self.peek()
        if t.kind == "end":
            raise ValueError("the statement ends too early")
        self.at += 1
        return t

    def accept(self, *words: str) -> bool:
        if all(self.peek(i).up == w for i, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def expect(self, word: str) -> None:
        if not self.accept(word):
            raise ValueError(f"{word} is expected before {self.peek().text!r}")

    def name(self) -> str:
        t = self.take()
        if t.kind == "name":
            return t.text[1:-1].replace(t.text[0] * 2, t.text[0]) if t.text[0] != "[" else t.text[1:-1]
        if t.kind != "word":
            raise ValueError(f"a name is expected, not {t.text!r}")
        return t.text

    @staticmethod
    def quoted(name: str) -> str:
        return "`" + name.replace("`", "``") + "`"

    def columns(self, sql: str) -> list[tuple[str, str]] | None:
        """(name, kind) of a written query's columns, where it can be analyzed on its own."""
        try:
            got = self.spark.sql(" ".join([*self._with(), sql]), self.bound or None)
            return [(f.name, kind_of(f.dataType.simpleString())) for f in got.schema]
        except AnalysisException:  # a correlated query: its columns stay unknown
            return None

    def schema(self, sql: str) -> dict[str, str] | None:
        got = self.columns(sql)
        return None if got is None else {n.lower(): k for n, k in got}

    # -- statements

    def statement(self, outer: Scope) -> str:
        if self.accept("WITH"):
            recursive = self.accept("RECURSIVE")
            while True:
                self.cte(recursive, outer)
                if not self.accept(","):
                    break
        arms = [(None, self.core(outer))]
        while self.peek().up in _SET:
            op = self.take().up
            if self.accept("ALL"):
                op += " ALL"
            arms.append((op, self.core(outer)))
        sql = arms[0][1]
        if len(arms) > 1:  # left to right, whatever the operation
            sql = f"({sql})"
            for i, (op, arm) in enumerate(arms[1:]):
                sql = f"{sql} {op} ({arm})" if i == len(arms) - 2 else f"({sql} {op} ({arm}))"
        if self.peek().up in ("ORDER", "LIMIT", "OFFSET"):
            parts, self._parts = self._parts if len(arms) == 1 else None, None
            hidden: list[str] = []
            tail = self.order_limit(Scope({"": self.schema(sql)}, outer) if len(arms) > 1 else self._last, parts, hidden)
            if hidden:
                names = ", ".join(f"_order{i}" for i in range(len(hidden)))
                more = ", ".join(f"{h} AS _order{i}" for i, h in enumerate(hidden))
                sql = f"SELECT * EXCEPT ({names}) FROM (SELECT {', '.join(parts[0])}, {more}{parts[1]})"
            sql += tail
        return sql

    def order_limit(self, scope: Scope, parts: tuple | None = None, hidden: list[str] | None = None) -> str:
        out = ""
        if self.accept("ORDER", "BY"):
            out = f" ORDER BY {self.ordering(scope, parts, hidden)}"
        if self.accept("LIMIT"):
            n, skip = self.expr(scope), None
            if self.accept(","):
                n, skip = self.expr(scope), n
            elif self.accept("OFFSET"):
                skip = self.expr(scope)
            out += self._bounded("LIMIT", n) + (self._bounded("OFFSET", skip) if skip else "")
        elif self.accept("OFFSET"):
            out += self._bounded("OFFSET", self.expr(scope))
        return out

    def _bounded(self, word: str, n: Node) -> str:
        """Negative limits mean none, negative offsets 0; Spark refuses both."""
        plain = re.fullmatch(r"\(?(-?\d+)\)?", n.sql)
        value = int(plain[1]) if plain else self.spark.sql(f"SELECT CAST({n.sql} AS BIGINT) AS n", self.bound or None).first()[0]
        if value is None:
            raise ValueError(f"{word} is not a number")
        return "" if value < 0 or (word == "OFFSET" and value == 0) else f" {word} {value}"

    def cte(self, recursive: bool, outer: Scope) -> None:
        name, cols = self.name(), None
        if self.accept("("):
            cols = self.names()
        self.expect("AS")
        self.accept("MATERIALIZED") or self.accept("NOT", "MATERIALIZED")
        self.expect("(")
        start = self.at
        if recursive and any(t.kind in ("word", "name") and t.text.strip('"`').lower() == name.lower() for t in self.toks[start : self._close(start)]):
            self.recursive(name, cols, outer)
        else:
            body = self.statement(outer)
            self.with_text.append(f"{self.quoted(name)}{self._cols(cols)} AS ({body})")
            got = self.schema(f"SELECT * FROM {self.quoted(name)}")
            self.ctes[name.lower()] = got
        self.expect(")")

    def _cols(self, cols: list[str] | None) -> str:
        return f"({', '.join(map(self.quoted, cols))})" if cols else ""

    def _close(self, at: int) -> int:
        depth = 1
        while at < len(self.toks):
            depth += (self.toks[at].text == "(") - (self.toks[at].text == ")")
            if not depth:
                return at
            at += 1
        raise ValueError("parentheses do not match")

    def recursive(self, name: str, cols: list[str] | None, outer: Scope) -> None:
        base = self.core(outer)
        op = self.take().up
        if op != "UNION":
            raise ValueError("a recursive query is base UNION [ALL] step")
        everything = self.accept("ALL")
        start, end = self.at, self._close(self.at)
        step = self.toks[start:end]
        here = [i for i, t in enumerate(step) if t.kind in ("word", "name") and t.text.strip('"`').lower() == name.lower() and (step[i - 1].up in ("FROM", "JOIN", ",") if i else False)]
        if len(here) != 1:
            raise ValueError(f"{name} must stand once in the step's FROM")
        if any(t.up in ("ORDER", "LIMIT", "GROUP", "HAVING", "DISTINCT", *_SET) and not self._nested(step, i) for i, t in enumerate(step)):
            raise ValueError("a recursive step has no ORDER, LIMIT, GROUP, DISTINCT or further arms")
        if any(t.text.lower() in _AGGREGATES and i + 1 < len(step) and step[i + 1].text == "(" and not self._nested(step, i) and not any(x.up == "OVER" for x in step[i:]) for i, t in enumerate(step) if t.kind == "word"):
            raise ValueError("a recursive step has no aggregates")
        first = self.columns(base)
        names = cols or ([n for n, _ in first] if first else None)
        if names is None:
            raise ValueError("the columns of a recursive query must be known")
        kinds = dict(zip([c.lower() for c in names], [k for _, k in first] if first else ["other"] * len(names), strict=True))
        self.ctes[name.lower()] = kinds
        if everything:
            body = self.core(outer)
            self.with_text.append(f"{self.quoted(name)}{self._cols(names)} AS ({base} UNION ALL {body})")
            if not self.with_text[0].startswith("RECURSIVE "):
                self.with_text[0] = "RECURSIVE " + self.with_text[0]
            return
        from ..operators.recursion import fixpoint

        view = f"_recursive_{id(self)}_{len(self.renamed)}"
        prefix = self._with()
        start_df = self.spark.sql(" ".join([*prefix, base]), self.bound or None).toDF(*names)
        start_df.limit(0).createOrReplaceTempView(view)
        self.renamed[name.lower()] = view
        text = " ".join([*prefix, self.core(outer)])
        self.at = end

        def one(new: DataFrame) -> DataFrame:
            new.createOrReplaceTempView(view)
            return self.spark.sql(text, self.bound or None).toDF(*names).select(*[F.col(f"`{c}`").cast(start_df.schema[c].dataType).alias(c) for c in names])

        fixpoint(start_df, one).createOrReplaceTempView(view)

    @staticmethod
    def _nested(toks: list[Token], i: int) -> bool:
        return sum((t.text == "(") - (t.text == ")") for t in toks[:i]) > 0

    # -- one SELECT

    def core(self, outer: Scope) -> str:
        self._parts = None
        if self.accept("("):
            sql = self.statement(outer)
            self.expect(")")
            self._last, self._parts = Scope({"": self.schema(sql)}, outer), None
            return f"({sql})"
        if self.accept("VALUES"):
            rows = []
            while True:
                self.expect("(")
                rows.append([n.sql for n in self.list(Scope(outer=outer))])
                if not self.accept(","):
                    break
            if len({len(r) for r in rows}) > 1:
                raise ValueError("all VALUES must have the same number of terms")
            names = ", ".join(f"column{i + 1}" for i in range(len(rows[0])))
            sql = f"SELECT * FROM VALUES {', '.join('(' + ', '.join(r) + ')' for r in rows)} AS _values({names})"
            self._last = Scope({"": self.schema(sql)}, outer)
            return sql
        self.expect("SELECT")
        distinct = "DISTINCT " if self.accept("DISTINCT") else ""
        self.accept("ALL")
        items_at = self.at
        self.skip_to("FROM", "WHERE", "GROUP", "HAVING", "WINDOW", "ORDER", "LIMIT", "OFFSET", *_SET)
        scope, source = Scope(outer=outer), ""
        if self.accept("FROM"):
            source = f" FROM {self.sources(scope)}"
        after = self.at
        saved = self.bare, self.aliases
        self.bare, self.aliases = None, {}
        # the select list, once as it stands
        self.at = items_at
        items = self.items(scope)
        aggregated = any(n.aggregate for n, _, _ in items)
        named = {a.lower(): n for n, a, _ in items if a}
        self.at = after
        where = ""
        if self.accept("WHERE"):
            self.aliases = {a: n for a, n in named.items() if scope.whole() and scope.kind(a) is None and not n.aggregate}
            where = f" WHERE {self.truth(self.expr(scope))}"
            self.aliases = {}
        group, keys = "", None
        if self.accept("GROUP", "BY"):
            keys, texts = set(), []
            simple = True
            while True:
                if self.peek().up in ("CUBE", "ROLLUP", "GROUPING"):
                    simple = False
                    start = self.at
                    self.take()
                    self.accept("SETS")
                    self.expect("(")
                    self.at = self._close(self.at) + 1
                    texts.append(" ".join(t.text for t in self.toks[start : self.at]))
                else:
                    at = self.at
                    n = self.expr(scope)
                    if self.at == at + 1 and self.toks[at].kind == "number":
                        keys.add(items[int(self.toks[at].text) - 1][0].sql)
                    elif n.column and scope.kind(n.column) is None and n.column.lower() in named:
                        keys.add(named[n.column.lower()].sql)
                    keys.add(self.collated(n))
                    texts.append(self.collated(n))
                if not self.accept(","):
                    break
            group = f" GROUP BY {', '.join(texts)}"
            if not simple:
                keys = None
        having_at = self.at
        if self.peek().up == "HAVING":
            self.take()
            self.expr(scope)
            aggregated = True
        having_end = self.at
        having = ""
        if (keys is not None or aggregated) and not self.strict and keys != set():
            self.bare = self.bare_rule(items, keys or set(), scope)
            self.at = items_at
            items = [old if old[0].sql in (keys or ()) else new for old, new in zip(items, self.items(scope), strict=True)]
        if having_end > having_at:
            self.at = having_at + 1
            having = f" HAVING {self.truth(self.expr(scope))}"
        self.bare = saved[0]
        self.at = having_end
        window = ""
        if self.accept("WINDOW"):
            parts = []
            while True:
                w = self.name()
                self.expect("AS")
                self.expect("(")
                parts.append(f"{self.quoted(w)} AS ({self.window(scope)})")
                if not self.accept(","):
                    break
            window = f" WINDOW {', '.join(parts)}"
        sql = f"SELECT {distinct}{', '.join(self._item(*x) for x in items)}{source}{where}{group}{having}{window}"
        self._last = Scope({**scope.tables}, outer)
        self._parts = ([self._item(*x) for x in items], f"{source}{where}{group}{having}{window}", [x[0].sql for x in items], not distinct)
        self.aliases = saved[1]
        return sql

    def _item(self, n: Node, alias: str | None, text: str) -> str:
        if alias:
            return f"{n.sql} AS {self.quoted(alias)}"
        if n.column is not None or n.sql.endswith("*"):
            return n.sql if not n.column or n.sql.endswith(self.quoted(n.column)) else f"{n.sql} AS {self.quoted(n.column)}"
        return f"{n.sql} AS {self.quoted(text)}"

    def items(self, scope: Scope) -> list[tuple[Node, str | None, str]]:
        out = []
        while True:
            start = self.at
            if self.peek().text == "*":
                for alias, table in scope.names.items():
                    self.reads[table] |= set(scope.tables[alias] or ())
                n = Node(self.take().text)
            else:
                n = self.expr(scope)
            text = " ".join(t.text for t in self.toks[start : self.at])
            alias = None
            if self.accept("AS") or (self.peek().kind in ("word", "name") and self.peek().up not in _CLAUSES):
                alias = self.name()
            out.append((n, alias, text))
            if not self.accept(","):
                return out

    def bare_rule(self, items: list, keys: set[str], scope: Scope) -> Callable[[Node], str]:
        """How a column that is neither grouped nor aggregated is read: from the row of the
        only min or max, else from any row of the group."""
        best = [m for n, _, _ in items for m in re.findall(r"(?<![\w`])(min|max)\(((?:`[^`]*`\.)?`[^`]*`)\)", n.sql)]

        def read(n: Node) -> str:
            if n.sql in keys or scope.kind(n.column or "", None) is None:
                return n.sql
            if len(set(best)) == 1:
                return f"{best[0][0]}_by({n.sql}, {best[0][1]})"
            return f"any_value({n.sql})"

        return read

    def skip_to(self, *words: str) -> None:
        depth = 0
        while self.peek().kind != "end":
            t = self.peek()
            if not depth and ((t.up in words and not (t.up == "FROM" and self.toks[self.at - 1].up == "DISTINCT" and self.toks[self.at - 2].up in ("IS", "NOT"))) or t.text in (")", ";")):
                return
            depth += (t.text == "(") - (t.text == ")")
            self.at += 1

    def names(self) -> list[str]:
        out = [self.name()]
        while self.accept(","):
            out.append(self.name())
        self.expect(")")
        return out

    def sources(self, scope: Scope) -> str:
        out = self.source(scope)
        while True:
            if self.accept(","):
                out += ", " + self.source(scope)
                continue
            words = []
            while self.peek().up in ("NATURAL", "LEFT", "RIGHT", "FULL", "INNER", "CROSS", "OUTER", "SEMI", "ANTI"):
                words.append(self.take().up)
            if not self.accept("JOIN"):
                if words:
                    raise ValueError("JOIN is expected")
                return out
            out += f" {' '.join([*words, 'JOIN'])} {self.source(scope)}"
            if self.accept("ON"):
                out += f" ON {self.truth(self.expr(scope))}"
            elif self.accept("USING"):
                self.expect("(")
                out += f" USING ({', '.join(map(self.quoted, self.names()))})"

    def source(self, scope: Scope) -> str:
        lateral = "LATERAL " if self.accept("LATERAL") else ""
        if self.accept("("):
            if self.peek().up in ("SELECT", "WITH", "VALUES", "("):
                body = self.statement(scope if lateral else scope.outer or Scope())
                self.expect(")")
                cols = self.schema(body)
                sql = f"({body})"
            else:
                inner = Scope(outer=scope.outer)
                sql = f"({self.sources(inner)})"
                self.expect(")")
                scope.tables.update(inner.tables)
                scope.names.update(inner.names)
                return sql
        elif self.peek(1).text == "(" and self.peek().up in ("GENERATE_SERIES", "UNNEST", "JSON_EACH"):
            what = self.take().up
            self.take()
            args = self.list(scope)
            body, cols = self.table_function(what, args)
            lateral, sql = "LATERAL ", f"({body})"
            if not scope.tables:
                lateral = ""
        elif self.peek(1).text == "(" and self.peek().kind == "word":
            name = self.take().text
            self.take()
            sql = f"{name}({', '.join(n.sql for n in self.list(scope))})"
            cols = self.schema(f"SELECT * FROM {sql}")
        else:
            table = self.name()
            while self.accept("."):
                table += "." + self.name()
            key = table.lower()
            if key in self.renamed:
                cols, sql = self.ctes[key], self.quoted(self.renamed[key])
            elif key in self.ctes:
                cols, sql = self.ctes[key], self.quoted(table)
            else:
                sql = ".".join(map(self.quoted, table.split(".")))
                cols = self.schema(f"SELECT * FROM {sql}")
                if cols is None:
                    raise ValueError(f"no such table: {table}")
            alias = table.split(".")[-1]
            if self.accept("AS") or (self.peek().kind in ("word", "name") and self.peek().up not in _CLAUSES | {"SEMI", "ANTI", "OUTER"}):
                alias = self.name()
            scope.tables[alias] = cols
            if key not in self.ctes:
                scope.names[alias] = table
                self.reads.setdefault(table, set())
            return f"{lateral}{sql} AS {self.quoted(alias)}" if alias.lower() != key or key in self.renamed else sql
        alias = f"_t{self.free}"
        self.free += 1
        if self.accept("AS") or (self.peek().kind in ("word", "name") and self.peek().up not in _CLAUSES):
            alias = self.name()
        names = None
        if self.accept("("):
            names = self.names()
            cols = dict(zip([n.lower() for n in names], cols.values(), strict=True)) if cols else None
        scope.tables[alias] = cols
        return f"{lateral}{sql} AS {self.quoted(alias)}{self._cols(names)}"

    @staticmethod
    def table_function(what: str, args: list[Node]) -> tuple[str, dict[str, str]]:
        if what == "GENERATE_SERIES":
            a, b, step = [f"CAST({n.sql} AS BIGINT)" for n in (*args, *([Node("1")] if len(args) < 3 else []))]
            ok = f"({step} > 0 AND {a} <= {b}) OR ({step} < 0 AND {a} >= {b})"
            return f"SELECT explode(CASE WHEN {ok} THEN sequence({a}, {b}, {step}) ELSE CAST(array() AS ARRAY<BIGINT>) END) AS value", {"value": "int"}
        if what == "JSON_EACH":
            return f"SELECT explode(variant_get(parse_json({args[0].sql}), '$', 'ARRAY<STRING>')) AS value", {"value": "text"}
        return f"SELECT explode({args[0].sql}) AS unnest", {"unnest": "other"}

    # -- expressions

    def list(self, scope: Scope) -> list[Node]:
        """Expressions up to the closing parenthesis."""
        out: list[Node] = []
        if self.accept(")"):
            return out
        while True:
            out.append(self.expr(scope))
            if self.accept(")"):
                return out
            self.expect(",")

    def ordering(self, scope: Scope, select: tuple | None = None, hidden: list[str] | None = None) -> str:
        """Sort keys. Spark sorts by no SQL function, so such a key becomes a column: that of
        the select list, or a hidden one."""
        parts = []
        while True:
            n = self.expr(scope)
            text = self.collated(n)
            if select and "ml_" in text:
                same = [i for i, x in enumerate(select[2]) if x == text]
                if same:
                    text = str(same[0] + 1)
                elif hidden is not None and select[3]:
                    hidden.append(text)
                    text = f"_order{len(hidden) - 1}"
            desc = self.accept("DESC")
            self.accept("ASC")
            nulls = None
            if self.accept("NULLS"):
                nulls = self.take().up
            # NULL is the smallest value
            default = ("LAST" if desc else "FIRST") if not self.strict else ("FIRST" if desc else "LAST")
            parts.append(f"{text} {'DESC' if desc else 'ASC'} NULLS {nulls or default}")
            if not self.accept(","):
                return ", ".join(parts)

    def collated(self, n: Node, name: str | None = None) -> str:
        name = n.collation or name
        if not name or name.upper() == "BINARY":
            return n.sql
        return sqlfunctions.collation_key(self.spark, name, n.sql)

    def truth(self, n: Node) -> str:
        if n.kind in ("int", "real"):
            return f"({n.sql} <> 0)"
        if n.kind == "text":
            return f"(ml_real({n.sql}) <> 0)"
        return n.sql

    def expr(self, scope: Scope) -> Node:
        left = self.conjunction(scope)
        while self.accept("OR"):
            left = self.both("OR", left, self.conjunction(scope))
        return left

    def conjunction(self, scope: Scope) -> Node:
        left = self.negation(scope)
        while self.accept("AND"):
            left = self.both("AND", left, self.negation(scope))
        return left

    def both(self, op: str, a: Node, b: Node) -> Node:
        return Node(f"({self.truth(a)} {op} {self.truth(b)})", "bool", aggregate=a.aggregate or b.aggregate)

    def negation(self, scope: Scope) -> Node:
        if self.peek().up == "NOT" and self.peek(1).up != "EXISTS":
            self.take()
            n = self.negation(scope)
            return Node(n.opposite or f"(NOT {self.truth(n)})", "bool", aggregate=n.aggregate)
        return self.equality(scope)

    def equality(self, scope: Scope) -> Node:
        left = self.comparison(scope)
        while True:
            t, agg = self.peek(), left.aggregate
            if t.text in ("=", "==", "!=", "<>"):
                self.take()
                if self.peek().up in ("ANY", "ALL", "SOME") and self.peek(1).text == "(":
                    left = self.quantified(left, t.text, scope)
                    continue
                right = self.comparison(scope)
                left = self.compare(left, "=" if t.text in ("=", "==") else "<>", right)
            elif t.up == "IS":
                self.take()
                no = self.accept("NOT")
                if self.accept("DISTINCT", "FROM"):
                    right = self.comparison(scope)
                    left = Node(f"({'' if no else 'NOT '}({left.sql} <=> {right.sql}))", "bool", aggregate=agg or right.aggregate)
                elif self.accept("NULL"):
                    left = Node(f"({left.sql} IS {'NOT ' if no else ''}NULL)", "bool", aggregate=agg)
                else:
                    right = self.comparison(scope)
                    a, b = (self.truth(left), right.sql) if right.kind == "bool" else (left.sql, right.sql)
                    left = Node(f"({'NOT ' if no else ''}({a} <=> {b}))", "bool", aggregate=agg or right.aggregate)
            elif t.up in ("ISNULL", "NOTNULL"):
                self.take()
                left = Node(f"({left.sql} IS {'NOT ' if t.up == 'NOTNULL' else ''}NULL)", "bool", aggregate=agg)
            elif t.up == "NOT" and self.peek(1).up == "NULL":
                self.at += 2
                left = Node(f"({left.sql} IS NOT NULL)", "bool", aggregate=agg)
            elif t.up in ("IN", "LIKE", "ILIKE", "GLOB", "REGEXP", "RLIKE", "MATCH", "BETWEEN") or (t.up == "NOT" and self.peek(1).up in ("IN", "LIKE", "ILIKE", "GLOB", "REGEXP", "RLIKE", "MATCH", "BETWEEN")):
                no = self.accept("NOT")
                made = self.predicate(self.take().up, left, scope)
                left = Node(made.opposite or f"(NOT {made.sql})", "bool", aggregate=agg or made.aggregate) if no else replace(made, aggregate=agg or made.aggregate)
            elif t.text in ("~", "!~", "~*", "!~*"):
                self.take()
                right = self.comparison(scope)
                flags = "(?si)" if "*" in t.text else "(?s)"
                left = Node(f"({'NOT ' if t.text[0] == '!' else ''}({left.sql} RLIKE concat('{flags}', {right.sql})))", "bool", aggregate=agg)
            else:
                return left

    def compare(self, a: Node, op: str, b: Node) -> Node:
        agg = a.aggregate or b.aggregate
        if a.row and b.query and not b.row:
            same = f"(({', '.join(x.sql for x in a.row)}) IN {b.sql})"
            if op not in ("=", "<>"):
                raise ValueError("row values and subqueries compare by = only")
            return Node(same if op == "=" else f"(NOT {same})", "bool", aggregate=agg)
        if a.row or b.row:
            if not (a.row and b.row) or len(a.row) != len(b.row):
                raise ValueError("row values of different sizes")
            if op in ("=", "<>"):
                same = " AND ".join(self.compare(x, "=", y).sql for x, y in zip(a.row, b.row, strict=True))
                return Node(f"({same})" if op == "=" else f"(NOT ({same}))", "bool", aggregate=agg)
            x, y = a.row[-1], b.row[-1]
            out = self.compare(x, op, y).sql
            for x, y in zip(a.row[-2::-1], b.row[-2::-1], strict=True):
                out = f"({self.compare(x, op[0], y).sql} OR ({self.compare(x, '=', y).sql} AND {out}))"
            return Node(out, "bool", aggregate=agg)
        name = a.collation or b.collation
        left, right = self.collated(a, name), self.collated(b, name)
        # a number and a text are never equal by accident: numbers are compared as numbers where the text is one
        if {a.kind, b.kind} in ({"int", "text"}, {"real", "text"}) and not name:
            left, right = (f"ml_numeric({left})", right) if a.kind == "text" else (left, f"ml_numeric({right})")
        return Node(f"({left} {op} {right})", "bool", aggregate=agg)

    def quantified(self, left: Node, op: str, scope: Scope) -> Node:
        any_ = self.take().up != "ALL"
        self.expect("(")
        op = {"==": "=", "!=": "<>"}.get(op, op)
        if self.peek().up in ("SELECT", "WITH", "VALUES"):
            body = self.statement(scope)
            self.expect(")")
            if any_ and op == "=":
                return Node(f"({left.sql} IN ({body}))", "bool")
            if not any_ and op == "<>":
                return Node(self.not_member(left, body, scope) or f"({left.sql} NOT IN ({body}))", "bool")
            raise ValueError(f"{op} ANY/ALL over a query is not supported")
        items = self.expr(scope)
        self.expect(")")
        return Node(f"{'exists' if any_ else 'forall'}({items.sql}, _x -> {left.sql} {op} _x)", "bool", aggregate=left.aggregate)

    def predicate(self, word: str, left: Node, scope: Scope) -> Node:
        if word == "BETWEEN":
            lo = self.comparison(scope)
            self.expect("AND")
            hi = self.comparison(scope)
            return Node(f"({self.compare(left, '>=', lo).sql} AND {self.compare(left, '<=', hi).sql})", "bool", aggregate=lo.aggregate or hi.aggregate)
        if word == "IN":
            return self.member(left, scope)
        right = self.comparison(scope)
        if word in ("LIKE", "ILIKE"):
            escape = self.comparison(scope).value if self.accept("ESCAPE") else "\\" if self.strict else None
            fold = word == "ILIKE" or not self.strict
            x = f"ml_nocase({left.sql})" if fold else left.sql
            if left.kind not in ("text", "other"):
                x = x.replace(left.sql, f"CAST({left.sql} AS STRING)")
            if right.value is not None:
                pattern = right.value.translate(str.maketrans(strings.UPPER, strings.LOWER)) if fold else right.value
                if fold and escape:
                    escape = escape.translate(str.maketrans(strings.UPPER, strings.LOWER))
                return Node(f"({x} RLIKE {literal(predicates._like_regex(pattern, escape))})", "bool")
            if escape:
                return Node(f"({x} LIKE {f'ml_nocase({right.sql})' if fold else right.sql} ESCAPE {literal(escape)})", "bool")
            return Node(f"({x} LIKE {f'ml_nocase({right.sql})' if fold else right.sql} ESCAPE '\\u0001')", "bool")
        if word == "GLOB":
            if right.value is None:
                raise ValueError("GLOB takes a literal pattern")
            return Node(f"({left.sql} RLIKE {literal(predicates.glob_regex(right.value))})", "bool")
        if word == "MATCH":
            if right.value is None:
                raise ValueError("MATCH takes a literal query")
            table = left.column and next((c for a, c in scope.tables.items() if a.lower() == left.column.lower() and c), None)
            cols = {c: self.quoted(c) for c, k in table.items() if k == "text"} if table else {left.column or "": left.sql}
            return Node(search.match_text(cols, right.value), "bool")
        return Node(f"({left.sql} RLIKE concat('(?s)', {right.sql}))", "bool")

    def member(self, left: Node, scope: Scope) -> Node:
        if not self.accept("("):
            table = self.name()  # x IN table
            body = f"SELECT * FROM {self.quoted(self.renamed.get(table.lower(), table))}"
            return Node(f"({left.sql} IN ({body}))", "bool", opposite=self.not_member(left, body, scope))
        if self.peek().up in ("SELECT", "WITH", "VALUES"):
            body = self.statement(Scope(outer=scope))
            self.expect(")")
            x = f"({', '.join(n.sql for n in left.row)})" if left.row else left.sql
            return Node(f"({x} IN ({body}))", "bool", opposite=self.not_member(left, body, scope))
        values = self.list(scope)
        if not values:
            return Node("false", "bool")  # even for NULL
        if left.row or left.collation or any(v.kind != left.kind and {v.kind, left.kind} & {"text"} and "null" not in (v.kind, left.kind) for v in values):
            return Node("(" + " OR ".join(self.compare(left, "=", v).sql for v in values) + ")", "bool")
        return Node(f"({left.sql} IN ({', '.join(v.sql for v in values)}))", "bool", aggregate=any(v.aggregate for v in values))

    def not_member(self, left: Node, body: str, scope: Scope) -> str | None:
        """NOT IN a query, which Spark joins by a nested loop inside OR, and there without the
        third value. Here an equi-join finds the matches, and one aggregate row tells whether
        the query has rows and NULLs. None, so that NOT IN stays, where the query is correlated
        or might give other rows when it is read twice, and where types or names of the left
        side would not mean the same inside the query."""
        if left.row or left.collation or left.aggregate or re.search(r"(?i)\b(SELECT|OVER|rand|uuid|shuffle)|->", left.sql):
            return None
        above, own = scope.outer, any(cols and (left.column or "").lower() in cols for cols in scope.tables.values())
        while above and not own:
            if above.tables:
                return None
            above = above.outer
        try:
            got = self.spark.sql(" ".join([*self._with(), body]), self.bound or None)
        except AnalysisException:  # correlated
            return None
        kinds = {left.kind, *(kind_of(f.dataType.simpleString()) for f in got.schema)}
        plan = got._jdf.queryExecution().analyzed()
        if len(got.schema) != 1 or not (len(kinds) == 1 or kinds == {"int", "real"}) or not plan.deterministic() or re.search(r"Limit|Offset|Sample", plan.toString()):
            return None
        keys = f"({body}) AS _in(_in_key)"
        facts = f"(SELECT CASE WHEN count(*) = 0 THEN 0 WHEN count(*) = count(_in_key) THEN 1 ELSE 2 END FROM {keys})"
        return f"(CASE WHEN EXISTS (SELECT 1 FROM {keys} WHERE _in_key = {left.sql}) THEN false WHEN {facts} > CASE WHEN {left.sql} IS NULL THEN 0 ELSE 1 END THEN NULL ELSE true END)"

    def comparison(self, scope: Scope) -> Node:
        left = self.bits(scope)
        while self.peek().text in ("<", "<=", ">", ">="):
            op = self.take().text
            if self.peek().up in ("ANY", "ALL", "SOME") and self.peek(1).text == "(":
                left = self.quantified(left, op, scope)
            else:
                left = self.compare(left, op, self.bits(scope))
        return left

    def number(self, n: Node) -> str:
        return f"ml_real({n.sql})" if n.kind == "text" else f"CAST({n.sql} AS INT)" if n.kind == "bool" else n.sql

    def bits(self, scope: Scope) -> Node:
        left = self.sum(scope)
        while self.peek().text in ("&", "|", "<<", ">>"):
            op, right = self.take().text, self.sum(scope)
            a, b = (f"CAST({self.number(n)} AS BIGINT)" for n in (left, right))
            text = f"ml_shift_left({a}, {b})" if op == "<<" else f"ml_shift_left({a}, -{b})" if op == ">>" else f"({a} {op} {b})"
            left = Node(text, "int", aggregate=left.aggregate or right.aggregate)
        return left

    def sum(self, scope: Scope) -> Node:
        left = self.product(scope)
        while self.peek().text in ("+", "-"):
            op, right = self.take().text, self.product(scope)
            left = self.arithmetic(left, op, right)
        return left

    def product(self, scope: Scope) -> Node:
        left = self.joined(scope)
        while self.peek().text in ("*", "/", "%"):
            op, right = self.take().text, self.joined(scope)
            left = self.arithmetic(left, op, right)
        return left

    def arithmetic(self, a: Node, op: str, b: Node) -> Node:
        agg = a.aggregate or b.aggregate
        x, y = self.number(a), self.number(b)
        whole = all(n.kind in ("int", "bool", "null") for n in (a, b))
        if op in "+-*":
            kind = "int" if whole else "real" if {a.kind, b.kind} <= {"int", "real", "text", "null"} else a.kind if a.kind not in ("int", "real") else b.kind
            return Node(f"({x} {op} {y})", kind, aggregate=agg)
        if op == "/":
            if whole:
                text = f"({x} div {y})"
                return Node(text if self.strict or re.fullmatch(r"[1-9]\d*", y) else f"(CASE WHEN {y} <> 0 THEN {text} END)", "int", aggregate=agg)
            return Node(f"(CAST({x} AS DOUBLE) / CAST({y} AS DOUBLE))" if self.strict else f"try_divide(CAST({x} AS DOUBLE), CAST({y} AS DOUBLE))", "real", aggregate=agg)
        if self.strict:
            return Node(f"({x} % {y})", "int" if whole else "real", aggregate=agg)
        if whole:
            return Node(f"try_mod({x}, {y})", "int", aggregate=agg)
        return Node(f"CAST(try_mod(CAST({x} AS BIGINT), CAST({y} AS BIGINT)) AS DOUBLE)", "real", aggregate=agg)

    def joined(self, scope: Scope) -> Node:
        left = self.collate(scope)
        while self.peek().text in ("||", "->", "->>"):
            op, right = self.take().text, self.collate(scope)
            agg = left.aggregate or right.aggregate
            if op == "||":
                left = Node(f"concat({self.as_text(left)}, {self.as_text(right)})", "text", aggregate=agg)
            else:
                left = Node(f"ml_json_arrow{'_text' if op == '->>' else ''}({left.sql}, {right.sql})", "text", aggregate=agg)
        return left

    @staticmethod
    def as_text(n: Node) -> str:
        if n.kind == "bool":
            return f"CAST(CAST({n.sql} AS INT) AS STRING)"
        return n.sql if n.kind == "text" else f"CAST({n.sql} AS STRING)"

    def collate(self, scope: Scope) -> Node:
        n = self.unary(scope)
        while self.accept("COLLATE"):
            n = replace(n, collation=self.name())
        return n

    def unary(self, scope: Scope) -> Node:
        t = self.peek()
        if t.text in ("-", "+", "~"):
            self.take()
            n = self.unary(scope)
            if t.text == "+":
                return n
            return Node(f"({t.text}{self.number(n)})", n.kind if t.text == "-" and n.kind in ("int", "real") else "int" if t.text == "~" else "real" if n.kind == "text" else n.kind, aggregate=n.aggregate)
        n = self.primary(scope)
        while True:
            if self.accept("::"):
                n = self.cast(n, self.type_name())
            elif self.peek().text == "[":
                self.take()
                i = self.expr(scope)
                self.expect("]")
                n = Node(f"get({n.sql}, {i.sql} - 1)", "other", aggregate=n.aggregate)
            else:
                return n

    def type_name(self) -> str:
        out = self.take().text
        while self.peek().kind == "word" and self.peek().up in ("PRECISION", "VARYING", "UNSIGNED"):
            out += " " + self.take().text
        if self.peek().text in ("(", "<"):
            depth, opens, closes = 0, "(<", ")>"
            while True:
                t = self.take().text
                out += t if t != "," else ", "
                depth += sum(t.count(c) for c in opens) - sum(t.count(c) for c in closes)
                if depth <= 0:
                    break
        return out

    def cast(self, n: Node, declared: str) -> Node:
        up = declared.upper()
        if up.split("(")[0].split("<")[0].strip() in ("DATE", "TIMESTAMP", "BOOLEAN", "BOOL", "ARRAY", "MAP", "STRUCT", "VARIANT", "DECIMAL", "BINARY", "STRING") or self.strict:
            spark = {"BOOL": "BOOLEAN", "TEXT": "STRING", "VARCHAR": "STRING", "BLOB": "BINARY", "BYTEA": "BINARY", "REAL": "DOUBLE", "INTEGER": "BIGINT", "INT8": "BIGINT", "FLOAT8": "DOUBLE", "DOUBLE PRECISION": "DOUBLE", "NUMERIC": "DECIMAL(38, 18)"}.get(up, declared)
            return Node(f"CAST({n.sql} AS {spark})", kind_of(spark.lower().split("(")[0]), aggregate=n.aggregate)
        kind = casts.affinity(declared)
        if kind == "INTEGER":
            text = f"ml_integer({n.sql})" if n.kind == "text" else f"ml_whole(CAST({n.sql} AS DOUBLE))" if n.kind == "real" else f"CAST({n.sql} AS BIGINT)"
            return Node(text, "int", aggregate=n.aggregate)
        if kind == "REAL":
            return Node(f"ml_real({n.sql})" if n.kind == "text" else f"CAST({n.sql} AS DOUBLE)", "real", aggregate=n.aggregate)
        if kind == "TEXT":
            return Node(self.as_text(n), "text", aggregate=n.aggregate)
        if kind == "BLOB":
            return Node(f"CAST({self.as_text(n)} AS BINARY)", "blob", aggregate=n.aggregate)
        return Node(f"ml_numeric({n.sql})" if n.kind == "text" else n.sql, "real" if n.kind == "text" else n.kind, aggregate=n.aggregate)

    def primary(self, scope: Scope) -> Node:
        t = self.peek()
        if t.kind == "number":
            self.take()
            if t.text[:2].lower() == "0x":
                return Node(str(int(t.text, 16)), "int")
            if t.text[-1] in "dD":
                return Node(t.text, "real")
            if re.fullmatch(r"\d+", t.text):
                return Node(t.text, "int") if int(t.text) < 1 << 63 else Node(f"{t.text}D", "real")
            return Node(f"{t.text}D" if not t.text.endswith(".") else f"{t.text}0D", "real")
        if t.kind == "text":
            self.take()
            value = t.text[1:-1].replace("''", "'")
            return Node(literal(value), "text", value=value)
        if t.kind == "blob":
            self.take()
            return Node(f"X{t.text[1:]}", "blob")
        if t.kind == "param":
            return self.parameter(self.take().text)
        if t.text == "(":
            self.take()
            if self.peek().up in ("SELECT", "WITH", "VALUES"):
                body = self.statement(Scope(outer=scope))
                self.expect(")")
                cols = self.schema(body)
                return Node(f"({body})", next(iter(cols.values())) if cols and len(cols) == 1 else "other", query=True)
            items = self.list(scope)
            if len(items) == 1:
                return replace(items[0], sql=items[0].sql if items[0].sql.startswith("(") and self.balanced(items[0].sql) else f"({items[0].sql})", column=None)
            return Node(f"named_struct({', '.join(f'{literal(str(i))}, {n.sql}' for i, n in enumerate(items))})", "row", row=items, aggregate=any(n.aggregate for n in items))
        if t.kind in ("word", "name"):
            return self.word(scope)
        raise ValueError(f"unexpected {t.text!r}")

    @staticmethod
    def balanced(sql: str) -> bool:
        depth = 0
        for i, ch in enumerate(sql):
            depth += (ch == "(") - (ch == ")")
            if not depth:
                return i == len(sql) - 1
        return False

    def parameter(self, text: str) -> Node:
        if isinstance(self.params, dict):
            key = text[1:]
            if key not in self.params:
                raise ValueError(f"no value for {text}")
            value = self.params[key]
        else:
            digits = text[1:]
            if text[0] == ":" or (digits and not digits.isdigit()):
                raise ValueError(f"no value for {text}")
            i = int(digits) - 1 if digits else self.count
            if not digits:
                self.count += 1
            if self.params is None or not 0 <= i < len(self.params):
                raise ValueError(f"no value for parameter {i + 1}")
            key, value = f"p{i}", self.params[i]
        self.bound[key] = value
        kind = "bool" if isinstance(value, bool) else "int" if isinstance(value, int) else "real" if isinstance(value, float) else "text" if isinstance(value, str) else "null" if value is None else "other"
        return Node("NULL" if value is None else f":{key}", kind, value=value if isinstance(value, str) else None)

    count = 0

    def word(self, scope: Scope) -> Node:
        t = self.peek()
        up = t.up if t.kind == "word" else ""
        if up in ("NULL", "TRUE", "FALSE"):
            self.take()
            return Node(up, "null" if up == "NULL" else "bool")
        if up in ("CURRENT_TIMESTAMP", "CURRENT_DATE", "CURRENT_TIME") and self.peek(1).text != "(":
            self.take()
            form = {"CURRENT_TIMESTAMP": "yyyy-MM-dd HH:mm:ss", "CURRENT_DATE": "yyyy-MM-dd", "CURRENT_TIME": "HH:mm:ss"}[up]
            return Node(f"date_format(current_timestamp(), '{form}')", "text")
        if up in ("DATE", "TIMESTAMP") and self.peek(1).kind == "text":
            self.take()
            return Node(f"{up} {self.take().text}", up.lower())
        if up == "INTERVAL" and self.peek(1).kind in ("text", "number"):
            self.take()
            return Node(f"INTERVAL {self.take().text} {self.take().text}", "interval")
        if up in ("NOT", "EXISTS"):
            no = self.accept("NOT")
            self.expect("EXISTS")
            self.expect("(")
            body = self.statement(Scope(outer=scope))
            self.expect(")")
            return Node(f"({'NOT ' if no else ''}EXISTS ({body}))", "bool")
        if up == "CASE":
            return self.case(scope)
        if up in ("CAST", "TRY_CAST") and self.peek(1).text == "(":
            self.at += 2
            n = self.expr(scope)
            self.expect("AS")
            declared = self.type_name()
            self.expect(")")
            return Node(f"TRY_CAST({n.sql} AS {declared})", kind_of(declared.lower()), aggregate=n.aggregate) if up == "TRY_CAST" else self.cast(n, declared)
        if up == "ARRAY" and self.peek(1).text == "[":
            self.at += 2
            items = []
            while not self.accept("]"):
                items.append(self.expr(scope))
                self.accept(",")
            return Node(f"array({', '.join(n.sql for n in items)})", "array", aggregate=any(n.aggregate for n in items))
        if self.peek(1).text == "(" and t.kind == "word":
            return self.call(scope)
        name = self.name()
        table, column = (name, self.peek(1).text.strip('"`')) if self.peek().text == "." else (None, name)
        home = scope.home(column, table)
        if home:
            self.reads[home].add(column)
        if self.accept("."):
            if self.accept("*"):
                if name in scope.names:
                    self.reads[scope.names[name]] |= set(scope.tables[name] or ())
                return Node(f"{self.quoted(name)}.*")
            column = self.name()
            kind = scope.kind(column, name)
            n = Node(f"{self.quoted(name)}.{self.quoted(column)}", kind or "other", column=column)
            while self.accept("."):
                n = Node(f"{n.sql}.{self.quoted(self.name())}", "other", column=column)
        else:
            kind = scope.kind(name)
            if kind is None and name.lower() in self.aliases:
                return replace(self.aliases[name.lower()], column=None)
            n = Node(self.quoted(name), kind or "other", column=name)
        if self.bare and not self.inside:
            return replace(n, sql=self.bare(n))
        return n

    def case(self, scope: Scope) -> Node:
        self.take()
        on = None if self.peek().up == "WHEN" else self.expr(scope)
        parts, kinds, agg = [], [], bool(on and on.aggregate)
        while self.accept("WHEN"):
            test = self.expr(scope)
            self.expect("THEN")
            value = self.expr(scope)
            parts.append(f"WHEN {self.compare(on, '=', test).sql if on else self.truth(test)} THEN {value.sql}")
            kinds.append(value.kind)
            agg |= test.aggregate or value.aggregate
        if self.accept("ELSE"):
            value = self.expr(scope)
            parts.append(f"ELSE {value.sql}")
            kinds.append(value.kind)
            agg |= value.aggregate
        self.expect("END")
        return Node(f"CASE {' '.join(parts)} END", self.common(kinds), aggregate=agg)

    @staticmethod
    def common(kinds: list[str]) -> str:
        rest = {k for k in kinds if k != "null"}
        return rest.pop() if len(rest) == 1 else "real" if rest and rest <= {"int", "real"} else "other"

    # -- calls

    def call(self, scope: Scope) -> Node:
        name = self.take().text.lower()
        self.take()
        if name == "position":
            part = self.sum(scope)
            self.expect("IN")
            whole = self.sum(scope)
            self.expect(")")
            return Node(f"ml_instr({whole.sql}, {part.sql})", "int", aggregate=part.aggregate or whole.aggregate)
        if name == "extract":
            word = self.take().text
            self.expect("FROM")
            n = self.expr(scope)
            self.expect(")")
            return Node(f"extract({word} FROM {n.sql})", "int", aggregate=n.aggregate)
        aggregate = name in _AGGREGATES or name in getattr(self.spark, "_ml_aggregates", ())
        star, distinct, order, args = False, False, "", []
        self.inside += aggregate
        if self.accept("*"):
            star = True
        else:
            distinct = self.accept("DISTINCT")
            while self.peek().text != ")" and self.peek().up not in ("ORDER", "SEPARATOR"):
                if self.peek(1).text == "->" or (self.peek().text == "(" and any(self.peek(i).text == "->" for i in (3, 4, 5))):
                    args.append(self.function_of(scope))
                else:
                    args.append(self.expr(scope))
                if not self.accept(","):
                    break
            if self.accept("ORDER", "BY"):
                order = self.ordering(scope)
            if self.accept("SEPARATOR"):
                args.append(self.expr(scope))
        self.expect(")")
        filtered = ""
        if self.accept("FILTER"):
            self.expect("(")
            self.expect("WHERE")
            filtered = self.truth(self.expr(scope))
            self.expect(")")
        self.inside -= aggregate
        if name in ("min", "max") and len(args) > 1:
            aggregate = False
        over = None
        if self.accept("OVER"):
            if self.accept("("):
                over = f" OVER ({self.window(scope)})"
            else:
                over = f" OVER {self.quoted(self.name())}"
        n = self.made(name, args, star, distinct, order, filtered, over or "")
        return replace(n, aggregate=(aggregate and over is None) or any(a.aggregate for a in args))

    def function_of(self, scope: Scope) -> Node:
        """A lambda: its names are nobody's columns."""
        names = []
        if self.accept("("):
            names = self.names()
        else:
            names = [self.name()]
        self.expect("->")
        inner = Scope({"": {n.lower(): "other" for n in names}}, scope)
        self.inside += 1
        body = self.expr(inner)
        self.inside -= 1
        left = self.quoted(names[0]) if len(names) == 1 else f"({', '.join(map(self.quoted, names))})"
        return Node(f"{left} -> {body.sql}")

    def window(self, scope: Scope) -> str:
        parts = []
        if self.peek().kind in ("word", "name") and self.peek().up not in ("PARTITION", "ORDER", "ROWS", "RANGE", "GROUPS"):
            raise ValueError("a window cannot extend a named one")
        if self.accept("PARTITION", "BY"):
            keys = [self.collated(self.expr(scope))]
            while self.accept(","):
                keys.append(self.collated(self.expr(scope)))
            parts.append(f"PARTITION BY {', '.join(keys)}")
        if self.accept("ORDER", "BY"):
            parts.append(f"ORDER BY {self.ordering(scope)}")
        if self.peek().up in ("GROUPS",):
            raise ValueError("GROUPS frames: use operators.windows.groups_frame")
        frame = []
        while self.peek().text != ")":
            t = self.take()
            if t.up == "EXCLUDE":
                if self.accept("NO", "OTHERS"):
                    continue
                raise ValueError("EXCLUDE: use operators.windows.exclude")
            frame.append(t.text)
        self.expect(")")
        return " ".join([*parts, *frame])

    def made(self, name: str, args: list[Node], star: bool, distinct: bool, order: str, filtered: str, over: str) -> Node:
        a = [n.sql for n in args]
        kinds = [n.kind for n in args]
        if over and filtered and name in _AGGREGATES:
            # Spark takes no FILTER here; these aggregates skip NULL
            if star:
                return Node(f"count(CASE WHEN {filtered} THEN 1 END){over}", "int")
            args = [replace(args[0], sql=f"(CASE WHEN {filtered} THEN {a[0]} END)"), *args[1:]]
            return self.made(name, args, star, distinct, order, "", over)
        if over and distinct:
            found = f"array_compact(collect_set({a[0]}){over})"
            if name == "count":
                return Node(f"CAST(size({found}) AS BIGINT)", "int")
            if name in ("sum", "avg", "total"):
                zero = "0D" if kinds[0] != "int" or name != "sum" else "0L"
                total = f"aggregate({found}, {zero}, (s, v) -> s + v)"
                return Node(total if name == "total" else f"(CASE WHEN size({found}) > 0 THEN {total}{f' / size({found})' if name == 'avg' else ''} END)", "int" if zero == "0L" else "real")
            if name in ("group_concat", "string_agg"):
                return Node(f"(CASE WHEN size({found}) > 0 THEN array_join(sort_array({found}), {a[1] if len(a) > 1 else literal(',')}) END)", "text")
            distinct = False  # makes no difference to the others
        tail = (f" FILTER (WHERE {filtered})" if filtered else "") + over
        unique = "DISTINCT " if distinct else ""
        if star:
            return Node(f"{name}(*){tail}", "int")
        if name == "total":
            return Node(f"coalesce(sum({unique}CAST({self.number(args[0])} AS DOUBLE)){tail}, 0.0D)", "real")
        if name in ("group_concat", "string_agg"):
            by = f" WITHIN GROUP (ORDER BY {order})" if order else ""
            return Node(f"listagg({unique}{self.as_text(args[0])}, {a[1] if len(a) > 1 else literal(',')}){by}{tail}", "text")
        if name == "array_agg" and not over:
            if order and "," not in order:
                key, way = order.rsplit(" NULLS ", 1)[0].rsplit(" ", 1)
                items = f"transform(array_sort(collect_list(named_struct('k', {key}, 'v', {a[0]})){tail}, (l, r) -> CASE WHEN l.k <=> r.k THEN 0 WHEN l.k IS NULL OR l.k < r.k THEN {-1 if way == 'ASC' else 1} ELSE {1 if way == 'ASC' else -1} END), s -> s.v)"
            else:
                items = f"transform({'collect_set' if distinct else 'collect_list'}(named_struct('v', {a[0]})){tail}, s -> s.v)"
            return Node(f"(CASE WHEN count(*){tail} > 0 THEN {items} END)", "array")
        if name in ("min", "max") and len(a) > 1:
            known = " AND ".join(f"{x} IS NOT NULL" for x in a)
            return Node(f"(CASE WHEN {known} THEN {'least' if name == 'min' else 'greatest'}({', '.join(a)}) END)", self.common(kinds))
        if name in ("sum", "avg") and kinds and kinds[0] in ("text", "bool"):
            return Node(f"{name}({unique}{self.number(args[0])}){tail}", "real" if kinds[0] == "text" else "int")
        special = sqlfunctions.call(self.spark, name, args, self.strict)
        if special is not None:
            return Node(special[0], special[1])
        spark_name = {"every": "bool_and", "ifnull": "coalesce", "character_length": "char_length"}.get(name, name)
        if name in _INT:
            kind = "int"
        elif name in _REAL:
            kind = "real"
        elif name in _BOOL:
            kind = "bool"
        elif name in _SAME:
            kind = self.common(kinds[:1] if name in ("lag", "lead", "nth_value", "max_by", "min_by", "nullif") else kinds)
        else:
            kind = "other"
        return Node(f"{spark_name}({unique}{', '.join(a)}){tail}", kind)
