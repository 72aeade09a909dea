"""Random expressions of the dialect against the embedded database of Python's own library."""

import random
import sqlite3

import pytest

from millrace.plans.engine import Engine

ROWS = [(1, 5, 2.5, "abc", "12"), (2, -7, 0.25, "ABC", "x"), (3, None, None, None, "-3.5"), (4, 0, -1.75, "", "7up"), (5, 12, 100.0, "a_b%c", " 9"), (6, 3, 0.0, "éa", None)]


class Maker:
    """Expressions with the type they have; booleans are compared as 0 and 1."""

    def __init__(self, seed):
        self.r = random.Random(seed)

    def num(self, depth):
        r = self.r
        if depth <= 0 or r.random() < 0.2:
            return r.choice(["a", "id", "b", str(r.randint(-9, 9)), str(r.choice([0.5, 1.25, -2.75, 3.0]))])
        kind = r.randrange(12)
        x, y = lambda: self.num(depth - 1), lambda: self.int(depth - 1)
        if kind < 4:
            return f"({x()} {r.choice('+-*')} {x()})"
        if kind == 4:
            return f"({x()} / {x()})"
        if kind == 5:
            return self.int(depth)
        if kind == 6:
            return f"CASE WHEN {self.bool(depth - 1)} THEN {x()} ELSE {x()} END"
        if kind == 7:
            return f"abs({x()})"
        if kind == 8:
            return f"coalesce({x()}, {x()})"
        if kind == 9:
            return f"round({x()})"
        if kind == 10:
            return f"nullif({x()}, {x()})"
        return f"(- {x()})"

    def int(self, depth):
        r = self.r
        if depth <= 0 or r.random() < 0.2:
            return r.choice(["a", "id", str(r.randint(-9, 9))])
        kind = r.randrange(9)
        i = lambda: self.int(depth - 1)
        if kind < 2:
            return f"({i()} {r.choice('+-*')} {i()})"
        if kind == 2:
            return f"({i()} / {i()})"
        if kind == 3:
            return f"({i()} % {i()})"
        if kind == 4:
            return f"({i()} {r.choice(['&', '|'])} {i()})"
        if kind == 5:
            return f"(({i()}) << {r.randint(0, 5)})"
        if kind == 6:
            return f"length({self.text(depth - 1)})"
        if kind == 7:
            return f"instr({self.text(depth - 1)}, {self.text(0)})"
        return f"CAST({self.num(depth - 1)} AS INTEGER)"

    def text(self, depth):
        r = self.r
        if depth <= 0 or r.random() < 0.2:
            return r.choice(["s", "t", "'a'", "'b%'", "'abc'", "''"])
        kind = r.randrange(8)
        t = lambda: self.text(depth - 1)
        if kind == 0:
            return f"({t()} || {t()})"
        if kind == 1:
            return f"substr({t()}, {r.randint(-5, 5)}, {r.randint(-4, 4)})"
        if kind == 2:
            return f"iif({self.bool(depth - 1)}, {t()}, {t()})"
        if kind == 3:
            return f"replace({t()}, 'a', {t()})"
        if kind == 4:
            return f"trim({t()}, 'a ')"
        if kind == 5:
            return f"CASE WHEN {self.bool(depth - 1)} THEN {t()} ELSE {t()} END"
        if kind == 6:
            return f"CAST({self.int(depth - 1)} AS TEXT)"
        return f"coalesce({t()}, {t()})"

    def bool(self, depth):
        r = self.r
        if depth <= 0:
            return r.choice(["a > 2", "b < 1.5", "s = 'abc'", "s IS NULL", "t IS NOT NULL"])
        kind = r.randrange(10)
        n, t, b = lambda: self.num(depth - 1), lambda: self.text(depth - 1), lambda: self.bool(depth - 1)
        if kind == 0:
            return f"({n()} {r.choice(['=', '<>', '<', '<=', '>', '>='])} {n()})"
        if kind == 1:
            return f"({t()} {r.choice(['=', '<>', '<', '>='])} {t()})"
        if kind == 2:
            return f"({b()} {r.choice(['AND', 'OR'])} {b()})"
        if kind == 3:
            return f"(NOT {b()})"
        if kind == 4:
            return f"({n()} {r.choice(['', 'NOT '])}IN ({', '.join(n() for _ in range(r.randint(0, 3)))}))"
        if kind == 5:
            return f"({t()} {r.choice(['', 'NOT '])}LIKE '{r.choice(['%', 'a%', '_b_', '%B%', 'A_B%', '', 'abc'])}')"
        if kind == 6:
            return f"({t()} GLOB '{r.choice(['*', 'a*', '?b?', '[a-b]*', '[^a]*', ''])}')"
        if kind == 7:
            return f"({n()} BETWEEN {n()} AND {n()})"
        if kind == 8:
            return f"({n()} IS {r.choice(['', 'NOT '])}{n()})"
        return f"(({n()}, {n()}) {r.choice(['<', '=', '>=', '<>'])} ({n()}, {n()}))"


def plain(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return float(f"{v:.9g}") + 0.0
    return v


@pytest.mark.parametrize("seed", range(6))
def test_expressions(spark, seed):
    engine = Engine(spark)
    engine.register("d", spark.createDataFrame(ROWS, "id long, a long, b double, s string, t string"))
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE d (id INTEGER, a INTEGER, b REAL, s TEXT, t TEXT)")
    con.executemany("INSERT INTO d VALUES (?, ?, ?, ?, ?)", ROWS)
    make = Maker(seed)
    items = [f"{getattr(make, ('num', 'int', 'text', 'bool')[k % 4])(3)} AS c{k}" for k in range(28)]
    test = make.bool(2)
    sql = f"SELECT id, {', '.join(items)} FROM d WHERE {test} ORDER BY id"
    want = [tuple(map(plain, r)) for r in con.execute(sql).fetchall()]
    got = [tuple(map(plain, r)) for r in engine.query(sql).collect()]
    wrong = [(items[j - 1] if j else test, g[j], w[j]) for g, w in zip(got, want) for j in range(len(g)) if g[j] != w[j]]
    assert not wrong and len(got) == len(want), wrong[:3]
