import random
import sqlite3
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import aggregates, constraints, dml, graph, joins, knn, recursion, routing, search, series, sets, sorting, windows

c = F.col


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_series(spark):
    assert [r[0] for r in series.generate_series(spark, 1, 7, 3).collect()] == [1, 4, 7]
    assert series.generate_series(spark, 1, 0).count() == 0 and series.generate_series(spark, None, 3).count() == 0
    with pytest.raises(ValueError):
        series.generate_series(spark, 1, 2, 0)
    df = spark.createDataFrame([([1, 2],), ([],)], "a array<int>")
    assert [r["i"] for r in series.subscripts(df, c("a")).collect()] == [1, 2]


def test_joins(spark):
    a = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    for right, want in (([(1,)], [(2,)]), ([(1,), (None,)], []), ([], [(1,), (2,), (None,)])):
        assert rows(joins.not_in(a, "k", spark.createDataFrame(right, "r int"), "r")) == sorted(want, key=repr)
    p = spark.createDataFrame([(0.5,), (3.0,), (9.0,), (None,)], "x double")
    iv = spark.createDataFrame([(0.0, 4.0, "a"), (3.0, 3.0, "b"), (5.0, 4.0, "c"), (None, 1.0, "d")], "lo double, hi double, n string")
    assert rows(joins.range_join(p, iv, "x", "lo", "hi", 2.0).select("x", "n")) == [(0.5, "a"), (3.0, "a"), (3.0, "b")]
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 2, "p"), (1, 5, "q"), (1, 7, "r")], "k int, t int, v string")
    assert rows(joins.asof_join(left, right, ["k"], "t", ["v"])) == sorted([(1, 5, "q"), (1, 1, None), (2, 9, None)], key=repr)
    assert joins.natural(a, spark.createDataFrame([(1, 2)], "k int, z int")).columns == ["k", "z"]


def test_aggregates(spark):
    df = spark.createDataFrame([(1, 1, "b", 5), (1, 2, None, 7), (1, 3, "a", 7), (2, 4, None, None), (2, 5, "z", None)], "g int, pk int, s string, v int")
    got = {r["g"]: r for r in df.groupBy("g").agg(aggregates.total(c("v")).alias("t"), aggregates.group_concat(c("s"), c("pk")).alias("gc"), aggregates.array_agg(c("s"), c("pk")).alias("aa"), aggregates.bare_with_max("pk", "v", "pk").alias("bm"), aggregates.bare_with_min("pk", "v", "pk").alias("bn"), aggregates.bare_first("s", "pk").alias("bf"), aggregates.filtered(F.count, c("s"), c("pk") > 1).alias("f")).collect()}
    assert tuple(got[1])[1:] == (19.0, "b,a", ["b", None, "a"], 2, 1, "b", 1)
    assert tuple(got[2])[1:] == (0.0, "z", [None, "z"], 5, 5, None, 1)
    e = df.limit(0).agg(aggregates.total(c("v")).alias("t"), aggregates.group_concat(c("s"), c("pk")).alias("g"), aggregates.array_agg(c("s"), c("pk")).alias("a")).first()
    assert tuple(e) == (0.0, None, None)


def test_window_frames(spark):
    rng = random.Random(3)
    data = [(i, rng.randint(0, 2), rng.randint(0, 4), rng.choice([None, 1, 2, 5])) for i in range(60)]
    df = spark.createDataFrame(data, "pk int, p int, o int, x int")
    con = sqlite3.connect(":memory:")
    con.execute("create table t(pk, p, o, x)")
    con.executemany("insert into t values (?,?,?,?)", data)
    got = rows(windows.groups_frame(df, ["p"], [c("o")], -1, 0, {"s": F.sum("x")}).select("pk", "s"))
    assert got == sorted(con.execute("select pk, sum(x) over (partition by p order by o groups between 1 preceding and current row) from t"), key=repr)
    for kind in ("no others", "current row", "group", "ties"):
        for lo, hi in ((-2, 2), (1, 3), (-3, -1)):
            side = lambda n: f"{abs(n)} {'preceding' if n < 0 else 'following'}"
            got = rows(windows.exclude_sum_count(df, ["p"], "o", (lo, hi), "x", kind, ["pk"]).select("pk", "sum", "count"))
            want = con.execute(f"select pk, sum(x) over w, count(x) over w from t window w as (partition by p order by o, pk rows between {side(lo)} and {side(hi)})").fetchall()
            if kind != "no others":
                n = {}
                part = {}
                for pk, p, o, x in sorted(data, key=lambda r: (r[1], r[2], r[0])):
                    part.setdefault(p, []).append((pk, o, x))
                for seq in part.values():
                    for i, (pk, o, x) in enumerate(seq):
                        keep = [seq[j] for j in range(max(0, i + lo), min(len(seq), i + hi + 1)) if not (kind == "current row" and j == i or kind == "group" and seq[j][1] == o or kind == "ties" and seq[j][1] == o and j != i)]
                        v = [k[2] for k in keep if k[2] is not None]
                        n[pk] = (sum(v) if v else None, len(v))
                want = [(k, *v) for k, v in n.items()]
            assert got == sorted(want, key=repr), (kind, lo, hi)


def test_sets_limits_recursion(spark):
    a, b, d = (spark.createDataFrame([(x,) for x in v], "x int") for v in ([1, 2, 2, None], [2, 3], [None, 3, 2]))
    assert rows(sets.compound(a, ("union", b), ("intersect", d))) == sorted([(None,), (3,), (2,)], key=repr)
    assert rows(sets.compound(a, ("except", b))) == sorted([(1,), (None,)], key=repr)
    with pytest.raises(TypeError):
        sets.compound(a, ("union", spark.createDataFrame([("x",)], "x string")))
    assert sorting.limit_offset(a, -1, 0).count() == 4 and sorting.limit_offset(a, 1, 3).count() == 1
    start = spark.createDataFrame([(1, 0)], "n int, d int")
    got = recursion.fixpoint(start, lambda f: f.select(((c("n") * 2) % 11).alias("n"), (c("d") + 1).alias("d")), key=["n"])
    assert rows(got) == sorted([((2**k) % 11, k) for k in range(10)], key=repr)
    with pytest.raises(RuntimeError):
        recursion.fixpoint(spark.createDataFrame([(1,)], "n int"), lambda f: f.select((c("n") + 1).alias("n")), max_steps=3)


def test_graph_and_routing(spark):
    rng = random.Random(1)
    e = {(rng.randrange(14), rng.randrange(14)) for _ in range(45)}
    df = spark.createDataFrame(sorted(e), "src long, dst long")
    und = {tuple(sorted(x)) for x in e if x[0] != x[1]}
    want = [(a, b, d) for a in range(14) for b in range(a, 14) for d in range(b, 14) if {(a, b), (b, d), (a, d)} <= und]
    assert rows(graph.triangles(df)) == sorted(want, key=repr)
    depth, edge = {0: 0}, [0]
    while edge:
        edge = [d for s in edge for a, d in e if a == s and d not in depth and not depth.update({d: depth[s] + 1})]
    assert rows(graph.reach(df, spark.range(0, 1))) == sorted(depth.items(), key=repr)
    cost = np.array([[abs(i - j) * 3 + (i * 7 + j * 5) % 4 for j in range(7)] for i in range(7)], float)
    best = min((sum(cost[a, b] for a, b in zip((0, *p), p)), (0, *p)) for p in permutations(range(1, 7)))[0]
    total, order = routing.held_karp(cost)
    assert total == best and sorted(order) == list(range(7))
    m = spark.createDataFrame([("r", i, j, float(cost[i, j])) for i in range(7) for j in range(7) if i != j], "route string, src long, dst long, cost double")
    assert routing.sequence(m, "route").first()["total"] == best


def test_search_and_knn(spark):
    docs = spark.createDataFrame([(1, "Café society", "x"), (2, "the cafe", "society"), (3, None, "THE END"), (4, "thesis cafe", "")], "id int, a string, b string")
    index = search.postings(docs, "id", ["a", "b"])
    ask = lambda q: [r[0] for r in search.match(index, q).orderBy("docid").collect()]
    assert ask("cafe") == [1, 2, 4] and ask("CAFÉ society") == [1, 2] and ask("a:society") == [1] and ask("{a b}:the*") == [2, 3, 4]
    assert ask("^the*") == [2, 3, 4] and ask("the OR society NOT x") == [2, 3] and ask("(the OR thesis) AND cafe") == [2, 4] and ask("^society") == [2]
    for bad in ("(a", "a )", "AND", '"two words"'):
        with pytest.raises(ValueError):
            search.parse_match(bad)
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, None), (3, [0.0, 0.5]), (4, [0.0, 0.5])], "id int, v array<float>")
    assert [r["id"] for r in knn.nearest(df, "v", [0.0, 0.4], 3, "id").collect()] == [2, 3, 4]
    assert [r["id"] for r in knn.nearest(df, "v", [0.0, 0.4], 2, "id", where=c("id") != 3, keep_null=False).collect()] == [4, 1]


def test_dml(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", None)], "id long, s string, n int")
    new = spark.createDataFrame([(2, "x", 5), (None, "auto", 6), (None, "auto2", 7)], "id long, s string, n int")
    got = rows(dml.insert(t, new, ["id"], "ignore", autofill="id").table)
    assert got[:2] == [(1, "a", 1), (2, "b", None)] and {r[0] for r in got} == {1, 2, 3, 4}
    assert rows(dml.insert(t, new.where("id = 2"), ["id"], "replace").table)[1] == (2, "x", 5)
    with pytest.raises(Exception, match="UNIQUE"):
        dml.insert(t, new.where("id = 2"), ["id"]).table.collect()
    two = spark.createDataFrame([(9, "p", 1), (9, "q", 2)], "id long, s string, n int")
    assert rows(dml.insert(t, two, ["id"], "replace", order=[c("n")]).affected) == [(9, "q", 2)]
    assert rows(dml.insert(t, two, ["id"], "ignore", order=[c("n")]).affected) == [(9, "p", 1)]
    up = dml.upsert(t, spark.createDataFrame([(2, "x", 5), (3, "y", 1)], "id long, s string, n int"), ["id"], {"n": c("excluded.n") + 1}, c("t.n").isNull())
    assert rows(up.table) == [(1, "a", 1), (2, "b", 6), (3, "y", 1)] and up.affected.count() == 2
    assert rows(dml.update(t, [("n", F.lit(0)), ("n", c("n") + 1)], c("n") > 0).table) == [(1, "a", 2), (2, "b", None)]
    out = dml.delete(t, c("n") > 0)
    assert rows(out.table) == [(2, "b", None)] and rows(out.affected) == [(1, "a", 1)]


def test_constraints(spark):
    p = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, None)], "id int, parent int")
    ch = spark.createDataFrame([(10, 3), (11, 4), (12, None), (13, 99)], "k int, pid int")
    assert rows(constraints.foreign_key(ch, ["pid"], p, ["id"])) == [(13, 99)]
    fks = [constraints.ForeignKey("p", "parent", "p", "id", "cascade"), constraints.ForeignKey("c", "pid", "p", "id", "set null")]
    out = constraints.delete_cascade({"p": p, "c": ch}, fks, "p", p.where("id = 1"))
    assert rows(out.tables["p"]) == [(4, None)] and rows(out.tables["c"]) == sorted([(10, None), (11, 4), (12, None), (13, 99)], key=repr)
    with pytest.raises(ValueError):
        constraints.delete_cascade({"p": p, "c": ch}, [constraints.ForeignKey("c", "pid", "p", "id")], "p", p.where("id = 3"))
    assert constraints.unique(p, ["parent"]).count() == 0 and constraints.not_null(p, "parent").count() == 2
    assert constraints.check(p, c("parent") < 2).count() == 1
