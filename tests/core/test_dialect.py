"""The dialect: what its queries do not show, and what it refuses."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import dml, graph, recursion
from millrace.plans.database import Database, statements
from millrace.plans.engine import Engine
from millrace.sources.catalog import Catalog


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    e.register("t", spark.createDataFrame([(1, "abc", 2.5), (2, "ABC", 0.0), (3, None, None), (4, "x%y", -7.5)], "id long, name string, v double"))
    e.register("u", spark.createDataFrame([(1,), (3,)], "k long"))
    return e


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("SELECT 7/2, 7.0/2, 1/0, 7 % 0, -7/2, -7 % 3, 1<<3, 1<<70, -8>>1", [(3, 3.5, None, None, -3, -1, 8, 0, -4)]),
        ("SELECT 'ABC' LIKE 'abc', 'É' LIKE 'é', 'a\\b' LIKE 'a\\b', 'a%b' LIKE 'a!%b' ESCAPE '!', 'abc' GLOB 'a*', 'Abc' GLOB 'a*'", [(True, False, True, True, True, False)]),
        ("SELECT '5' + 2, 'a' || 1, 1 = '1', 2 > '10', typeof(1.5), 0x1F, 5 ISNULL", [(7.0, "a1", True, False, "real", 31, False)]),
        ("SELECT id FROM t WHERE id IN u ORDER BY id", [(1,), (3,)]),
        ("SELECT id FROM t ORDER BY name COLLATE NOCASE DESC, id LIMIT 2", [(4,), (1,)]),
        ("SELECT id FROM t ORDER BY v LIMIT 1", [(3,)]),
        ("SELECT (1, NULL) = (2, 2), (1, NULL) = (1, 2), (1, 2) IN ((3, 4), (1, 2))", [(False, None, True)]),
        ("SELECT max(v), id FROM t", [(2.5, 1)]),
        ("SELECT max(id), name, count(*) AS n FROM t GROUP BY name COLLATE NOCASE ORDER BY n DESC LIMIT 1", [(2, "ABC", 2)]),
        ("SELECT count(*), total(v), sum(id) / 3 FROM t WHERE name IS NOT NULL", [(3, -5.0, 2)]),
        ("SELECT id / 2 AS h, count(*) AS n FROM t GROUP BY h HAVING n > 1 ORDER BY h", [(1, 2)]),
        ("SELECT 'it''s', 'say :near: x', \"id\" FROM t WHERE id = 1 -- comment ?", [("it's", "say :near: x", 1)]),
        ("SELECT x.s FROM (SELECT name || '!' AS s FROM t) AS x WHERE s MATCH 'abc' ORDER BY s", [("ABC!",), ("abc!",)]),
        ("SELECT CASE WHEN 'x' THEN 1 ELSE 2 END, NOT 3, iif(NULL, 1, 2)", [(2, False, 2)]),
        ("SELECT DISTINCT id % 2 AS p FROM t ORDER BY p", [(0,), (1,)]),
    ],
)
def test_statements(engine, sql, want):
    assert rows(engine.query(sql)) == want


@pytest.mark.parametrize(
    "sql",
    [
        "WITH RECURSIVE r(n) AS (SELECT 1 UNION SELECT count(*) FROM r) SELECT n FROM r", "WITH RECURSIVE r(n) AS (SELECT 1 UNION SELECT a.n FROM r a JOIN r b ON a.n = b.n) SELECT n FROM r",
        "WITH RECURSIVE r(n) AS (SELECT 1 UNION SELECT n FROM r ORDER BY n) SELECT n FROM r", "SELECT (1, 2) < (1, 2, 3)", "SELECT id FROM nowhere", "SELECT id FROM t LIMIT 'x' || NULL", "VALUES (1), (1, 2)", "SELECT id FROM t WHERE name = ?",
    ],
)
def test_refused(engine, sql):
    with pytest.raises(ValueError):
        engine.query(sql)


def test_strict(spark, engine):
    strict = Engine(spark, strict=True)
    strict.register("t", engine.tables["t"])
    assert rows(strict.query("SELECT 'ABC' LIKE 'abc', 'a%' LIKE 'a\\%', 7 / 2")) == [(False, True, 3)]
    for sql in ("SELECT 1 / 0", "SELECT CAST('12abc' AS INTEGER)", "SELECT ln(0)", "SELECT name, count(*) FROM t"):
        with pytest.raises(Exception):  # noqa: B017  Spark's own errors
            strict.query(sql).collect()


def test_two_engines_in_one_session(spark):
    a, b = Engine(spark), Engine(spark)
    a.register("same", spark.range(1))
    b.register("same", spark.range(2))
    assert a.query("SELECT id FROM same").count() == 1 and b.query("SELECT id FROM same").count() == 2


def test_layers_are_no_explosion(spark):
    """Paths multiply by 20 a layer; nodes do not."""
    edges = spark.createDataFrame([(d * 20 + i, (d + 1) * 20 + j) for d in range(16) for i in range(20) for j in range(20)], "src long, dst long")
    got = {r["id"]: r["depth"] for r in graph.reach(edges, spark.createDataFrame([(0,)], "id long")).collect()}
    assert got == {0: 0} | {d * 20 + j: d for d in range(1, 17) for j in range(20)}


def test_many_rows_leave_the_driver(spark, monkeypatch):
    monkeypatch.setattr(recursion, "SMALL", 5)
    out = recursion.fixpoint(spark.createDataFrame([(1, None), (None, 1)], "n long, m long"), lambda new: new.select(((F.col("n") * 7 + 3) % 61).alias("n"), "m"))
    assert out.count() == out.distinct().count() > 20


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Conf:
        @staticmethod
        def get(key, default):
            return default

    class Session:
        sparkContext, conf = Context, Conf

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        recursion.folder(Session, "x")


def test_proposals_in_order(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, u string")
    new = spark.createDataFrame([(9, "a"), (4, "c"), (4, "d"), (5, "d"), (6, None), (7, None)], "id long, u string")
    keep = lambda c: sorted(rows(c.table), key=repr)
    assert keep(dml.insert(t, new, ["id"], "ignore", unique=[["u"]])) == sorted([(1, "a"), (2, "b"), (3, None), (4, "c"), (5, "d"), (6, None), (7, None)], key=repr)
    assert keep(dml.insert(t, new, ["id"], "replace", unique=[["u"]])) == sorted([(2, "b"), (3, None), (9, "a"), (5, "d"), (6, None), (7, None)], key=repr)
    assert keep(dml.insert(t, new.limit(0), ["id"], "replace", unique=[["u"]])) == keep(dml.Change(t, t))


def test_composite_keys_and_raise(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    db.execute("CREATE TABLE p (a INTEGER, b INTEGER, PRIMARY KEY (a, b))")
    db.execute("CREATE TABLE c (id INTEGER PRIMARY KEY, a INTEGER, b INTEGER, FOREIGN KEY (a, b) REFERENCES p (a, b) ON DELETE SET NULL)")
    db.execute("INSERT INTO p VALUES (1, 1), (1, 2)")
    db.execute("INSERT INTO c VALUES (1, 1, 1), (2, 1, 2), (3, 1, NULL)")
    with pytest.raises(ValueError, match="FOREIGN KEY"):
        db.execute("INSERT INTO c VALUES (4, 1, 3)")
    with pytest.raises(ValueError, match="FOREIGN KEY"):
        db.execute("UPDATE p SET b = 9 WHERE b = 2")
    db.execute("DELETE FROM p WHERE b = 2")
    assert sorted(rows(db.query("SELECT * FROM c")), key=repr) == sorted([(1, 1, 1), (2, None, None), (3, 1, None)], key=repr)
    db.execute("CREATE TRIGGER no BEFORE INSERT ON c WHEN NEW.id > 10 BEGIN SELECT RAISE(ABORT, 'too high'); END")
    db.execute("CREATE TRIGGER skip BEFORE INSERT ON c BEGIN SELECT RAISE(IGNORE) WHERE NEW.id = 7; END")
    with pytest.raises(ValueError, match="too high"):
        db.execute("INSERT INTO c VALUES (11, NULL, NULL)")
    assert db.execute("INSERT INTO c VALUES (7, NULL, NULL), (8, NULL, NULL)") == 1
    db.execute("CREATE TABLE log (n INTEGER)")
    db.execute("CREATE TRIGGER undo AFTER DELETE ON c BEGIN INSERT INTO log VALUES (OLD.id); SELECT RAISE(ABORT, 'kept') WHERE OLD.id = 8; END")
    with pytest.raises(ValueError, match="kept"):
        db.execute("DELETE FROM c")
    assert db.query("SELECT count(*) FROM c").first()[0] == 4 and db.query("SELECT count(*) FROM log").first()[0] == 0
    db.execute("CREATE POLICY own ON c USING (id < 3) WITH CHECK (id < 10)")
    db.execute("ALTER TABLE c ENABLE ROW LEVEL SECURITY")
    with pytest.raises(ValueError, match="row-level security"):
        db.execute("INSERT INTO c VALUES (10, NULL, NULL)")
    assert db.query("SELECT count(*) FROM c").first()[0] == 2
    db.execute("DROP POLICY own ON c")
    db.execute("ALTER TABLE c DISABLE ROW LEVEL SECURITY")
    for name in ("no", "skip", "undo"):
        db.execute(f"DROP TRIGGER {name}")
    assert db.execute("DELETE FROM c") == 4
    assert db.execute("DROP TABLE IF EXISTS nothing") is None


def test_strict_upsert_twice(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"), strict=True)
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, n INTEGER)")
    with pytest.raises(ValueError, match="second time"):
        db.execute("INSERT INTO t VALUES (1, 1), (1, 2) ON CONFLICT (id) DO UPDATE SET n = excluded.n")


def test_appends_write_only_new_rows_and_writers_take_turns(spark, tmp_path):
    root = str(tmp_path / "cat")
    one = Catalog(spark, root)
    one.create("t", "id long, s string", pk=["id"])
    one.append("t", spark.createDataFrame([(1, "a"), (2, "b")], "id long, s string"))
    one.append("t", spark.createDataFrame([(3, "c")], "id long, s string"))
    assert len(one.info("t")["versions"][-1]) == 2 and one.table("t").count() == 3 and one.table("t", 0).count() == 2
    with pytest.raises(ValueError, match="unique"):
        one.append("t", spark.createDataFrame([(2, "again")], "id long, s string"))
    two = Catalog(spark, root)
    two.append("t", spark.createDataFrame([(4, "d")], "id long, s string"))
    with pytest.raises(RuntimeError, match="another writer"):
        one.append("t", spark.createDataFrame([(5, "e")], "id long, s string"))
    assert json.loads((tmp_path / "cat" / "catalog.json").read_text())["number"] == two.state["number"]
    again = Catalog(spark, root)
    again.compact("t")
    assert again.table("t").count() == 4 and len(again.info("t")["versions"][-1]) == 1


def test_scripts():
    assert statements("CREATE TABLE t (a TEXT); INSERT INTO t VALUES (';'); CREATE TRIGGER x AFTER INSERT ON t BEGIN DELETE FROM t; SELECT 1; END; SELECT 2") == [
        "CREATE TABLE t (a TEXT)", "INSERT INTO t VALUES (';')", "CREATE TRIGGER x AFTER INSERT ON t BEGIN DELETE FROM t; SELECT 1; END", "SELECT 2",
    ]


def test_a_cascade_is_undone_as_a_whole(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    db.execute("CREATE TABLE p (a INTEGER PRIMARY KEY)")
    db.execute("CREATE TABLE c (id INTEGER PRIMARY KEY, a INTEGER REFERENCES p (a) ON DELETE CASCADE)")
    db.execute("INSERT INTO p VALUES (1), (2)")
    db.execute("INSERT INTO c VALUES (1, 1), (2, 2)")
    db.execute("CREATE TRIGGER stop AFTER DELETE ON c BEGIN SELECT RAISE(ABORT, 'no') WHERE OLD.id = 2; END")
    with pytest.raises(ValueError, match="no"):
        db.execute("DELETE FROM p")
    assert db.query("SELECT (SELECT count(*) FROM p), (SELECT count(*) FROM c)").first()[:] == (2, 2)
    assert db.execute("DELETE FROM p WHERE a = 1") == 1 and db.query("SELECT id FROM c").first()[0] == 2


def test_procedures_and_budgets(spark, tmp_path):
    from millrace.plans.procedures import Budget, Procedures

    db = Database(spark, str(tmp_path / "db"))
    db.execute("CREATE TABLE t (k INTEGER PRIMARY KEY)")
    db.execute("CREATE PROCEDURE two (a integer) AS $$ INSERT INTO t VALUES (:a); INSERT INTO t VALUES (:a + 1) $$")
    assert db.execute("CALL two(1)") == 1
    with pytest.raises(ValueError, match="unique"):
        db.execute("CALL two(0)")  # the second statement clashes; the first is undone
    assert [r[0] for r in Database(spark, str(tmp_path / "db")).query("SELECT k FROM t ORDER BY k").collect()] == [1, 2]
    for bad in ("CALL two()", "CALL three(1)", "CREATE PROCEDURE two (a integer) AS $$ SELECT 1 $$"):
        with pytest.raises(ValueError):
            db.execute(bad)
    db.execute("DROP PROCEDURE two")
    p = Procedures(db, calls=2, rows=3)
    p.create("many", ["n"], lambda e, n: [e.rows("SELECT k FROM t") for _ in range(n)])
    assert len(p.call("many", 1)[0]) == 2
    with pytest.raises(Budget, match="rows"):
        p.call("many", 2)
    p.create("ask", ["n"], lambda e, n: [e.query("SELECT 1") for _ in range(n)])
    with pytest.raises(Budget, match="queries"):
        p.call("ask", 3)


def test_not_in_is_an_equi_join_of_three_values(spark):
    e = Engine(spark)
    e.register("a", spark.createDataFrame([(1, 1), (2, None), (3, 3)], "id long, x int"))
    for ys, want in (([], [True, True, True]), ([1], [False, None, True]), ([1, None], [False, None, None]), ([None], [None, None, None]), ([4], [True, None, True])):
        e.register("b", spark.createDataFrame([(y,) for y in ys], "y long"))
        for no in ("x NOT IN (SELECT y FROM b)", "NOT x IN b", "NOT (x IN (SELECT y FROM b))", "x <> ALL (SELECT y FROM b)"):
            assert [r["z"] for r in e.query(f"SELECT id, {no} AS z FROM a").orderBy("id").collect()] == want
            df = e.query(f"SELECT id FROM a WHERE {no} OR id = 1")
            assert sorted(r[0] for r in df.collect()) == sorted({1} | {i for i, z in enumerate(want, 1) if z})
            assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()
    assert rows(e.query("SELECT id FROM a WHERE x NOT IN (SELECT y FROM b WHERE y > id) OR id = 9")) == [(1,), (3,)]  # correlated
