"""Receipts, maps, lenses, parking, frames and the connection: what their queries leave out."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import windows
from millrace.plans import dbapi
from millrace.plans.engine import Engine
from millrace.streaming import cdc, lens, maps, receipts


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_receipts(spark, tmp_path):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string")
    store = receipts.Receipts(spark, str(tmp_path))
    name = store.begin("dump", 2)
    store.rows(name, 0, target.where("k = 1"))
    with pytest.raises(ValueError, match="staged"):
        store.finish(name, target, ["k"])
    again = receipts.Receipts(spark, str(tmp_path))
    assert again.staged(name) == [0]
    again.rows(name, 1, spark.createDataFrame([(1, "later"), (9, "new")], "k long, v string"))
    assert rows(again.finish(name, target, ["k"]).table) == [(1, "later"), (9, "new")]
    again.abandon(name)
    with pytest.raises(ValueError, match="no such receipt"):
        again.rows(name, 0, target)
    assert rows(store.finish(store.begin("delta"), target, ["k"]).table) == rows(target)
    with pytest.raises(ValueError, match="dump"):
        receipts.check_edges(["webhook", "delta"])
    assert [s.dump for s in receipts.check_edges(["webhook", "page_cursor", "probe_fetch"])] == [False, True, False]
    with pytest.raises(ValueError):
        receipts.check_edges(["guess"])


def test_resolving_a_deleted_row(spark):
    target = spark.createDataFrame([(1, "mine"), (2, "mine")], "k long, v string")
    conflicts = spark.createDataFrame([(1, "delete", ("a",), None), (2, "update", ("b",), ("there",))], "k long, op string, old struct<v: string>, new struct<v: string>")
    out, left = receipts.resolve(target, conflicts, spark.createDataFrame([(1, "source"), (7, "local")], "k long, take string"), ["k"])
    assert rows(out) == [(2, "mine")] and [r["k"] for r in left.collect()] == [2]
    with pytest.raises(ValueError):
        receipts.resolve(target, conflicts, spark.createDataFrame([(1, None)], "k long, take string"), ["k"])
    assert len(rows(receipts.open_conflicts(conflicts, conflicts.where("k = 1"), ["k"]))) == 2


def test_bounded_runs_do_not_lose_later_changes(spark):
    source = spark.createDataFrame([(k, k * 10) for k in range(6)], "k long, v long")
    journal = spark.createDataFrame([(s, "update", k) for s, k in enumerate([0, 1, 2, 0, 3, 4, 9], 1)], maps.JOURNAL + ", k long")
    target, cursor, taken, runs = source.limit(0), 0, [], 0
    done = False
    while not done:
        step = maps.run(source, target, journal, ["k"], lambda d: d, cursor, 2)
        target, cursor, done, runs = spark.createDataFrame(step.target.collect(), source.schema), step.cursor, step.done, runs + 1
        taken += [r["k"] for r in step.keys.collect()]
    assert sorted(taken) == [0, 1, 2, 3, 4, 9] and runs == 3 and rows(target) == [(k, k * 10) for k in range(5)]
    assert maps.run(source, target, journal.limit(0), ["k"], lambda d: d).done


def test_lens_ledger_and_lossy(spark):
    df = spark.createDataFrame([(1, "Ab"), (2, None)], "k long, s string")
    applied = lens.apply(lens.LOWER, df, "s", ["k"])
    ledger = lens.log(lens.log(spark.createDataFrame([], lens.LEDGER), lens.LOWER, applied, "s"), lens.LOWER, applied, "s", "check")
    assert [r["action"] for r in ledger.orderBy("seq").collect()] == ["apply", "check"] and lens.untouched(ledger, applied)
    edited = lens.putback(lens.LOWER, applied, spark.createDataFrame([(2, "x")], "k long, s string"), "s", ["k"])
    assert rows(lens.revert(lens.LOWER, edited, "s", ["k"])) == [(1, "Ab"), (2, "x")] and not lens.untouched(ledger, edited)
    with pytest.raises(ValueError, match="not in the table"):
        lens.putback(lens.LOWER, applied, spark.createDataFrame([(5, "x")], "k long, s string"), "s", ["k"])
    with pytest.raises(ValueError, match="lossy"):
        lens.putback(lens.FIRST_WORD, lens.apply(lens.FIRST_WORD, df, "s", ["k"]), df, "s", ["k"])


def test_parking(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    feed = [(1, "x", 1, "insert"), (2, None, 2, "delete"), (3, "n", 3, "insert"), (3, "m", 4, "update"), (4, "z", 5, "update"), (5, "q", 6, "merge"), (None, "w", 7, "insert")]
    out, parked = cdc.apply_parking(target, spark.createDataFrame(feed, "k long, v string, version long, op string"), ["k"], "version")
    assert rows(out) == [(1, "a"), (3, "m")]
    assert {(r["k"], r["reason"]) for r in parked.collect()} == {(1, "key exists"), (4, "no such key"), (5, "unknown operation"), (None, "null key")}


def test_frames_refuse(spark):
    df = spark.createDataFrame([(1, 1, None), (2, 1, 5)], "id long, g long, x long")
    got = windows.exclude(df, ["g"], "g", ("rows", -1, 1), "current row", {"a": ("array_agg", "x"), "s": ("sum", "x"), "c": ("group_concat", "x"), "f": ("first_value", "x")}, ["id"])
    assert rows(got.drop("g", "x")) == [(1, [5], 5, "5", 5), (2, [None], None, None, None)]
    for bad in (("rows", "everything", "sum"), ("cells", "ties", "sum"), ("rows", "ties", "median")):
        with pytest.raises(ValueError):
            windows.exclude(df, ["g"], "g", (bad[0], -1, 1), bad[1], {"s": (bad[2], "x")}, ["id"])


def test_connection(spark, tmp_path):
    con = dbapi.connect(spark, str(tmp_path / "db"))
    con.executescript("CREATE TABLE t (k INTEGER PRIMARY KEY, v TEXT); INSERT INTO t VALUES (1, 'a;b')")
    with pytest.raises(dbapi.IntegrityError):
        con.execute("INSERT INTO t VALUES (1, 'again')")
    with pytest.raises(dbapi.IntegrityError):
        con.executemany("INSERT INTO t VALUES (?, ?)", [(2, "b"), (1, "c")])
    assert con.execute("SELECT k, v FROM t").fetchall() == [(1, "a;b")] and not con.in_transaction
    con.create_function("dbl", lambda x: None if x is None else 2 * x, "bigint")
    assert list(con.execute("SELECT dbl(k) FROM t")) == [(2,)]
    con.execute("BEGIN")
    assert con.execute("DELETE FROM t").rowcount == 1
    con.rollback()
    assert con.execute("SELECT count(*) FROM t").fetchone() == (1,) and "INSERT" in "".join(con.iterdump())
    with pytest.raises(dbapi.ProgrammingError):
        con.cursor().fetchone()
    with pytest.raises(dbapi.ProgrammingError):
        con.execute("SELECT nothing FROM nowhere")
    con.close()
    with pytest.raises(dbapi.ProgrammingError):
        con.execute("SELECT 1")


def test_access_sees_names_not_text(spark):
    e = Engine(spark)
    e.register("a", spark.createDataFrame([(1, 2)], "x long, y long"))
    e.register("b", spark.createDataFrame([(1, 2)], "x long, z long"))
    assert e.access("SELECT 'b' FROM a q WHERE q.x = 1 /* b.z */") == {"a": ["x"]}
    assert e.access("SELECT * FROM a WHERE y IN (SELECT z FROM b)") == {"a": ["x", "y"], "b": ["z"]}


KINDS = ["current row", "group", "no others", "ties"]


@pytest.mark.parametrize("kind", KINDS)
def test_frames_of_whole_peer_groups_gather_no_rows(spark, kind):
    data = [(i, i % 7 % 3, None if i % 11 == 0 else i * i % 6, None if i % 5 == 0 else i * 37 % 23) for i in range(60)]
    df = spark.createDataFrame(data, "id long, p int, o int, x int")
    aggs = {f: (f, "x") for f in ("count", "sum", "min", "max", "avg", "first_value", "last_value")}
    for name, low, high in (("range", -2, 1), ("groups", -1, 1), ("range", 1, 2), ("groups", -2, -1), ("range", 0, 0)):
        for column, of in (("o", int), ("h", float)):
            d = df.withColumn("h", F.col("o").cast("double"))
            got = windows.exclude(d, ["p"], column, (name, low, high), kind, aggs, ["id"])
            if of is int or name == "groups":
                assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
            want = []
            for i, p, o, _ in data:
                rows_ = sorted((r for r in data if r[1] == p), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
                keys = list(dict.fromkeys(r[2] for r in rows_))
                near = {k for k in keys if (low <= keys.index(k) - keys.index(o) <= high if name == "groups" else k == o if None in (k, o) else low <= k - o <= high)}
                left = [r for r in rows_ if r[2] in near and (kind == "no others" or r[0] != i if kind in ("no others", "current row") else r[2] != o or (kind == "ties" and r[0] == i))]
                xs = [r[3] for r in left if r[3] is not None]
                want.append((i, len(xs), *((sum(xs), min(xs), max(xs), sum(xs) / len(xs)) if xs else (None,) * 4), *((left[0][3], left[-1][3]) if left else (None, None))))
            assert rows(got.select("id", *aggs)) == sorted(want, key=repr)


ROWS_KINDS = ["group", "no others", "current row", "ties"]


@pytest.mark.parametrize("kind", ROWS_KINDS)
@pytest.mark.parametrize("down", [False, True])
def test_frames_of_rows_gather_no_rows(spark, kind, down):
    data = [(i, i % 7 % 3, None if i % 11 == 0 else i * i % 6, None if i % 5 == 0 else i * 37 % 23) for i in range(60)]
    df = spark.createDataFrame(data, "id long, p int, o int, x int")
    aggs = {f: (f, "x") for f in ("count", "sum", "min", "max", "avg", "first_value", "last_value")}
    for low, high in ((-3, 1), (-2, -1), (1, 4), (0, 0), (-6, 9), (-20, 20)):
        got = windows.exclude(df, ["p"], "o", ("rows", low, high), kind, aggs, ["id"], down)
        if high - low < 16 or kind in ("no others", "current row"):
            assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
        want = []
        for i, p, o, _ in data:
            rows_ = sorted((r for r in data if r[1] == p), key=lambda r: ((r[2] is None) == down, -(r[2] or 0) if down else r[2] or 0, r[0]))
            at = [r[0] for r in rows_].index(i)
            near = rows_[max(0, at + low) : max(0, at + high + 1)]
            left = [r for r in near if kind == "no others" or (r[0] != i if kind == "current row" else r[2] != o or (kind == "ties" and r[0] == i))]
            xs = [r[3] for r in left if r[3] is not None]
            want.append((i, len(xs), *((sum(xs), min(xs), max(xs), sum(xs) / len(xs)) if xs else (None,) * 4), *((left[0][3], left[-1][3]) if left else (None, None))))
        assert rows(got.select("id", *aggs)) == sorted(want, key=repr)


@pytest.mark.parametrize("kind", KINDS)
def test_averages_round_as_those_of_the_sql(spark, tmp_path, kind):
    import duckdb

    from millrace.plans.queries import ORACLE_SQL, QUERIES

    name = f"win_exclude_any_{kind.replace(' ', '_')}"
    spark.createDataFrame([(4000070201 + d, "b", 2 if d == 9 else 1) for d in (-4, -3, -2, -1, 0, 1, 2, 3, 9)], "p_partkey long, p_brand string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    assert rows(QUERIES[name](spark, str(tmp_path))) == sorted(con.execute(ORACLE_SQL[name]).fetchall(), key=repr)
