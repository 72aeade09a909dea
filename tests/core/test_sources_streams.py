import os
import sqlite3
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from millrace.plans.engine import Engine, Macros, compile_pure
from millrace.sources import catalog, csvs, jdbc, sqlite
from millrace.streaming import cdc, events, ingest, lens, sync, tiering

c = F.col


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,zip,x,note\n1,007,1.5,"a, ""q"""\n2,,,\n3,9,2e3,"two\nlines"\n')
    df = csvs.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.dtypes == [("id", "bigint"), ("zip", "string"), ("x", "double"), ("note", "string")]
    assert rows(df) == [(1, "007", 1.5, 'a, "q"'), (2, "", None, ""), (3, "9", 2000.0, "two\nlines")]
    (tmp_path / "b.tsv").write_text("1\t2\n3\t4\n")
    assert rows(csvs.read_csv(spark, str(tmp_path / "b.tsv"))) == [(1, 2), (3, 4)]
    assert csvs.sniff(["a;b", "x;y"]) == (";", False) and csvs.sniff(["a|b", "1|2"]) == ("|", True)


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as con:
        con.execute("create table t (id integer primary key, name varchar(9), v double, b blob, w int)")
        con.executemany("insert into t values (?,?,?,?,?)", [(i, f"n{i}", i / 2, bytes([i % 256]), None if i % 3 else "text") for i in range(1, 500)])
    df = sqlite.read_sqlite(spark, path, "t", 5)
    assert df.dtypes == [("id", "bigint"), ("name", "string"), ("v", "double"), ("b", "binary"), ("w", "bigint")]
    assert df.count() == 499 and df.where("id = 7").first()["name"] == "n7" and df.where("w is not null").count() == 0
    out = str(tmp_path / "y.db")
    assert sqlite.write_sqlite(df.drop("w"), out, "copy") == 499
    back = sqlite.read_sqlite(spark, out, "copy")
    assert sqlite.data_diff(back, df.drop("w")).count() == 0
    good, bad = sqlite.validated(spark.createDataFrame([("1", "x"), ("z", "y"), (None, "w")], "a string, b string"), {"a": "bigint"})
    assert rows(good) == [(1, "x"), (None, "w")] and [r["_bad"] for r in bad.collect()] == [["a"]]


def test_catalog(spark, tmp_path):
    cat = catalog.Catalog(spark, str(tmp_path / "db"))
    cat.create("t", "id int, v int, twice int", pk=["id"], checks=["v > 0"], generated={"twice": "v * 2"})
    make = lambda r: spark.createDataFrame(r, "id int, v int")
    cat.replace("t", make([(1, 5)]))
    assert rows(cat.table("t")) == [(1, 5, 10)]
    for bad in ([(1, 1), (1, 2)], [(None, 1)], [(2, -1)]):
        with pytest.raises(ValueError, match="constraint"):
            cat.replace("t", make(bad))
    cat.begin()
    cat.replace("t", make([(1, 5), (2, 6)]))
    cat.savepoint("s")
    cat.replace("t", make([(3, 1)]))
    cat.rollback("s")
    assert cat.table("t").count() == 2
    cat.rollback()
    assert cat.table("t").count() == 1
    cat.alter("t", add_column=("w", "string", F.lit("z")))
    cat.alter("t", rename_column=("w", "ww"))
    cat.comment("t", "a table")
    again = catalog.Catalog(spark, str(tmp_path / "db"))
    assert again.table("t").columns == ["id", "v", "twice", "ww"] and again.info("t")["comments"][""] == "a table"
    cat.alter("t", rename_to="u")
    cat.attach("other", str(tmp_path / "db"))
    assert spark.sql("select count(*) from other_u").first()[0] == 1
    cat.view("vv", "select id from other_u")
    assert spark.table("vv").count() == 1
    cat.drop_view("vv")
    cat.drop("u")
    cat.drop("u", if_exists=True)
    with pytest.raises(ValueError):
        cat.drop("u")
    df = spark.range(100).select("id", (c("id") % 7).alias("k"))
    catalog.hash_sharded(df, ["k"], 4, str(tmp_path / "shards"))
    assert rows(catalog.read_shard(spark, str(tmp_path / "shards"), 4, k=3)) == rows(df.where("k = 3"))


def test_ingest(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "k int, v string")
    r = spark.createDataFrame([(1, "a"), (2, "B"), (9, "n"), (4, None)], "k int, v string")
    dump = ingest.receive(t, r, ["k"], True)
    assert {x["op"]: x["n"] for x in dump.counts().collect()} == {"unchanged": 2, "update": 1, "delete": 1, "insert": 1}
    assert rows(dump.table) == rows(r)
    delta = ingest.receive(t, r, ["k"], False)
    assert rows(delta.table) == sorted([*map(tuple, r.collect()), (3, "c")], key=repr)
    mine = spark.createDataFrame([(2,), (3,)], "k int")
    local = ingest.receive(t, r, ["k"], True, "local", mine)
    assert rows(local.table) == sorted([(1, "a"), (2, "b"), (3, "c"), (4, None), (9, "n")], key=repr) and local.conflicts.count() == 2
    source = ingest.receive(t, r, ["k"], True, "source", mine)
    assert rows(source.table) == rows(r) and source.conflicts.count() == 2
    with pytest.raises(ValueError):
        ingest.receive(t, r.withColumn("zz", F.lit(1)), ["k"], True)
    marks = spark.createDataFrame([(1, 5), (2, 6), (9, 3)], "k int, cur int")
    verdict = ingest.judge_cursor(dump.changes, marks, ["k"], "cur", 5).first()
    assert tuple(verdict) == (1, 1) and ingest.judge_cursor(dump.changes, marks, ["k"], "cur", None) is None
    assert ingest.next_cursor(marks, "cur", 9) == 9 and ingest.next_cursor(marks.limit(0), "cur") is None
    assert rows(ingest.derived_calls(dump.changes, ["k"], mine)) == [(9,)]
    plan = ingest.plan_budget([{"name": "a", "calls": 5, "bytes": 10, "seconds": 2, "value": 1}, {"name": "b", "calls": 1, "bytes": 1, "seconds": 1, "value": 9}], 5, 100, 10)
    assert [e["name"] for e in plan] == ["b"]


def test_cdc_and_stream(spark, tmp_path):
    feed = spark.createDataFrame([(1, 1, "insert", "a"), (1, 3, "update", "c"), (2, 2, "insert", "b"), (2, 4, "delete", None)], "k int, ver int, op string, v string")
    base = spark.createDataFrame([(2, "old"), (5, "e")], "k int, v string")
    assert rows(cdc.apply(base, feed, ["k"], "ver")) == [(1, "c"), (5, "e")]
    assert rows(cdc.changes_between(base, spark.createDataFrame([(2, "new"), (6, "f")], "k int, v string"), ["k"])) == [(2, "update"), (5, "delete"), (6, "insert")]
    assert rows(cdc.counter(feed.select("k", "op"), ["k"])) == [(1, 1), (2, 0)]
    src, seen = str(tmp_path / "src"), []
    feed.write.parquet(src)
    for _ in range(2):
        stream = spark.readStream.schema(feed.schema).parquet(src)
        q = cdc.listen(stream, c("k") == 1, lambda df, n: seen.append(df.count()), str(tmp_path / "ck"))
        q.awaitTermination(60)
    assert seen == [2]
    ev = spark.createDataFrame([("u", "2024-01-01 00:01:00", 1.0), ("u", "2024-01-01 00:20:00", 2.0), ("u", "2024-01-01 03:00:00", 3.0)], "user string, ts string, v double").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r["n"] for r in events.sessions(ev, "ts", "30 minutes", ["user"]).collect()) == [1, 2]
    assert events.sliding(ev, "ts", "1 hour", "30 minutes", ["user"]).count() == 4
    ev.write.parquet(str(tmp_path / "ev"))
    q = events.tumbling(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev")), "ts", "1 hour", ["user"], "v").writeStream.outputMode("complete").format("memory").queryName("tumbled").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["total"] for r in spark.table("tumbled").collect()) == [3.0, 3.0]


def test_sync_lens_tier(spark, tmp_path):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    last = sync.fingerprint(base, ["k"], "hs").join(sync.fingerprint(base, ["k"], "ht"), "k")
    s = spark.createDataFrame([(1, "A"), (2, "b"), (4, "d")], "k int, v string")
    t = spark.createDataFrame([(1, "a"), (2, "B"), (3, "c")], "k int, v string")
    out = sync.synchronise(s, t, last, ["k"])
    assert rows(out.source) == rows(out.target) == [(1, "A"), (2, "B"), (4, "d")]
    assert {r["state"] for r in sync.check(out.source, out.target, out.hashes, ["k"]).collect()} == {"clean"}
    with pytest.raises(sync.SyncConflict):
        sync.synchronise(s, t.withColumn("v", F.when(c("k") == 1, "Z").otherwise(c("v"))), last, ["k"])
    assert rows(sync.replicate(s, t, base, ["k"], "local")) == [(1, "A"), (2, "B"), (4, "d")]
    x = spark.createDataFrame([(1, 1.005), (2, None), (3, -7.25)], "k int, v double")
    assert lens.verify(lens.CENTS, x, "v").count() == 0 and lens.CENTS.kind == "residual" and lens.REVERSE.kind == "bijective" and lens.FIRST_WORD.kind == "lossy"
    applied = lens.apply(lens.CENTS, x, "v", ["k"])
    assert rows(lens.revert(lens.CENTS, applied, "v", ["k"])) == rows(x) and lens.fsck(applied, ["k"]).count() == 0
    edited = lens.Applied(applied.table.withColumn("v", F.when(c("k") == 3, 100).otherwise(c("v"))), applied.residuals)
    assert rows(lens.revert(lens.CENTS, edited, "v", ["k"]))[2] == (3, 1.0)
    with pytest.raises(ValueError):
        lens.FIRST_WORD.back(c("v"))
    hot = tiering.drain(base, c("k") < 2, str(tmp_path / "cold"), {"part": c("k") % 2})
    assert rows(hot) == [(2, "b"), (3, "c")] and rows(tiering.both_tiers(hot, spark.read.parquet(str(tmp_path / "cold")))) == rows(base)


def test_engine(spark, tmp_path):
    e = Engine(spark)
    spark.createDataFrame([(1, "a?b"), (2, "x"), (3, None)], "k int, v string").write.parquet(str(tmp_path / "t"))
    e.register("t", spark.read.parquet(str(tmp_path / "t")))
    assert rows(e.query("select k from t where v = 'a?b' or k = ?", [3])) == [(1,), (3,)]
    assert rows(e.query("select k from t where k = $2 or k = $1", [1, 2])) == [(1,), (2,)]
    assert rows(e.query("select k from t where k = :x", {"x": 2})) == [(2,)]
    e.setting("ks", [1, 3])
    assert rows(e.query("select k from t where k in (current_setting('ks'))")) == [(1,), (3,)]
    assert "Filter" in e.explain("select k from t where k > 1") and e.access("select k from t where k > 1") == {"t": ["k"]}
    assert [r[0] for r in e.stream("select k from t order by k")] == [1, 2, 3]
    e.secure("t", "k < current_setting('top')")
    e.setting("top", 2)
    assert rows(e.query("select k from t")) == [(1,)]
    assert rows(e.with_check("t", spark.createDataFrame([(1, "a"), (5, "b")], "k int, v string"))) == [(5, "b")]
    m = Macros()
    m.define(":gap:", "abs({left} - {right})")
    assert m.expand("select a :gap: b") == "select (abs(a - b))" and m.expand("select a :gap: b :gap: c").count("abs(") == 2
    e.create_function("plus_one", lambda x: None if x is None else x + 1, "bigint")
    assert rows(e.query("select plus_one(k) from t")) == [(2,)]
    e.create_aggregate("mid", lambda xs: float(sorted(x for x in xs if x is not None)[0]), "double")
    assert rows(e.query("select mid(id) from range(3, 9)")) == [(3.0,)]
    name, fn = compile_pure("def f(a):\n    s = 0\n    for i in range(a):\n        s += i\n    return s")
    assert name == "f" and fn(5) == 10
    for bad in ("import os", "def f(a):\n    return a.__class__", "def f(a):\n    return open(a)", "def f(a):\n    return _tick", "x = 1"):
        with pytest.raises(ValueError):
            compile_pure(bad)
    with pytest.raises(RuntimeError):
        compile_pure("def g(a):\n    while True:\n        a += 1\n", 100)[1](1)


def test_derby_archive(spark, tmp_path):
    schema = "k long, s string, x double"
    df = spark.createDataFrame([(1, "a,\"b'\n", 1.5), (2, "", None), (3, None, -0.1), (9, "é", 1e300)], schema).repartition(3)
    url = jdbc.write_derby(df, str(tmp_path / "t.jar"), "t")
    for keyed in ((), ("k", 1, 9, 4)):
        assert rows(jdbc.read_jdbc(spark, url, "t", *keyed, driver=jdbc.DERBY)) == rows(df)
    none = jdbc.write_derby(df.where("k > 9"), str(tmp_path / "none.jar"), "t")
    assert not jdbc.read_jdbc(spark, none, "t", "k", None, None, driver=jdbc.DERBY).count()


def test_jdbc_round_trip_between_processes(tmp_path):
    """Executors of their own see no database of the driver's memory."""
    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("the driver's tables are not here")
    code = f"""
from pyspark.sql import SparkSession
from millrace.plans.queries import QUERIES
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.checkpoint.dir", "{tmp_path}/shared").getOrCreate()
got = QUERIES["jdbc_round_trip"](spark, "{data}")
want = spark.read.parquet("{data}/orders.parquet").select(*got.columns)
print("ROWS", got.count(), got.exceptAll(want).count(), want.exceptAll(got).count())
"""
    here = Path(__file__).resolve().parents[2]
    env = os.environ | {"PYTHONPATH": f"{here}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"}
    env.pop("PYSPARK_GATEWAY_PORT", None)
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=tmp_path, env=env)
    assert "ROWS 1500 0 0" in done.stdout, done.stderr[-2000:]
