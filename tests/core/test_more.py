import io
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.functions import collation, strict
from millrace.operators import triggers
from millrace.plans import model, procedures
from millrace.plans.engine import Engine
from millrace.streaming import objects, tasks

c = F.col


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_collations(spark):
    df = spark.createDataFrame([("b",), ("A",), ("a ",), ("É",)], "x string")
    collation.register("backwards", lambda s: s[::-1])
    assert [r[0] for r in df.orderBy(collation.collate(c("x"), "nocase")).collect()] == ["A", "a ", "b", "É"]
    assert [r[0] for r in df.orderBy(collation.collate(c("x"), "backwards")).collect()] == ["a ", "A", "b", "É"]
    assert df.where(collation.equals(c("x"), F.lit("a"), "RTRIM")).count() == 1
    with pytest.raises(ValueError):
        collation.collate(c("x"), "zzz")


def test_strict(spark):
    df = spark.createDataFrame([(4.0, "a_b"), (None, None)], "x double, s string")
    assert rows(df.select(strict.sqrt(c("x")), strict.like(c("s"), "a\\_b"), strict.regex(c("s"), "A_", fold=True), strict.strpos(c("s"), F.lit("b")))) == [(2.0, True, True, 3), (None, None, None, None)]
    with pytest.raises(Exception, match="logarithm"):
        df.select(strict.ln(-c("x"))).collect()
    assert strict.format_type("bigint") == "bigint" and strict.format_type("decimal(5,2)") == "numeric(5,2)"


def test_triggers(spark):
    t = triggers.Triggers()
    t.create(triggers.Trigger("fix", "acc", "update", "before", c("new.v") < 0, {"v": F.lit(0)}))
    t.create(triggers.Trigger("log", "acc", "update", "after", c("old.v") != c("new.v"), into="audit", derive=lambda d: d.select(c("new.k").alias("k"), c("old.v").alias("was"))))
    changed = spark.createDataFrame([((1, 5), (1, -2)), ((2, 7), (2, 7))], "old struct<k:int,v:int>, new struct<k:int,v:int>")
    after, derived = t.fire("acc", "update", changed)
    assert rows(after.select("new.k", "new.v")) == [(1, 0), (2, 7)] and rows(derived["audit"]) == [(1, 5)]
    assert tuple(t.backtest("fix", spark.createDataFrame([(1, -1), (2, 3)], "k int, v int")).first()) == (2, 1)
    t.create(triggers.Trigger("no", "acc", "delete", "before", raises="not here"))
    with pytest.raises(Exception, match="not here"):
        t.fire("acc", "delete", changed)[0].collect()
    with pytest.raises(ValueError):
        t.create(triggers.Trigger("no", "acc", "delete"))


def test_tasks(spark):
    q = tasks.enqueue(spark.createDataFrame([], tasks.SCHEMA), spark.createDataFrame([(1, "a", "p", 0), (2, "a", "q", 5), (3, "b", "r", None)], "id long, kind string, payload string, priority int"))
    q, mine = tasks.claim(q, "w", 2, now=100, lease=10)
    assert sorted(r["id"] for r in mine.collect()) == [1, 2]
    q = tasks.finish(q, mine.where("id = 2"))
    q = tasks.reap(q, 200)
    assert {r["id"]: r["state"] for r in q.collect()} == {1: "ready", 2: "done", 3: "ready"}
    for _ in range(2):
        q, mine = tasks.claim(q, "w", 1, 0, 10)
        q = tasks.finish(q, mine, ok=False, retries=2)
    assert {r["id"]: r["state"] for r in q.collect()}[1] == "failed"


def test_objects(spark, tmp_path):
    store = spark.createDataFrame([], "name string, version long, data binary")
    one = spark.createDataFrame([("a", bytearray(b"xy")), ("b", bytearray(b"1"))], "name string, data binary")
    store = objects.put(store, one, 1)
    store = objects.put(store, one.withColumn("data", F.when(c("name") == "a", F.lit(b"new")).otherwise(c("data"))), 2)
    assert rows(store.select("name", "version")) == [("a", 1), ("a", 2), ("b", 1)]
    assert bytes(objects.get(store, 1).where("name = 'a'").first()["data"]) == b"xy" and objects.prune(store, 1).count() == 2
    assert [bytes(r["data"]) for r in objects.chunks(objects.get(store).where("name = 'a'"), 2).orderBy("part").collect()] == [b"ne", b"w"]
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("m.txt", "hello")
    (tmp_path / "z.zip").write_bytes(buf.getvalue())
    assert [(r["name"], bytes(r["data"])) for r in objects.unpack(objects.read_files(spark, str(tmp_path / "z.zip"))).collect()] == [("m.txt", b"hello")]


def test_procedures_and_model(spark):
    p = procedures.Procedures(Engine(spark))
    p.create("twice", ["x"], lambda e, x: e.query("select ? * 2 as y", [x]))
    p.create("loop", ["n"], "BEGIN DECLARE i INT DEFAULT 0; DECLARE s INT DEFAULT 0; WHILE i < :n DO SET i = i + 1; SET s = s + i; END WHILE; SELECT s; END")
    assert p.call("twice", 4).first()[0] == 8 and p.call("loop", 4).first()[0] == 10
    with pytest.raises(ValueError):
        p.call("twice")
    p.drop("twice")
    m = {"tables": {"e": {"role": "edge"}}, "derived": {"r": {"kind": "reverse-edge", "of": "e"}, "n": {"kind": "counter", "of": "e", "by": ["src"]}}}
    out = model.derive(m, {"e": spark.createDataFrame([(1, 2), (1, 3)], "src int, dst int")})
    assert rows(out["r"]) == [(2, 1), (3, 1)] and rows(out["n"]) == [(1, 2)]
    with pytest.raises(ValueError):
        model.check({"tables": {"e": {"role": "x"}}})
