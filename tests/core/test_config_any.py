import pytest
from pyspark.sql import functions as F

from millrace.functions import anytype
from millrace.plans import config
from millrace.plans.database import Database


def test_any(spark):
    parts = [spark.createDataFrame([(1,), (2**53 + 1,), (None,)], "x long").select(anytype.pack(F.col("x"), "bigint").alias("v")), spark.createDataFrame([(1.0,), (float(2**53),), (-0.5,)], "x double").select(anytype.pack(F.col("x"), "double").alias("v")), spark.createDataFrame([("a",), ("",)], "x string").select(anytype.pack(F.col("x"), "string").alias("v")), spark.createDataFrame([(bytearray(b"a"),)], "x binary").select(anytype.pack(F.col("x"), "binary").alias("v"))]
    df = parts[0]
    for p in parts[1:]:
        df = df.unionAll(p)
    got = [tuple(r) for r in df.orderBy(anytype.order_key(F.col("v"))).select(anytype.typeof(F.col("v")), anytype.to_text(F.col("v"))).collect()]
    assert [g[0] for g in got[:2]] == ["null", "real"] and got[4][1] == "9.007199254740992E15" and got[5] == ("integer", str(2**53 + 1))
    assert [g[0] for g in got[6:]] == ["text", "text", "blob"]
    assert df.groupBy(anytype.order_key(F.col("v"))).count().count() == 8
    one = anytype.pack(F.lit(1), "int")
    assert df.where(anytype.equals(F.col("v"), one)).count() == 2 and df.where(anytype.less(F.col("v"), one)).count() == 1


def test_config(spark, tmp_path):
    f = tmp_path / "app.toml"
    f.write_text('[[table]]\nname = "users"\nprimary_key = ["id"]\n[[table.column]]\nname = "id"\ntype = "int64"\n[[table.column]]\nname = "email"\ntype = "text"\nnullable = false\nunique = true\n[[table.column]]\nname = "age"\ntype = "int64"\ncheck = "age >= 0"\ndefault = 7\n[[table.index]]\ncolumns = ["age", "email"]\nunique = true\n')
    db = Database(spark, str(tmp_path / "db"))
    assert config.load(db, f) == ["users"] and config.load(db, f) == []
    db.execute("INSERT INTO users (id, email) VALUES ($1, $2)", [1, "a@b"])
    assert tuple(db.execute("SELECT * FROM users").first()) == (1, "a@b", 7)
    with pytest.raises(ValueError, match="check"):
        db.execute("INSERT INTO users VALUES (2, 'c', -1)")
    f.write_text(f.read_text().replace('"text"', '"blob"'))
    with pytest.raises(ValueError, match="differs"):
        config.load(db, f)
