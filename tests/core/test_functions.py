import sqlite3

import pytest
from pyspark.sql import functions as F

from millrace.functions import casts, dates, jsons, maths, predicates, strings, vectors


def ask(spark, rows, schema, *columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*[c.alias(f"x{i}") for i, c in enumerate(columns)]).collect()]


def lite(sql, rows):
    con = sqlite3.connect(":memory:")
    return [con.execute(sql, r).fetchone() for r in rows]


def test_substr_and_trim(spark):
    rows = [("abcdef", s, n) for s in range(-8, 9) for n in range(-8, 9)] + [(None, 1, 1), ("é漢🙂", -2, 1), ("", 1, 2)]
    got = ask(spark, rows, "x string, s int, n int", strings.substr(F.col("x"), F.col("s"), F.col("n")), strings.substr(F.col("x"), F.col("s")))
    assert got == lite("select substr(?1, ?2, ?3), substr(?1, ?2)", rows)
    got = ask(spark, [(" \t xx 　",), ("--a-",)], "x string", strings.trim(F.col("x")), strings.trim(F.col("x"), F.lit("-")), strings.ltrim(F.col("x"), F.lit("-")))
    assert got == [("xx", " \t xx 　", " \t xx 　"), ("--a-", "a", "a-")]


def test_text_functions(spark):
    rows = [("it's", 65), (None, None), ("", 0x1F642), ("Émile", 0xD800)]
    x, n = F.col("x"), F.col("n")
    got = ask(spark, rows, "x string, n long", strings.quote(x, "string"), strings.quote(n, "bigint"), strings.unicode(x), strings.char(n), strings.typeof(x, "string"), strings.replace(x, F.lit(""), F.lit("z")), strings.instr(x, F.lit("")), strings.nocase(x), strings.hex_(x))
    assert got[0] == ("'it''s'", "65", 105, "A", "text", "it's", 1, "it's", "69742773")
    assert got[1] == ("NULL", "NULL", None, None, "null", None, None, None, None)
    assert got[2][2:4] == (None, "🙂") and got[3][3] == "�" and got[3][7] == "Émile"
    assert ask(spark, [("héllo", 1)], "x string, n int", strings.splice(x, F.lit(3), F.lit(2), F.lit("LL")))[0][0] == "héLLo"
    with pytest.raises(Exception, match="outside"):
        ask(spark, [("ab", 1)], "x string, n int", strings.splice(x, F.lit(1), F.lit(5), F.lit("")))
    rows = [("o'k", 7, 2.5), (None, None, None)]
    got = ask(spark, rows, "s string, i long, f double", strings.printf("%05d|%-4d|%s|%q|%Q|%.2f|%x|%%|%6s", F.col("i"), F.col("i"), F.col("s"), F.col("s"), F.col("s"), F.col("f"), F.col("i"), F.col("s")))
    assert got == [("00007|7   |o'k|o''k|'o''k'|2.50|7|%|   o'k",), ("00000|0   |||NULL|0.00|0|%|      ",)]
    assert ask(spark, [(1, None), (3, 2)], "a int, b int", strings.scalar_max(F.col("a"), F.col("b")), strings.scalar_min(F.col("a"), F.col("b"))) == [(None, None), (3, 2)]


def test_numbers(spark):
    rows = [(7, 2), (-7, 2), (7, 0), (None, 1), (1, 65), (-1, 70), (1, -1), (5, 64)]
    a, b = F.col("a"), F.col("b")
    got = ask(spark, rows, "a long, b long", maths.int_div(a, b), maths.mod(a, b), maths.shift_left(a, b), maths.shift_right(a, b))
    assert got == lite("select ?1 / ?2, ?1 % ?2, ?1 << ?2, ?1 >> ?2", rows)
    rows = [(2.675,), (2.5,), (-2.5,), (None,), (1e20,)]
    x = F.col("x")
    got = ask(spark, rows, "x double", maths.round_(x, 2), maths.round_(x), maths.sqrt(x), maths.ln(x), maths.trunc(x), maths.acos(x))
    assert [g[:2] for g in got] == [(2.67, 3.0), (2.5, 3.0), (-2.5, -3.0), (None, None), (1e20, 1e20)]
    assert got[2][2:] == (None, None, -2.0, None)
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        ask(spark, [(1, 0)], "a long, b long", maths.int_div(a, b, strict=True))


def test_casts(spark):
    rows = [("12abc",), ("-3.7e2x",), ("abc",), ("",), (None,), (" 9",), ("99999999999999999999",), ("-99999999999999999999999999999999999999999",), (".5",)]
    got = ask(spark, rows, "x string", casts.to_integer(F.col("x")), casts.to_real(F.col("x")))
    assert got == lite("select cast(?1 as integer), cast(?1 as real)", rows)
    assert [casts.affinity(x) for x in ("VARCHAR(9)", "BIGINT", "DOUBLE", "BLOB", "DECIMAL(3)", "")] == ["TEXT", "INTEGER", "REAL", "BLOB", "NUMERIC", "BLOB"]


def test_predicates(spark):
    texts = ["abc", "ABC", "a%c", "a\\c", "É", "a\nc", "", None, "a]c", "a-c"]
    con = sqlite3.connect(":memory:")
    for p, e in (("a%", None), ("A_C", None), ("a\\%", None), ("a!%c", "!"), ("é", None), ("%", None)):
        got = ask(spark, [(t,) for t in texts], "x string", predicates.like(F.col("x"), p, e))
        want = [con.execute("select ? like ?" + (" escape ?" if e else ""), (t, p, *([e] if e else []))).fetchone()[0] for t in texts]
        assert [None if g[0] is None else int(g[0]) for g in got] == want, p
    for p in ("a*", "?B?", "a[%b]c", "a[^b]c", "[]]", "a[]-]c", "*c", "[a-b]*", "a["):
        got = ask(spark, [(t,) for t in texts], "x string", predicates.glob(F.col("x"), p))
        assert [None if g[0] is None else int(g[0]) for g in got] == [con.execute("select ? glob ?", (t, p)).fetchone()[0] for t in texts], p
    rows = [(1, None), (1, 2), (None, None), (2, 1)]
    a, b = F.col("a"), F.col("b")
    got = ask(spark, rows, "a int, b int", predicates.row_eq([a, b], [F.lit(1), F.lit(2)]), predicates.row_lt([a, b], [F.lit(1), F.lit(3)]), predicates.in_list(a, []), predicates.not_in_list(a, [2, None]), predicates.distinct_from(a, b))
    want = lite("select (?1, ?2) = (1, 2), (?1, ?2) < (1, 3), ?1 in (), ?1 not in (2, null), ?1 is not ?2", rows)
    assert [tuple(None if v is None else int(v) for v in g) for g in got] == want


def test_dates(spark):
    texts = ["2024-02-29", "2023-02-30", "2024-12-30 23:59:59.987", "2024-01-01T05:06+02:00", "12:34", "2024-06-15 12:00:00Z", "bad", None, "2024-13-01", "1969-07-20 20:17:40", "2021-01-03 00:00"]
    sql = "select date(?1), time(?1), datetime(?1), strftime('%Y/%m/%d %H-%M-%S %j %w %W %%', ?1), strftime('%f %s %u %I %p %e %k', ?1)"
    x = F.col("x")
    got = ask(spark, [(t,) for t in texts], "x string", dates.date(x), dates.time(x), dates.datetime(x), dates.strftime("%Y/%m/%d %H-%M-%S %j %w %W %%", x), dates.strftime("%f %s %u %I %p %e %k", x), dates.julianday(x))
    want = lite(sql, [(t,) for t in texts])
    for t, g, w in zip(texts, got, want):
        w = tuple(None if v is None else v for v in w)
        for i in range(4):
            assert g[i] == w[i], (t, g, w)
        if sqlite3.sqlite_version_info >= (3, 46) and w[4]:
            assert g[4] == w[4], (t, g, w)
    assert got[0][5] == pytest.approx(2460369.5)


def test_json(spark):
    rows = [('{"a": [1, 2.50, {"b": "x\\ny"}], "c": null, "d": true}',), ("[1,2,3]",), ('"s"',), (None,)]
    x = F.col("x")
    got = ask(spark, rows, "x string", jsons.json_(x), jsons.json_type(x, "$.a[1]"), jsons.json_array_length(x), jsons.json_extract(x, "$.a[2].b"), jsons.arrow(x, "a"), jsons.arrow_text(x, -1), jsons.json_extract(x, "$.a[0]", "$.zz"))
    assert got[0] == ('{"a":[1,2.50,{"b":"x\\ny"}],"c":null,"d":true}', "real", 0, "x\ny", '[1,2.50,{"b":"x\\ny"}]', None, "[1,null]")
    assert got[1] == ("[1,2,3]", None, 3, None, None, "3", "[null,null]")
    assert got[3] == (None,) * 7
    got = ask(spark, [("{a:1}",), ('{"a":1}',), ("[1,]",), ("NaN",), ("1e5",), (None,)], "x string", jsons.json_valid(x))
    assert [g[0] for g in got] == [0, 1, 0, 0, 1, None]
    got = ask(spark, [('{"a":1,"b":[1,2]}', "new")], "x string, v string", jsons.json_set(x, "$.c", F.col("v")), jsons.json_insert(x, "$.a", F.col("v")), jsons.json_replace(x, "$.a", F.lit(5), "int"), jsons.json_remove(x, "$.b[0]", "$.a"), jsons.json_patch(x, F.lit('{"a":null,"n":{"z":1}}')), jsons.json_set(x, "$.b[#]", F.lit("[9]"), "json"))
    con = sqlite3.connect(":memory:")
    doc = '{"a":1,"b":[1,2]}'
    want = con.execute("select json_set(?1,'$.c','new'), json_insert(?1,'$.a','new'), json_replace(?1,'$.a',5), json_remove(?1,'$.b[0]','$.a'), json_patch(?1,'{\"a\":null,\"n\":{\"z\":1}}'), json_set(?1,'$.b[#]',json('[9]'))", (doc,)).fetchone()
    assert got[0] == want
    got = ask(spark, [('q"x', None)], "x string, n int", jsons.json_array((x, "string"), (F.col("n"), "int"), (F.lit("{}"), "json")), jsons.json_object(("k", x, "string"), ("n", F.col("n"), "int")), jsons.json_quote(F.col("n"), "int"))
    assert got == [('["q\\"x",null,{}]', '{"k":"q\\"x","n":null}', "null")]


def test_vectors(spark):
    import numpy as np

    rows = [([1.0, 2.0], [4.0, 6.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0])]
    got = ask(spark, rows, "a array<float>, b array<float>", vectors.l2(F.col("a"), F.col("b")), vectors.cosine(F.col("a"), F.col("b")))
    assert got[0] == (5.0, pytest.approx(1 - 16 / (5**0.5 * 52**0.5))) and got[1][1] is None and got[2] == (None, None)
    assert ask(spark, [(bytearray(np.array([1.5, -2], "<f4").tobytes()),)], "b binary", vectors.decode_f32(F.col("b"))) == [([1.5, -2.0],)]
    with pytest.raises(Exception, match="length"):
        ask(spark, [([1.0], [1.0, 2.0])], "a array<float>, b array<float>", vectors.l2(F.col("a"), F.col("b")))
