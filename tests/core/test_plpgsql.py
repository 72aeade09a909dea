import pytest

from millrace.plans.engine import Engine
from millrace.plans.plpgsql import compile_function

GCD = """CREATE OR REPLACE FUNCTION gcd2(a int, b int) RETURNS int AS $$
DECLARE t int; n int := 0;
BEGIN
  -- a comment; with a semicolon
  WHILE b <> 0 LOOP
    t := a % b; a := b; b := t; n = n + 1;
  END LOOP;
  IF n > 100 THEN RETURN NULL; ELSIF a < 0 THEN RETURN -a; ELSE RETURN a; END IF;
END;
$$ LANGUAGE plpgsql;"""
SUM = """create function tri(n int) returns int as $f$
declare s int default 0;
begin
  for i in reverse n..1 by 2 loop
    continue when i = 3;
    s := s + i;
  end loop;
  loop
    exit when s >= 10 or s is null;
    s := s + 1;
  end loop;
  return s::int;
end $f$ language plpgsql"""


def test_functions():
    name, gcd = compile_function(GCD)
    assert name == "gcd2" and gcd(12, 18) == 6 and gcd(-4, 0) == 4 and gcd(7, 3) == 1
    _, tri = compile_function(SUM)
    assert tri(7) == 13 and tri(1) == 10
    _, div = compile_function("create function d(a int, b int) returns int as $$ begin return a / b; end $$ language plpgsql")
    assert div(-7, 2) == -3 and div(None, 2) is None
    for bad in ("create function x(a int) returns int as $$ begin return a ** 2; end $$", "select 1"):
        with pytest.raises(ValueError):
            compile_function(bad)
    with pytest.raises(RuntimeError):
        compile_function("create function f(a int) returns int as $$ begin loop a := a + 1; end loop; return a; end $$ language plpgsql", 50)[1](1)


def test_in_sql(spark):
    e = Engine(spark)
    e.create_plpgsql(GCD, "int")
    assert e.query("select gcd2(12, 30) as g").first()[0] == 6
    e.register("edge", spark.createDataFrame([(1, 2)], "src int, dst int"))
    e.register("vec", spark.createDataFrame([(1, [0.0, 3.0]), (2, [4.0, 0.0])], "id int, emb array<double>"))
    got = e.install_model_operators({"tables": {"edge": {"role": "edge", "traverse": ["src", "dst"]}, "vec": {"role": "embedding", "knn": True}}})
    assert got == [":->:", ":~:"]
    assert [r[0] for r in e.query("select id from vec where 1 :->: id").collect()] == [2]
    assert [r[0] for r in e.query("select id from vec order by emb :~: array(0D, 0D) limit 1").collect()] == [1]
    assert e.query("select json_extract('{\"a\":[1,2.50]}', '$.a[1]') as x, json_valid('{a:1}') as v").first() == ("2.50", 0)
