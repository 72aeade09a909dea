"""SQL names for the engine's functions.

The builders of ``functions`` become temporary SQL functions (``ml_*``) with typed arguments,
which Catalyst inlines; JSON readers and editors, and rounding to decimals, are Arrow UDFs.
``call`` writes a function call of the dialect in terms of both.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions import casts, collation, dates, jsons, maths, strings, vectors

x, y, n = F.col("x"), F.col("y"), F.col("n")
_D, _S, _I = "DOUBLE", "STRING", "BIGINT"
#: name: (parameters, result, builder)
_FUNCTIONS: dict[str, tuple[str, str, Column]] = {
    "ml_nocase": ("x STRING", _S, strings.nocase(x)), "ml_rtrim_key": ("x STRING", _S, strings.rtrim_key(x)),
    "ml_real": ("x STRING", _D, casts.to_real(x)), "ml_integer": ("x STRING", _I, casts.to_integer(x)), "ml_whole": ("x DOUBLE", _I, casts.to_integer(x, "double")), "ml_numeric": ("x STRING", _D, casts.to_numeric(x)),
    "ml_shift_left": ("x BIGINT, n BIGINT", _I, maths.shift_left(x, n)),
    "ml_substr2": ("x STRING, n BIGINT", _S, strings.substr(x, n)), "ml_substr3": ("x STRING, n BIGINT, y BIGINT", _S, strings.substr(x, n, y)),
    "ml_replace": ("x STRING, n STRING, y STRING", _S, strings.replace(x, n, y)), "ml_instr": ("x STRING, y STRING", "INT", strings.instr(x, y)),
    "ml_trim": ("x STRING", _S, strings.trim(x)), "ml_ltrim": ("x STRING", _S, strings.ltrim(x)), "ml_rtrim": ("x STRING", _S, strings.rtrim(x)),
    "ml_char": ("x BIGINT", _S, strings.char(x)), "ml_unicode": ("x STRING", "INT", strings.unicode(x)), "ml_splice": ("x STRING, n INT, y INT, z STRING", _S, strings.splice(x, n, y, F.col("z"))),
    "ml_date": ("x STRING", _S, dates.date(x)), "ml_time": ("x STRING", _S, dates.time(x)), "ml_datetime": ("x STRING", _S, dates.datetime(x)), "ml_julianday": ("x STRING", _D, dates.julianday(x)),
    "ml_trunc": ("x DOUBLE", _D, maths.trunc(x)), "ml_sqrt": ("x DOUBLE", _D, maths.sqrt(x)), "ml_power": ("x DOUBLE, y DOUBLE", _D, maths.power(x, y)),
    "ml_ln": ("x DOUBLE", _D, maths.ln(x)), "ml_log10": ("x DOUBLE", _D, maths.log10(x)), "ml_log2": ("x DOUBLE", _D, maths.log2(x)), "ml_log": ("x DOUBLE, y DOUBLE", _D, maths.log(x, y)),
    "ml_asin": ("x DOUBLE", _D, maths.asin(x)), "ml_acos": ("x DOUBLE", _D, maths.acos(x)), "ml_mod": ("x DOUBLE, y DOUBLE", _D, maths.fmod(x, y)),
    "ml_json_text": ("x STRING", _S, jsons.json_quote(x, "string")),
}
_RENAMED = {
    "replace": "ml_replace", "instr": "ml_instr", "strpos": "ml_instr", "unicode": "ml_unicode", "splice": "ml_splice", "date": "ml_date", "time": "ml_time", "datetime": "ml_datetime", "julianday": "ml_julianday",
    "sqrt": "ml_sqrt", "pow": "ml_power", "power": "ml_power", "ln": "ml_ln", "log2": "ml_log2", "log10": "ml_log10", "asin": "ml_asin", "acos": "ml_acos", "mod": "ml_mod",
    "json": "ml_json", "json_valid": "json_valid", "json_type": "ml_json_type", "json_array_length": "ml_json_array_length", "json_extract": "json_extract", "json_patch": "ml_json_patch", "json_remove": "ml_json_remove",
}
_KINDS = {"ml_instr": "int", "ml_unicode": "int", "json_valid": "int", "ml_json_array_length": "int"} | dict.fromkeys(("ml_julianday", "ml_sqrt", "ml_power", "ml_ln", "ml_log2", "ml_log10", "ml_asin", "ml_acos", "ml_mod"), "real") | dict.fromkeys(("ml_json", "ml_json_patch", "ml_json_remove"), "json")
_STRICT = {"sqrt": "sqrt", "ln": "ln", "log10": "log10", "power": "power", "pow": "power", "asin": "asin", "acos": "acos"}
_TYPE = {"int": _I, "real": _D, "text": _S, "bool": "BOOLEAN", "blob": "BINARY", "null": _S, "json": _S}


def text_of(spark: SparkSession, c: Column) -> str:
    """The SQL text of a column; operators come out as calls, whose names need quotes."""
    return re.sub(r"(?<![`\w])(and|or|not|in)\(", r"`\1`(", spark._jsparkSession.expression(c._jc).sql())


def define(spark: SparkSession, name: str, parameters: str, returns: str, body: Column) -> None:
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {text_of(spark, body)}")


def _has(spark: SparkSession, name: str) -> bool:
    return name in _installed(spark)


def _installed(spark: SparkSession) -> set[str]:
    if not hasattr(spark, "_ml_functions"):
        spark._ml_functions = set()
    return spark._ml_functions


def install(spark: SparkSession) -> None:
    done = _installed(spark)
    if "" in done:
        return
    done.add("")
    for name, (parameters, returns, body) in _FUNCTIONS.items():
        define(spark, name, parameters, returns, body)
    zipped = "aggregate(zip_with({a}, {b}, (p, q) -> {t}), 0D, (s, p) -> s + p)"
    dot = lambda a, b: zipped.format(a=a, b=b, t="p * q")
    same = "CASE WHEN size(x) <> size(y) THEN CAST(raise_error('vectors differ in length') AS DOUBLE) ELSE {} END"
    for name, body in (("vec_l2", f"sqrt({zipped.format(a='x', b='y', t='(p - q) * (p - q)')})"), ("vec_cosine", f"1 - try_divide({dot('x', 'y')}, sqrt({dot('x', 'x')}) * sqrt({dot('y', 'y')}))")):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x ARRAY<DOUBLE>, y ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {same.format(body)}")
    _install_json(spark)
    spark.udf.register("ml_round", maths._round_exact)


def _install_json(spark: SparkSession) -> None:
    missing = jsons._MISSING

    def node(text, path):
        return jsons.find(jsons.parse(text), jsons._key_path(path))

    def known(fn):
        return lambda *a: None if any(v is None for v in a) else fn(*a)

    def extract(text, *paths):
        if text is None or None in paths:
            return None
        value = jsons.parse(text)
        found = [jsons.find(value, jsons.parse_path(p)) for p in paths]
        return jsons.sql_text(found[0]) if len(found) == 1 else jsons.dump([None if f is missing else f for f in found])

    def kind(text, path="$"):
        found = node(text, path)
        return None if found is missing else jsons.kind(found)

    def length(text, path="$"):
        found = node(text, path)
        return None if found is missing else len(found) if isinstance(found, list) and not isinstance(found, jsons.Members) else 0

    def arrow(text, path):
        found = node(text, path)
        return None if found is missing else jsons.dump(found)

    def removed(text, *paths):
        value = jsons.parse(text)
        for p in paths:
            value = jsons.remove(value, jsons.parse_path(p))
            if value is missing:
                return None
        return jsons.dump(value)

    def editor(create, overwrite):
        def run(text, *pairs):
            if text is None or None in pairs:
                return None
            value = jsons.parse(text)
            for path, new in zip(pairs[::2], pairs[1::2], strict=True):
                value = jsons.edit(value, jsons.parse_path(path), jsons.parse(new), create, overwrite)
            return jsons.dump(value)

        return run

    made = {
        "ml_json": (known(lambda t: jsons.dump(jsons.parse(t))), "string"), "json_valid": (known(jsons._valid), "int"), "ml_json_type": (known(kind), "string"), "ml_json_array_length": (known(length), "int"),
        "json_extract": (extract, "string"), "ml_json_arrow": (known(arrow), "string"), "ml_json_arrow_text": (known(lambda t, p: jsons.sql_text(node(t, p))), "string"),
        "ml_json_patch": (known(lambda a, b: jsons.dump(jsons.merge(jsons.parse(a), jsons.parse(b)))), "string"), "ml_json_remove": (known(removed), "string"),
        "ml_json_set": (editor(True, True), "string"), "ml_json_insert": (editor(True, False), "string"), "ml_json_replace": (editor(False, True), "string"),
    }
    for name, (fn, returns) in made.items():
        spark.udf.register(name, F.udf(fn, returns, useArrow=True))


def _made_to_order(spark: SparkSession, what: str, key: str, kinds: list[str], body: Column) -> str:
    """A function whose text depends on a literal, under a name that tells it."""
    name = f"ml_{what}_{hashlib.md5(f'{key}|{kinds}'.encode()).hexdigest()[:12]}"
    if not _has(spark, name):
        define(spark, name, ", ".join(f"a{i} {_TYPE.get(k, _S)}" for i, k in enumerate(kinds)), _S, body)
        _installed(spark).add(name)
    return name


def collation_key(spark: SparkSession, name: str, sql: str) -> str:
    up = name.upper()
    if up in ("NOCASE", "RTRIM"):
        return f"ml_{'nocase' if up == 'NOCASE' else 'rtrim_key'}({sql})"
    key = collation._RAW.get(up)
    if key is None:
        raise ValueError(f"no such collation sequence: {name}")
    fn = f"ml_collation_{hashlib.md5(up.encode()).hexdigest()[:8]}"
    if not _has(spark, fn):
        spark.udf.register(fn, F.udf(lambda v: None if v is None else (k.encode() if isinstance(k := key(v), str) else k), "binary", useArrow=True))
        _installed(spark).add(fn)
    return f"{fn}({sql})"


def as_json(node) -> str:
    """The JSON text of a value; JSON is spliced as it is."""
    if node.kind == "json":
        return f"coalesce({node.sql}, 'null')"
    return f"ml_json_text({node.sql})" if node.kind == "text" else f"coalesce(CAST({node.sql} AS STRING), 'null')"


def call(spark: SparkSession, name: str, args: list, strict: bool) -> tuple[str, str] | None:
    """(text, kind) of a call that Spark would answer otherwise, or None."""
    a, kinds = [m.sql for m in args], [m.kind for m in args]
    joined = ", ".join(a)
    text = lambda i: a[i] if kinds[i] in ("text", "other", "json") else f"CAST({a[i]} AS STRING)"
    if strict and name in _STRICT:
        from ..functions import strict as strict_functions

        fn = _strict_function(spark, name, len(a), getattr(strict_functions, _STRICT[name]))
        return f"{fn}({joined})", "real"
    if name in ("substr", "substring"):
        return f"ml_substr{len(a)}({', '.join([text(0), *a[1:]])})", "text"
    if name in ("trim", "ltrim", "rtrim"):
        return (f"ml_{name}({text(0)})" if len(a) == 1 else f"{ {'trim': 'btrim', 'ltrim': 'ltrim', 'rtrim': 'rtrim'}[name]}({text(0)}, {a[1]})" if name == "trim" else f"{name}({a[1]}, {text(0)})"), "text"
    if name in ("lower", "upper"):
        return f"{name}({text(0)})", "text"
    if name == "length":
        return f"{'octet_length' if kinds[0] == 'blob' else 'char_length'}({a[0] if kinds[0] == 'blob' else text(0)})", "int"
    if name == "hex":
        return f"hex({a[0] if kinds[0] in ('blob', 'text') else f'CAST({a[0]} AS STRING)'})", "text"
    if name == "char":
        return (f"concat({', '.join(f'ml_char({v})' for v in a)})" if a else "''"), "text"
    if name == "log":
        return (f"ml_log10({joined})" if len(a) == 1 else f"ml_log({joined})"), "real"
    if name == "round":
        if len(a) == 1 or a[1] == "0":
            return f"round(CAST({a[0]} AS DOUBLE))", "real"
        return f"ml_round(CAST({a[0]} AS DOUBLE), CAST(least(greatest({a[1]}, 0), 30) AS INT))", "real"
    if name in ("ceil", "ceiling", "floor", "trunc"):
        if kinds[0] == "int":
            return a[0], "int"
        value = f"ml_real({a[0]})" if kinds[0] == "text" else a[0]
        return (f"ml_trunc({value})" if name == "trunc" else f"CAST({name}(CAST({value} AS DOUBLE)) AS DOUBLE)"), "real"
    if name == "sign":
        return f"CAST(signum({a[0]}) AS BIGINT)", "int"
    if name == "iif" or (name == "if" and len(a) in (2, 3)):
        test = a[0] if kinds[0] == "bool" else f"({a[0]} <> 0)"
        return f"(CASE WHEN {test} THEN {a[1]}{f' ELSE {a[2]}' if len(a) > 2 else ''} END)", kinds[1] if len(a) < 3 or kinds[1] == kinds[2] else "other"
    if name == "typeof":
        kind = {"int": "integer", "real": "real", "text": "text", "blob": "blob", "bool": "integer", "null": "null", "json": "text"}.get(kinds[0], "text")
        return f"(CASE WHEN {a[0]} IS NULL THEN 'null' ELSE '{kind}' END)", "text"
    if name == "quote":
        body = strings.quote(F.col("a0"), {"int": "bigint", "real": "double", "text": "string", "blob": "binary", "bool": "boolean"}.get(kinds[0], "string"))
        return f"{_made_to_order(spark, 'quote', '', kinds, body)}({joined})", "text"
    if name in ("printf", "format") and args and args[0].value is not None:
        body = strings.printf(args[0].value, *[F.col(f"a{i}") for i in range(len(a) - 1)])
        fn = _made_to_order(spark, "printf", args[0].value, kinds[1:], body)
        return f"{fn}({', '.join(a[1:])})", "text"
    if name == "strftime" and args and args[0].value is not None:
        moment = _moment(args[1]) if len(a) > 1 else _moment(None)
        return f"{_made_to_order(spark, 'strftime', args[0].value, ['text'], dates.strftime(args[0].value, F.col('a0')))}({moment})", "text"
    if name in ("date", "time", "datetime", "julianday") and len(a) <= 1:
        return f"ml_{name}({_moment(args[0] if args else None)})", "real" if name == "julianday" else "text"
    if name in ("json_set", "json_insert", "json_replace"):
        rest = [v if i % 2 == 0 else as_json(m) for i, (v, m) in enumerate(zip(a[1:], args[1:], strict=True))]
        return f"ml_{name}({', '.join([a[0], *rest])})", "json"
    if name in ("json_array", "json_build_array"):
        return f"concat('[', concat_ws(',', array({', '.join(map(as_json, args))})), ']')" if a else "'[]'", "json"
    if name in ("json_object", "json_build_object"):
        if len(a) % 2:
            raise ValueError(f"{name} takes names and values")
        pairs = [f"concat({as_json(k)}, ':', {as_json(v)})" for k, v in zip(args[::2], args[1::2], strict=True)]
        return f"concat('{{', concat_ws(',', array({', '.join(pairs)})), '}}')" if a else "'{}'", "json"
    if name == "json_quote":
        if a[0].startswith("json_extract(") and a[0].count("'$") == 1:
            # the node's own JSON, whatever its type
            return f"coalesce(ml_json_arrow({a[0][len('json_extract('):]}, 'null')", "json"
        return as_json(args[0]), "json"
    if name == "unnest":
        return f"explode({a[0]})", "other"
    if name == "generate_subscripts":
        return f"explode(CASE WHEN size({a[0]}) > 0 THEN sequence(1, size({a[0]})) ELSE CAST(array() AS ARRAY<INT>) END)", "int"
    if name in ("format_type", "pg_typeof"):
        return f"'{ {'int': 'bigint', 'real': 'double precision', 'text': 'text', 'bool': 'boolean', 'blob': 'bytea'}.get(kinds[0], kinds[0])}'", "text"
    if name in ("has_table_privilege", "has_schema_privilege", "has_database_privilege"):
        return "true", "bool"
    if name in ("version", "sqlite_version"):
        return "'millrace'", "text"
    if name == "nullif":
        return f"nullif({joined})", kinds[0]
    if name in _RENAMED:
        fn = _RENAMED[name]
        return f"{fn}({joined})", _KINDS.get(fn, "text")
    return None


def _moment(node) -> str:
    """A time value as text; 'now', or none, is fixed for the statement."""
    if node is None or (node.value or "").lower() == "now":
        return "date_format(current_timestamp(), 'yyyy-MM-dd HH:mm:ss.SSS')"
    return f"date_format({node.sql}, 'yyyy-MM-dd HH:mm:ss.SSS')" if node.kind in ("timestamp", "timestamp_ntz", "date") else node.sql


def _strict_function(spark: SparkSession, name: str, arity: int, builder) -> str:
    fn = f"ml_strict_{name}"
    if not _has(spark, fn):
        define(spark, fn, ", ".join(f"a{i} DOUBLE" for i in range(arity)), _D, builder(*[F.col(f"a{i}") for i in range(arity)]))
        _installed(spark).add(fn)
    return fn
