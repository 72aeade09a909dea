"""JSON functions over text: strict RFC 8259, numbers keep their spelling.

Reading uses Arrow UDFs with one parser, because Spark's own functions accept what is not
JSON and do not keep number tokens. Paths are literals (``$.a[1][#-1]``, ``$."x y"``), so they
are parsed once, on the driver.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_DEPTH = 128


class _MISSING:
    """Where a path leads nowhere; a class, so that it stays the same object in workers."""


class Number(str):
    """A number token."""


class Members(list):
    """An object, as pairs in order."""


def parse(text: str):
    def constant(_: str):
        raise ValueError("not JSON")

    out = json.loads(text, object_pairs_hook=Members, parse_int=Number, parse_float=Number, parse_constant=constant)
    if _depth(out) > _DEPTH:
        raise ValueError("nested too deeply")
    return out


def _depth(x) -> int:
    level, most, todo = 0, 0, [(x, 0)]
    while todo:
        x, level = todo.pop()
        most = max(most, level)
        if isinstance(x, Members):
            todo += [(v, level + 1) for _, v in x]
        elif isinstance(x, list):
            todo += [(v, level + 1) for v in x]
    return most


def dump(x) -> str:
    if isinstance(x, Members):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{dump(v)}" for k, v in x) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(dump, x)) + "]"
    if isinstance(x, Number):
        return str(x)
    return json.dumps(x, ensure_ascii=False)


def parse_path(path: str) -> list:
    """Steps of a path: a key, an index from 0, or ("#", n) for n places from the end."""
    if not path.startswith("$"):
        raise ValueError(f"bad JSON path {path!r}")
    steps, at = [], 1
    for m in re.finditer(r'\.(?:"((?:[^"\\]|\\.)*)"|([^.\[]+))|\[(?:(\d+)|#(?:-(\d+))?)\]', path):
        if m.start() != at:
            break
        at = m.end()
        if m[1] is not None or m[2] is not None:
            steps.append(m[1] if m[1] is not None else m[2])
        elif m[3] is not None:
            steps.append(int(m[3]))
        else:
            steps.append(("#", int(m[4] or 0)))
    if at != len(path):
        raise ValueError(f"bad JSON path {path!r}")
    return steps


def _place(x, step) -> int | None:
    """Where a step leads inside x, None if nowhere."""
    if isinstance(step, str):
        return next((i for i, (k, _) in enumerate(x) if k == step), None) if isinstance(x, Members) else None
    if isinstance(x, Members) or not isinstance(x, list):
        return None
    i = step if isinstance(step, int) else len(x) - step[1]
    return i if 0 <= i < len(x) else None


def find(x, steps: list):
    for step in steps:
        i = _place(x, step)
        if i is None:
            return _MISSING
        x = x[i][1] if isinstance(x, Members) else x[i]
    return x


def kind(x) -> str:
    if isinstance(x, Members):
        return "object"
    if isinstance(x, list):
        return "array"
    if isinstance(x, Number):
        return "real" if re.search(r"[.eE]", x) else "integer"
    return {True: "true", False: "false", None: "null"}[x] if x is None or isinstance(x, bool) else "text"


def sql_text(x) -> str | None:
    """A node as the text of its SQL value; true and false are 1 and 0, containers JSON."""
    if x is None or x is _MISSING:
        return None
    if isinstance(x, bool):
        return str(int(x))
    return x if isinstance(x, str) else dump(x)


def edit(x, steps: list, value, create: bool, overwrite: bool):
    if not steps:
        return value if overwrite else x
    step, rest = steps[0], steps[1:]
    i = _place(x, step)
    if i is not None:
        if isinstance(x, Members):
            x[i] = (x[i][0], edit(x[i][1], rest, value, create, overwrite))
        else:
            x[i] = edit(x[i], rest, value, create, overwrite)
    elif create:
        new = value if not rest else edit(Members() if isinstance(rest[0], str) else [], rest, value, True, True)
        if isinstance(step, str) and isinstance(x, Members):
            x.append((step, new))
        elif isinstance(x, list) and not isinstance(x, Members) and (step == ("#", 0) or step == len(x)):
            x.append(new)
    return x


def remove(x, steps: list):
    if not steps:
        return _MISSING
    i = _place(x, steps[0])
    if i is not None:
        inner = remove(x[i][1] if isinstance(x, Members) else x[i], steps[1:])
        if inner is _MISSING:
            del x[i]
    return x


def merge(a, b):
    """RFC 7396."""
    if not isinstance(b, Members):
        return b
    a = Members(a) if isinstance(a, Members) else Members()
    for k, v in b:
        i = _place(a, k)
        if v is None:
            if i is not None:
                del a[i]
        elif i is None:
            a.append((k, merge(None, v)))
        else:
            a[i] = (k, merge(a[i][1], v))
    return a


def _udf(fn: Callable, returns: str = "string"):
    @F.pandas_udf(returns)
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else fn(v)).astype(object)

    return run


def _loose(fn: Callable):
    """Malformed JSON raises, as in the original semantics."""
    return lambda text: fn(parse(text))


def json_(x: Column) -> Column:
    """Validate and minify; malformed text raises."""
    return _udf(_loose(dump))(x)


def _valid(text: str) -> int:
    try:
        parse(text)
        return 1
    except (ValueError, RecursionError):
        return 0


def json_valid(x: Column) -> Column:
    return _udf(_valid, "int")(x)


def json_type(x: Column, path: str = "$") -> Column:
    steps = parse_path(path)
    return _udf(_loose(lambda v: None if (n := find(v, steps)) is _MISSING else kind(n)))(x)


def json_array_length(x: Column, path: str = "$") -> Column:
    """0 for what is no array, NULL where nothing is."""
    steps = parse_path(path)
    return _udf(_loose(lambda v: None if (n := find(v, steps)) is _MISSING else len(n) if isinstance(n, list) and not isinstance(n, Members) else 0), "int")(x)


def json_extract(x: Column, *paths: str) -> Column:
    """One path: the SQL value as text. Several: a JSON array of the nodes, null if missing."""
    steps = [parse_path(p) for p in paths]
    if len(steps) == 1:
        return _udf(_loose(lambda v: sql_text(find(v, steps[0]))))(x)
    return _udf(_loose(lambda v: dump([None if (n := find(v, s)) is _MISSING else n for s in steps])))(x)


def _key_path(key: str | int) -> list:
    if isinstance(key, int):
        return [key if key >= 0 else ("#", -key)]
    return parse_path(key) if key.startswith("$") else [key]


def arrow(x: Column, key: str | int) -> Column:
    """``->``: the JSON text of a node."""
    steps = _key_path(key)
    return _udf(_loose(lambda v: None if (n := find(v, steps)) is _MISSING else dump(n)))(x)


def arrow_text(x: Column, key: str | int) -> Column:
    """``->>``: the SQL value of a node, as text."""
    steps = _key_path(key)
    return _udf(_loose(lambda v: sql_text(find(v, steps))))(x)


def json_quote(x: Column, static: str) -> Column:
    """A value as a JSON literal; NULL gives null."""
    text = F.to_json(F.array(x)) if static == "string" else x.cast("string")
    return F.coalesce(F.substring(text, F.lit(2), F.char_length(text) - 2) if static == "string" else text, F.lit("null"))


def json_array(*items: tuple[Column, str]) -> Column:
    """Items are (column, static type); the type ``json`` splices JSON text."""
    return F.concat(F.lit("["), F.concat_ws(",", *[F.coalesce(c, F.lit("null")) if t == "json" else json_quote(c, t) for c, t in items]), F.lit("]"))


def json_object(*members: tuple[str, Column, str]) -> Column:
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(json.dumps(k) + ":"), F.coalesce(c, F.lit("null")) if t == "json" else json_quote(c, t)) for k, c, t in members]), F.lit("}"))


def _editor(create: bool, overwrite: bool):
    def make(x: Column, path: str, value: Column, static: str = "string") -> Column:
        steps = parse_path(path)

        @F.pandas_udf("string")
        def run(text: pd.Series, new: pd.Series) -> pd.Series:
            return pd.Series([None if t is None else dump(edit(parse(t), steps, parse(v), create, overwrite)) for t, v in zip(text, new, strict=True)], dtype=object)

        return run(x, F.coalesce(value, F.lit("null")) if static == "json" else json_quote(value, static))

    return make


json_set, json_insert, json_replace = _editor(True, True), _editor(True, False), _editor(False, True)


def json_remove(x: Column, *paths: str) -> Column:
    steps = [parse_path(p) for p in paths]

    def run(v):
        for s in steps:
            v = remove(v, s)
            if v is _MISSING:
                return None
        return dump(v)

    return _udf(_loose(run))(x)


def json_patch(x: Column, patch: Column) -> Column:
    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or t is None else dump(merge(parse(s), parse(t))) for s, t in zip(a, b, strict=True)], dtype=object)

    return run(x, patch)


def describe(x: Column) -> Column:
    """A struct of ``valid``, ``kind`` and minified ``text`` by one parse; the last two are NULL
    for malformed text, which raises nothing here."""

    @F.pandas_udf("valid int, kind string, text string")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            if t is None:
                rows.append((None, None, None))
                continue
            try:
                value = parse(t)
                rows.append((1, kind(value), dump(value)))
            except (ValueError, RecursionError):
                rows.append((0, None, None))
        return pd.DataFrame(rows, columns=["valid", "kind", "text"]).astype({"valid": "Int32"})

    return run(x)
