"""PL/pgSQL functions: one CREATE FUNCTION statement becomes a checked Python function.

DECLARE, assignment (``:=`` or ``=``), IF / ELSIF / ELSE, WHILE, LOOP, FOR over integer ranges
(REVERSE, BY), EXIT and CONTINUE (WHEN), RETURN; arithmetic, comparisons, AND / OR / NOT, IS
[NOT] NULL, casts as identities. No SQL inside. NULL operands give NULL; a NULL condition
is not true.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from .engine import compile_pure

_WORD = re.compile(r"\s+|--[^\n]*|'(?:[^']|'')*'|:=|\.\.|<>|!=|<=|>=|\|\||::\s*\w+|\d+\.\d+|\d+|\w+|.", re.S)


def _expression(text: str) -> str:
    """An SQL expression as one of the helpers that know NULL."""
    toks = [t for t in _WORD.findall(text) if not t.isspace() and not t.startswith(("--", "::"))]
    at = 0

    def peek() -> str:
        return toks[at].upper() if at < len(toks) else ""

    def take() -> str:
        nonlocal at
        at += 1
        return toks[at - 1]

    def chain(inner: Callable[[], str], names: dict[str, str]) -> str:
        left = inner()
        while peek() in names:
            name = names[take().upper()]
            left = f"{name}({left}, {inner()})"
        return left

    def either() -> str:
        return chain(both, {"OR": "sql_or"})

    def both() -> str:
        return chain(negated, {"AND": "sql_and"})

    def negated() -> str:
        if peek() == "NOT":
            take()
            return f"sql_not({negated()})"
        return compared()

    def compared() -> str:
        left = joined()
        while True:
            if peek() == "IS":
                take()
                no = peek() == "NOT" and bool(take())
                take()
                left = f"sql_isnull({left}, {no})"
            elif peek() in ("=", "<>", "!=", "<", ">", "<=", ">="):
                op = take()
                left = f"sql_cmp({left}, {'==' if op == '=' else '!=' if op == '<>' else op!r}, {joined()})".replace("==,", "'==',").replace(" !=,", " '!=',")
            else:
                return left

    def joined() -> str:
        return chain(summed, {"||": "sql_concat"})

    def summed() -> str:
        return chain(product, {"+": "sql_add", "-": "sql_sub"})

    def product() -> str:
        return chain(signed, {"*": "sql_mul", "/": "sql_div", "%": "sql_mod"})

    def signed() -> str:
        if peek() in ("-", "+"):
            return f"sql_sub(0, {signed()})" if take() == "-" else signed()
        return atom()

    def atom() -> str:
        t = take()
        if t == "(":
            inner = either()
            take()
            return inner
        if t.startswith("'"):
            return repr(t[1:-1].replace("''", "'"))
        if t.upper() in ("NULL", "TRUE", "FALSE"):
            return {"NULL": "None", "TRUE": "True", "FALSE": "False"}[t.upper()]
        if peek() == "(" and t.lower() in ("abs",):
            take()
            inner = either()
            take()
            return f"sql_abs({inner})"
        if not re.fullmatch(r"[A-Za-z]\w*|\d+(\.\d+)?", t):
            raise ValueError(f"PL/pgSQL: unexpected {t!r}")
        return t if t[0].isdigit() else f"v_{t.lower()}"

    out = either()
    if at != len(toks):
        raise ValueError(f"PL/pgSQL: unexpected {toks[at]!r}")
    return out


def _null_safe(fn: Callable) -> Callable:
    return lambda *xs: None if any(x is None for x in xs) else fn(*xs)


def _div(a, b):
    if isinstance(a, int) and isinstance(b, int):
        q = abs(a) // abs(b)
        return q if (a < 0) == (b < 0) else -q
    return a / b


_COMPARE = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}
HELPERS: dict[str, Callable] = {
    "sql_add": _null_safe(lambda a, b: a + b), "sql_sub": _null_safe(lambda a, b: a - b), "sql_mul": _null_safe(lambda a, b: a * b), "sql_div": _null_safe(_div),
    "sql_mod": _null_safe(lambda a, b: a - b * _div(a, b) if isinstance(a, int) else a % b), "sql_concat": _null_safe(lambda a, b: f"{a}{b}"), "sql_abs": _null_safe(abs),
    "sql_cmp": lambda a, op, b: None if a is None or b is None else _COMPARE[op](a, b), "sql_isnull": lambda a, no: (a is not None) if no else a is None,
    "sql_not": _null_safe(lambda a: not a), "sql_and": lambda a, b: False if a is False or b is False else None if a is None or b is None else True,
    "sql_or": lambda a, b: True if a is True or b is True else None if a is None or b is None else False,
}


def to_python(sql: str) -> str:
    """The Python source of a CREATE FUNCTION ... LANGUAGE plpgsql statement."""
    m = re.search(r"(?is)create\s+(?:or\s+replace\s+)?function\s+(\w+)\s*\((.*?)\)\s*returns\s+\w+.*?\$(\w*)\$(.*)\$\3\$", sql)
    if not m:
        raise ValueError("PL/pgSQL: a CREATE FUNCTION statement is expected")
    params = [p.split()[0].lower() for p in m[2].split(",") if p.strip()]
    body = re.sub(r"--[^\n]*", "", m[4])
    head, _, rest = re.sub(r"(?is)^\s*declare", "DECLARE", body).partition("BEGIN") if re.match(r"(?is)\s*declare", body) else ("", "", re.sub(r"(?is)^\s*begin", "", body))
    if not rest and head:
        head, rest = re.split(r"(?i)\bbegin\b", body, maxsplit=1)
    rest = re.sub(r"(?is)\bend\s*;?\s*$", "", rest)
    out = [f"def {m[1].lower()}({', '.join('v_' + p for p in params)}):"]
    for d in [x.strip() for x in re.sub(r"(?i)^\s*declare", "", head).split(";") if x.strip()]:
        name, value = re.match(r"(?is)(\w+)\s+[\w() ]+?(?:\s*(?::=|=|\bdefault\b)\s*(.*))?$", d).groups()
        out.append(f"    v_{name.lower()} = {_expression(value) if value else 'None'}")
    level = 1

    def put(line: str) -> None:
        out.append("    " * level + line)

    text = re.sub(r"(?i)\b(then|loop|else)\b", r"\1;", rest)
    for raw in [x.strip() for x in text.split(";") if x.strip()]:
        word = raw.split()[0].upper()
        if word in ("IF", "ELSIF", "ELSEIF", "WHILE"):
            test = _expression(re.match(r"(?is)\w+\s+(.*?)\s+(?:then|loop)$", raw)[1])
            level -= word.startswith("ELS")
            put(f"{'elif' if word.startswith('ELS') else word.lower()} ({test}) == True:")
            level += 1
        elif word == "ELSE":
            level -= 1
            put("else:")
            level += 1
        elif word == "FOR":
            v, back, lo, hi, by = re.match(r"(?is)for\s+(\w+)\s+in\s+(reverse\s+)?(.*?)\s*\.\.\s*(.*?)(?:\s+by\s+(.*?))?\s+loop$", raw).groups()
            a, b, s = _expression(lo), _expression(hi), _expression(by) if by else "1"
            put(f"for v_{v.lower()} in " + (f"range({a}, {b} - 1, -({s})):" if back else f"range({a}, {b} + 1, {s}):"))
            level += 1
        elif word == "LOOP":
            put("while True:")
            level += 1
        elif word == "END":
            put("pass")
            level -= 1
        elif word in ("EXIT", "CONTINUE"):
            stop = "break" if word == "EXIT" else "continue"
            when = re.match(r"(?is)\w+\s+when\s+(.*)", raw)
            put(f"if ({_expression(when[1])}) == True:" if when else stop)
            if when:
                out.append("    " * (level + 1) + stop)
        elif word == "RETURN":
            put(f"return {_expression(raw[6:]) if raw[6:].strip() else 'None'}")
        elif word == "NULL":
            put("pass")
        else:
            name, value = re.match(r"(?is)(\w+)\s*(?::=|=)\s*(.*)", raw).groups()
            put(f"v_{name.lower()} = {_expression(value)}")
    return "\n".join(out) + "\n"


def compile_function(sql: str, budget: int = 1_000_000) -> tuple[str, Callable]:
    """(name, function), under the same checks and step budget as Python bodies."""
    return compile_pure(to_python(sql), budget, HELPERS)
