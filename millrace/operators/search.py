"""Full-text search: tokenizers, postings, and the MATCH grammar.

``a b`` and ``a AND b``, ``a OR b``, ``a NOT b``, parentheses, ``pre*``, ``col:term``,
``{c d}:term``, ``^first``. The query is parsed on the driver; each of its terms is one
aggregated look-up in the postings, whatever the number of documents.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Latin letters with a diacritic in Latin-1 and Latin Extended-A fold to their base letter.
_FOLD = {chr(c): d for c in range(0xC0, 0x180) if len(d := "".join(x for x in unicodedata.normalize("NFD", chr(c).lower()) if not unicodedata.combining(x))) == 1 and d.isascii() and d.isalpha()}


def folded(x: Column, tokenizer: str = "unicode61") -> Column:
    """The text that terms are cut from."""
    x = F.coalesce(x, F.lit(""))
    if tokenizer == "ascii":
        return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.translate(F.lower(x), "".join(k for k in _FOLD if k == k.lower()), "".join(v for k, v in _FOLD.items() if k == k.lower()))


def tokens(x: Column, tokenizer: str = "unicode61") -> Column:
    """Terms in order: letters and digits, folded."""
    pattern = r"([a-z0-9\x{80}-\x{10FFFF}]+)" if tokenizer == "ascii" else r"([\p{L}\p{N}\p{Co}]+)"
    return F.regexp_extract_all(folded(x, tokenizer), F.lit(pattern), 1)


def _fold(term: str, tokenizer: str) -> str:
    if tokenizer == "ascii":
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in term)
    return "".join(_FOLD.get(c, c) for c in term.lower())


def postings(df: DataFrame, pk: str, columns: list[str], tokenizer: str = "unicode61") -> DataFrame:
    """(docid, col, term, pos)."""
    parts = [df.select(F.col(pk).alias("docid"), F.lit(c).alias("col"), F.posexplode(tokens(F.col(c), tokenizer)).alias("pos", "term")) for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.select("docid", "col", "term", "pos")


@dataclass(frozen=True)
class Term:
    text: str
    prefix: bool = False
    first: bool = False
    columns: tuple[str, ...] | None = None


def parse_match(query: str):
    """A Term, or ("and" | "or" | "not", left, right)."""
    words = re.findall(r'\(|\)|\{[^}]*\}\s*:|"[^"]*"\*?|\^?[\w\x80-\U0010ffff]+\s*:|\^?[\w\x80-\U0010ffff]+\*?|\S', query)
    at = 0

    def peek() -> str | None:
        return words[at] if at < len(words) else None

    def take() -> str:
        nonlocal at
        at += 1
        return words[at - 1]

    def either():
        left = both()
        while peek() == "OR":
            take()
            left = ("or", left, both())
        return left

    def both():
        left = without()
        while peek() not in (None, ")", "OR"):
            if peek() == "AND":
                take()
            left = ("and", left, without())
        return left

    def without():
        left = one()
        while peek() == "NOT":
            take()
            left = ("not", left, one())
        return left

    def one(columns: tuple[str, ...] | None = None):
        if peek() is None:
            raise ValueError("MATCH: a term is missing")
        word = take()
        if word in ("AND", "OR", "NOT", ")"):
            raise ValueError(f"MATCH: {word} needs a term before it")
        if word == "(":
            inner = either()
            if peek() != ")":
                raise ValueError("MATCH: ) is missing")
            take()
            return inner
        if word.endswith(":"):
            return one(tuple(word.rstrip(": \t").strip("{}").split()))
        first, word = word.startswith("^"), word.lstrip("^")
        prefix, word = word.endswith("*"), word.rstrip("*").strip('"')
        if not re.fullmatch(r"[\w\x80-\U0010ffff]+", word):
            raise ValueError(f"MATCH: {word!r} is not a term")
        return Term(word, prefix, first, columns)

    out = either()
    if peek() is not None:
        raise ValueError(f"MATCH: unexpected {peek()!r}")
    return out


def terms_of(tree) -> list[Term]:
    return [tree] if isinstance(tree, Term) else terms_of(tree[1]) + terms_of(tree[2])


def match(index: DataFrame, query: str, tokenizer: str = "unicode61") -> DataFrame:
    """docids whose postings satisfy the query: one scan of the postings that any term wants
    and one aggregate by document, however many terms there are."""
    tree = parse_match(query)
    leaves = list(dict.fromkeys(terms_of(tree)))

    def wants(t: Term) -> Column:
        text = _fold(t.text, tokenizer)
        out = F.col("term").startswith(text) if t.prefix else F.col("term") == text
        if t.columns:
            out = out & F.col("col").isin(*t.columns)
        return out & (F.col("pos") == 0) if t.first else out

    any_of = F.lit(False)
    for t in leaves:
        any_of = any_of | wants(t)
    seen = index.where(any_of).groupBy("docid").agg(*[F.max(wants(t)).alias(f"t{i}") for i, t in enumerate(leaves)])

    def holds(node) -> Column:
        if isinstance(node, Term):
            return F.col(f"t{leaves.index(node)}")
        left, right = holds(node[1]), holds(node[2])
        return left & right if node[0] == "and" else left | right if node[0] == "or" else left & ~right

    return seen.where(holds(tree)).select("docid")


def match_text(columns: dict[str, str], query: str, tokenizer: str = "unicode61") -> str:
    """The condition ``MATCH query`` as SQL text over the token arrays of a row's columns
    (name: expression): a scan that makes no postings. A term without a column may stand in
    any of them. A text is cut into tokens once, and only if it holds the terms as
    substrings, which every token is."""
    from ..plans.sqlfunctions import text_of

    spark = SparkSession.getActiveSession()
    names = list(columns)

    def written(c: Column, name: str) -> str:
        return text_of(spark, c).replace("_x", columns[name])

    def literal(t: Term) -> str:
        return "'" + _fold(t.text, tokenizer).replace("\\", "\\\\").replace("'", "\\'") + "'"

    def of(t: Term) -> list[int]:
        return [i for i, c in enumerate(names) if not t.columns or c.lower() in {x.lower() for x in t.columns}]

    def combined(node, leaf, negate: bool) -> str:
        if isinstance(node, Term):
            parts = [leaf(node, i) for i in of(node)]
            return "(" + " OR ".join(parts) + ")" if parts else "false"
        left = combined(node[1], leaf, negate)
        if node[0] == "not":
            return f"({left} AND NOT {combined(node[2], leaf, negate)})" if negate else left
        return f"({left} {node[0].upper()} {combined(node[2], leaf, negate)})"

    def exact(t: Term, i: int) -> str:
        array, text = f"_r.c{i}", literal(t)
        if t.prefix:
            found = f"startswith(get({array}, 0), {text})" if t.first else f"exists({array}, _w -> startswith(_w, {text}))"
        else:
            found = f"(get({array}, 0) = {text})" if t.first else f"array_contains({array}, {text})"
        return f"coalesce({found}, false)"

    tree = parse_match(query)
    used = sorted({i for t in terms_of(tree) for i in of(t)})
    if not used:
        return "false"
    rough = combined(tree, lambda t, i: f"contains({written(folded(F.col('_x'), tokenizer), names[i])}, {literal(t)})", False)
    row = ", ".join(f"'c{i}', {written(tokens(F.col('_x'), tokenizer), names[i])}" for i in used)
    return f"({rough} AND exists(array(named_struct({row})), _r -> {combined(tree, exact, True)}))"


def scan(df: DataFrame, columns: list[str], query: str, tokenizer: str = "unicode61") -> DataFrame:
    """Rows that match, by one pass over the texts: for a query that is asked once. ``match``
    over stored postings is for many."""
    return df.where(F.expr(match_text({c: f"`{c}`" for c in columns}, query, tokenizer)))
