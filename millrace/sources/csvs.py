"""CSV and TSV: sniffed delimiter and header, and a schema that all cells must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SNIFF = 20
_INT, _REAL = r"^-?(0|[1-9]\d{0,17})$", r"^-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?$"


def sniff(lines: list[str]) -> tuple[str, bool]:
    """(delimiter, header) from some first lines: the delimiter that splits all of them into
    the same, largest number of cells; a header has no number among its cells and the rest
    of some column does."""
    import csv
    import re

    best, width = ",", 1
    for d in ",\t;|":
        sizes = {len(r) for r in csv.reader(lines, delimiter=d) if r}
        if len(sizes) == 1 and (n := sizes.pop()) > width:
            best, width = d, n
    rows = [r for r in csv.reader(lines, delimiter=best) if r]
    number = lambda c: bool(re.match(_REAL, c))
    header = len(rows) > 0 and not any(number(c) or c == "" for c in rows[0]) and len(set(rows[0])) == len(rows[0]) and (len(rows) == 1 or any(number(r[i]) for r in rows[1:] for i in range(min(len(r), width))))
    return best, header


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, header: bool | None = None) -> DataFrame:
    """int64 or float64 only where every non-empty cell qualifies (a leading zero keeps a
    column text); empty cells are NULL in those and empty text elsewhere. One pass finds the
    types as aggregates, a second reads."""
    first = [r["value"] for r in spark.read.text(path).limit(_SNIFF).collect()]
    d, h = sniff(first) if first else (",", False)
    delimiter, header = delimiter or d, h if header is None else header
    raw = spark.read.option("sep", delimiter).option("header", header).option("multiLine", True).option("quote", '"').option("escape", '"').option("nullValue", None).option("emptyValue", "").csv(path)
    if not raw.columns:
        return raw
    if not header:
        raw = raw.toDF(*[f"c{i + 1}" for i in range(len(raw.columns))])
    facts = []
    for i, c in enumerate(raw.columns):
        x = F.nullif(F.col(f"`{c}`"), F.lit(""))
        facts += [F.count(x).alias(f"n{i}"), F.count(F.when(x.rlike(_INT), 1)).alias(f"i{i}"), F.count(F.when(x.rlike(_REAL), 1)).alias(f"r{i}")]
    got = raw.agg(*facts).first()
    out = []
    for i, c in enumerate(raw.columns):
        x, n = F.col(f"`{c}`"), got[f"n{i}"]
        kind = "string" if n == 0 else "long" if got[f"i{i}"] == n else "double" if got[f"r{i}"] == n else "string"
        out.append((F.coalesce(x, F.lit("")) if kind == "string" else F.nullif(x, F.lit("")).cast(kind)).alias(c))
    return raw.select(*out)
