"""Workload models: tables by role, and the structures derived from them.

A model is a dict: ``{"tables": {name: {"role": "fact" | "dimension" | "edge" | "embedding",
"key": [...]}}, "derived": {name: {"kind": "counter" | "reverse-edge" | "rollup", "of": table,
"by": [...], "sum": [...]}}}``. Derived structures are views until they are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import reverse_edges

ROLES = ("fact", "dimension", "edge", "embedding")


def check(model: dict) -> None:
    for name, t in model.get("tables", {}).items():
        if t.get("role") not in ROLES:
            raise ValueError(f"{name}: unknown role {t.get('role')!r}")
    for name, d in model.get("derived", {}).items():
        if d.get("of") not in model["tables"] or d.get("kind") not in ("counter", "reverse-edge", "rollup"):
            raise ValueError(f"{name}: of {d.get('of')!r}, kind {d.get('kind')!r}")


def derive(model: dict, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    check(model)
    out = {}
    for name, d in model.get("derived", {}).items():
        base = tables[d["of"]]
        if d["kind"] == "reverse-edge":
            out[name] = reverse_edges(base)
        else:
            sums = [F.sum(c).alias(f"sum_{c}") for c in d.get("sum", [])] if d["kind"] == "rollup" else []
            out[name] = base.groupBy(*d["by"]).agg(F.count("*").alias("n"), *sums)
    return out
