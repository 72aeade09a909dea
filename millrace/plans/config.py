"""Tables from a TOML file: ``[[table]]`` with ``[[table.column]]`` and ``[[table.index]]``."""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.sql import types as T

from ..functions import anytype
from .database import Database

_TYPES = {"int64": "bigint", "float64": "double", "text": "string", "blob": "binary", "bool": "boolean", "timestamp": "timestamp", "date": "date", "time": "bigint", "numeric": "decimal(38,16)", "any": anytype.TYPE}


def load(db: Database, path: str | Path) -> list[str]:
    """Create the file's tables that are not there; a table that is there and differs raises."""
    made = []
    for t in tomllib.loads(Path(path).read_text()).get("table", []):
        fields, facts = [], {"pk": t.get("primary_key", []), "unique": [], "not_null": [], "checks": [], "defaults": {}}
        for c in t.get("column", []):
            if c["type"] not in _TYPES:
                raise ValueError(f"{t['name']}.{c['name']}: unknown type {c['type']!r}")
            if c["type"] == "any" and (c["name"] in facts["pk"] or c.get("unique")):
                raise ValueError(f"{t['name']}.{c['name']}: an any column cannot be a key")
            fields.append(T.StructField(c["name"], T._parse_datatype_string(_TYPES[c["type"]])))
            if not c.get("nullable", True):
                facts["not_null"].append(c["name"])
            if c.get("unique"):
                facts["unique"].append([c["name"]])
            if c.get("check"):
                facts["checks"].append(c["check"])
            if "default" in c:
                facts["defaults"][c["name"]] = db._literal(c["default"])
        facts["unique"] += [i["columns"] for i in t.get("index", []) if i.get("unique")]
        schema = T.StructType(fields)
        if t["name"] in db.catalog.state["tables"]:
            if db.catalog.schema(t["name"]) != schema:
                raise ValueError(f"table {t['name']} differs from its file")
            continue
        db.catalog.create(t["name"], schema, **facts)
        made.append(t["name"])
    db._refresh()
    return made
