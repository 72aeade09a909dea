"""Tables as versioned Parquet folders: DDL, snapshots, transactions with savepoints.

A version of a table is a list of folders of files; the catalog file names the versions. A
write makes a new folder and never touches an old one, so readers keep their snapshot,
ROLLBACK drops names only, and any path that Spark reaches will do. Appended rows make a
folder of their own beside the old ones: only they are written and checked, and their keys
are looked up in the table by a semi join. The catalog file is written aside and renamed,
and a writer that finds another's changes in it fails instead of undoing them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import constraints


class Catalog:
    """Tables under one root. Metadata is small and goes through Spark's file system, so the
    root may be remote."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.stack: list[tuple[str, dict]] = []
        self.state: dict = self._load() or {"tables": {}}
        for part in ("views", "triggers"):
            self.state.setdefault(part, {})
        self.state.setdefault("number", 0)

    @property
    def views(self) -> dict[str, str]:
        return self.state["views"]

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _load(self) -> dict | None:
        fs, p = self._fs(f"{self.root}/catalog.json")
        if not fs.exists(p):
            return None
        return json.loads("\n".join(r["value"] for r in self.spark.read.text(f"{self.root}/catalog.json", wholetext=True).collect()))

    def _save(self) -> None:
        if self.stack:
            return
        there = self._load()
        if there and there.get("number", 0) != self.state["number"]:
            raise RuntimeError("the catalog was changed by another writer; open it again")
        self.state["number"] += 1
        jvm, name = self.spark._jvm, f"{self.root}/catalog.json"
        fs, aside = self._fs(f"{name}.{uuid.uuid4().hex}")
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps(self.state).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration())
        how = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(fs.makeQualified(aside), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(name)), how)

    def create(self, name: str, schema: str | T.StructType, if_not_exists: bool = False, pk: list[str] | None = None, unique: list[list[str]] | None = None, not_null: list[str] | None = None, checks: list[str] | None = None, defaults: dict[str, str] | None = None, generated: dict[str, str] | None = None, comment: str | None = None) -> None:
        if name in self.state["tables"]:
            if if_not_exists:
                return
            raise ValueError(f"table {name} already exists")
        schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        self.state["tables"][name] = {"schema": schema.json(), "versions": [], "pk": pk or [], "unique": unique or [], "not_null": [*(not_null or []), *(pk or [])], "checks": checks or [], "defaults": defaults or {}, "generated": generated or {}, "comments": {"": comment} if comment else {}}
        self._save()

    def drop(self, *names: str, if_exists: bool = False) -> None:
        for n in names:
            if self.state["tables"].pop(n, None) is None and not if_exists:
                raise ValueError(f"no such table: {n}")
        self._save()

    def info(self, name: str) -> dict:
        if name not in self.state["tables"]:
            raise ValueError(f"no such table: {name}")
        return self.state["tables"][name]

    def schema(self, name: str) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.info(name)["schema"]))

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """The current snapshot, or version 0, 1, ... of the table's history."""
        info, schema = self.info(name), self.schema(name)
        if not info["versions"]:
            return self.spark.createDataFrame([], schema)
        return self._read(name, schema, info["versions"][-1 if version is None else version])

    def _read(self, name: str, schema: T.StructType, folders: list[str] | str) -> DataFrame:
        folders = [folders] if isinstance(folders, str) else folders
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{name}/{f}" for f in folders])

    def violations(self, name: str, df: DataFrame, old: DataFrame | None = None) -> dict[str, DataFrame]:
        """Rows of ``df`` that break a constraint, by constraint. With ``old``, ``df`` are rows
        added to it: keys are looked up there too."""
        info, out = self.info(name), {}
        if info["not_null"]:
            out["not null"] = constraints.not_null(df, *info["not_null"])
        for u, where in [(info["pk"], None), *((u, None) for u in info["unique"]), *((p["columns"], p["where"]) for p in info.get("partial", []))]:
            if u:
                what = f"unique {', '.join(u)}"
                inside = (lambda t, w=where: t if w is None else t.where(F.expr(w)))
                out[what] = constraints.unique(inside(df), u)
                if old is not None:
                    again = inside(old).join(inside(df).select(*u), u, "left_semi").select(*u)
                    out[f"{what} "] = again
        for c in info["checks"]:
            out[f"check {c}"] = constraints.check(df, F.expr(c))
        return out

    def _written(self, name: str, df: DataFrame, old: DataFrame | None) -> tuple[str, DataFrame]:
        info, schema = self.info(name), self.schema(name)
        made = {k: F.expr(v) for k, v in info["generated"].items()}
        df = constraints.generated(df, made).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
        folder = uuid.uuid4().hex
        df.write.parquet(f"{self.root}/{name}/{folder}")
        saved = self._read(name, schema, folder)
        for what, rows in self.violations(name, saved, old).items():
            if not rows.isEmpty():
                raise ValueError(f"{what.strip()} constraint failed: {name}")
        return folder, saved

    def replace(self, name: str, df: DataFrame) -> DataFrame:
        """A new snapshot, checked before it becomes current."""
        folder, saved = self._written(name, df, None)
        info = self.info(name)
        info["versions"] = [*info["versions"], [folder]]
        self._save()
        return saved

    def append(self, name: str, rows: DataFrame) -> DataFrame:
        """A new snapshot with rows added: what was there is neither written nor checked again.
        Returns the rows."""
        info = self.info(name)
        folder, saved = self._written(name, rows, self.table(name) if info["versions"] else None)
        last = info["versions"][-1] if info["versions"] else []
        info["versions"] = [*info["versions"], [*([last] if isinstance(last, str) else last), folder]]
        self._save()
        return saved

    def compact(self, name: str) -> None:
        """The current snapshot in one folder."""
        self.replace(name, self.table(name))

    def alter(self, name: str, rename_to: str | None = None, rename_column: tuple[str, str] | None = None, add_column: tuple[str, str, Column | None] | None = None, drop_column: str | None = None) -> None:
        df, info = self.table(name), self.info(name)
        if rename_to:
            self.state["tables"][rename_to] = self.state["tables"].pop(name)
            self.create_version(rename_to, df)
            return
        if rename_column:
            df = df.withColumnRenamed(*rename_column)
            swap = lambda c: rename_column[1] if c == rename_column[0] else c
            for k in ("pk", "not_null"):
                info[k] = [swap(c) for c in info[k]]
            info["unique"] = [[swap(c) for c in u] for u in info["unique"]]
        if add_column:
            c, kind, default = add_column
            df = df.withColumn(c, (F.lit(None) if default is None else default).cast(kind))
        if drop_column:
            if drop_column in info["pk"]:
                raise ValueError("a primary key column cannot be dropped")
            df = df.drop(drop_column)
        info["schema"] = df.schema.json()
        self.create_version(name, df)

    def create_version(self, name: str, df: DataFrame) -> None:
        self.info(name)["versions"] = []
        self.replace(name, df)

    def comment(self, name: str, text: str, column: str = "") -> None:
        self.info(name)["comments"][column] = text
        self._save()

    def view(self, name: str, sql: str, df: DataFrame | None = None) -> None:
        """A view by its text, which the catalog keeps; ``df`` is what another dialect makes of it."""
        self.state["views"][name] = sql
        (self.spark.sql(sql) if df is None else df).createOrReplaceTempView(name)
        self._save()

    def drop_view(self, name: str) -> None:
        del self.state["views"][name]
        self.spark.catalog.dropTempView(name)
        self._save()

    def attach(self, alias: str, path: str) -> Catalog:
        """Another root; its tables become views ``alias_table``."""
        other = Catalog(self.spark, path)
        for t in other.state["tables"]:
            other.table(t).createOrReplaceTempView(f"{alias}_{t}")
        return other

    def begin(self) -> None:
        if self.stack:
            raise ValueError("a transaction is open")
        self.savepoint("")

    def savepoint(self, name: str) -> None:
        self.stack.append((name, json.loads(json.dumps(self.state))))

    def release(self, name: str) -> None:
        self._find(name)
        while self.stack.pop()[0] != name:
            pass

    def _find(self, name: str) -> int:
        at = [i for i, (n, _) in enumerate(self.stack) if n == name]
        if not at:
            raise ValueError(f"no such savepoint: {name}")
        return at[-1]

    def rollback(self, to: str | None = None) -> None:
        if to is None:
            self.state, self.stack = self.stack[0][1], []
            self._save()
        else:
            i = self._find(to)
            self.state = json.loads(json.dumps(self.stack[i][1]))
            del self.stack[i + 1 :]

    def commit(self) -> None:
        self.stack = []
        self._save()


def overlay(base: DataFrame, upserts: DataFrame, deletes: DataFrame, key: list[str]) -> DataFrame:
    """A read-only base seen through a delta: tombstones hide, upserts replace."""
    gone = upserts.select(*key).unionAll(deletes.select(*key)).distinct()
    return base.join(gone, key, "left_anti").select(*base.columns).unionByName(upserts.select(*base.columns))


def hash_sharded(df: DataFrame, key: list[str], shards: int, path: str) -> None:
    """One folder a shard (``shard=k``): a query with the key reads its own folder only."""
    df.withColumn("shard", F.pmod(F.xxhash64(*key), F.lit(shards))).repartition(shards, "shard").write.mode("overwrite").partitionBy("shard").parquet(path)


def read_shard(spark: SparkSession, path: str, shards: int, **key) -> DataFrame:
    """Rows of one key, by partition pruning."""
    types = {f.name: f.dataType for f in spark.read.parquet(path).schema}
    shard = spark.range(1).select(F.pmod(F.xxhash64(*[F.lit(v).cast(types[k]) for k, v in key.items()]), F.lit(shards))).first()[0]
    df = spark.read.parquet(path).where(F.col("shard") == shard)
    for k, v in key.items():
        df = df.where(F.col(k) == v)
    return df.drop("shard")
