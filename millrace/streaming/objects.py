"""Versions of binary objects: put, get, prune, and archives of many in one."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def put(store: DataFrame, objects: DataFrame, version: int) -> DataFrame:
    """Append (name, data) as a version, without objects whose content has not changed."""
    last = get(store).select("name", F.sha2("data", 256).alias("_h"))
    new = objects.withColumn("_n", F.sha2("data", 256)).join(last, "name", "left").where(~F.col("_n").eqNullSafe(F.col("_h")))
    return store.unionByName(new.select("name", F.lit(version).cast("long").alias("version"), "data"))


def get(store: DataFrame, at: int | None = None) -> DataFrame:
    """The newest version of each object, or the newest up to ``at``."""
    rows = store if at is None else store.where(F.col("version") <= at)
    return rows.groupBy("name").agg(F.max("version").alias("version"), F.max_by("data", "version").alias("data"))


def prune(store: DataFrame, keep: int) -> DataFrame:
    w = Window.partitionBy("name").orderBy(F.desc("version"))
    return store.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).drop("_r")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, data) of files, whole."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").alias("data"))


def chunks(objects: DataFrame, size: int) -> DataFrame:
    """(name, part, data): objects as a stream of parts of ``size`` bytes."""
    parts = F.sequence(F.lit(0), F.greatest(F.ceil(F.octet_length("data") / size).cast("int") - 1, F.lit(0)))
    out = objects.select("name", F.explode(parts).alias("part"), "data")
    return out.select("name", "part", F.expr(f"substring(data, part * {size} + 1, {size})").alias("data"))


def unpack(archives: DataFrame) -> DataFrame:
    """(archive, name, data) of the members of zip archives in (name, data)."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for name, data in zip(pdf["name"], pdf["data"], strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    rows += [(name, m, z.read(m)) for m in z.namelist() if not m.endswith("/")]
            yield pd.DataFrame(rows, columns=["archive", "name", "data"])

    return archives.select("name", "data").mapInPandas(run, "archive string, name string, data binary")


DELTAS = "name string, version long, base long, prefix long, suffix long, data binary"


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


def to_deltas(store: DataFrame) -> DataFrame:
    """Versions as what differs from the version before: the bytes between a common prefix and
    a common suffix (``DELTAS``). The first version of an object is whole. One object's
    versions are one task's."""

    def run(pdf):
        import pandas as pd

        rows, last = [], None
        for r in pdf.sort_values("version").itertuples():
            data = bytes(r.data) if r.data is not None else b""
            if last is None:
                rows.append((r.name, r.version, None, 0, 0, data))
            else:
                a = _common(last[1], data)
                rest = min(len(last[1]), len(data)) - a
                b = _common(last[1][::-1][:rest], data[::-1][:rest])
                rows.append((r.name, r.version, last[0], a, b, data[a : len(data) - b]))
            last = (r.version, data)
        return pd.DataFrame(rows, columns=["name", "version", "base", "prefix", "suffix", "data"]).astype({"base": "Int64"})

    return store.select("name", "version", "data").groupBy("name").applyInPandas(lambda pdf: run(pdf), DELTAS)


def from_deltas(deltas: DataFrame) -> DataFrame:
    """The versions again; a delta whose base is not there raises."""

    def run(pdf):
        import pandas as pd

        rows, known = [], {}
        for r in pdf.sort_values("version").itertuples():
            data = bytes(r.data)
            if not pd.isna(r.base):
                if int(r.base) not in known:
                    raise ValueError(f"version {int(r.base)} of {r.name} is not there")
                old = known[int(r.base)]
                data = old[: r.prefix] + data + old[len(old) - r.suffix :]
            known[r.version] = data
            rows.append((r.name, r.version, data))
        return pd.DataFrame(rows, columns=["name", "version", "data"])

    return deltas.groupBy("name").applyInPandas(lambda pdf: run(pdf), "name string, version long, data binary")


def pack_archives(objects: DataFrame, archive: str = "archive") -> DataFrame:
    """(name, data): one zip archive for each value of ``archive``, members in order of name;
    an archive is put together by one task."""

    def run(pdf):
        import pandas as pd

        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for r in pdf.sort_values("name").itertuples():
                z.writestr(zipfile.ZipInfo(r.name), bytes(r.data), zipfile.ZIP_DEFLATED)
        return pd.DataFrame({"name": [pdf[archive].iloc[0]], "data": [out.getvalue()]})

    return objects.select(archive, "name", "data").groupBy(archive).applyInPandas(lambda pdf: run(pdf), "name string, data binary")
