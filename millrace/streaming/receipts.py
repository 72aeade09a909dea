"""Receipts that arrive in chunks, the ways an edge gets its rows, and kept conflicts.

A receipt's chunks are staged as folders under one root, each under its own number, so that a
chunk sent again replaces itself and a receipt that was broken off goes on where it stopped.
Nothing reaches the target before ``finish``.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ingest


class Strategy(Enum):
    """How an edge gets its rows, and what that way cannot see."""

    DUMP = "dump"  # the whole table: the only one that sees deletes and judges a cursor
    DELTA = "delta"  # rows past the watermark
    PROBE_FETCH = "probe_fetch"  # a cheap look whether anything changed, then a dump or delta
    WEBHOOK = "webhook"  # pushed rows: needs a dump edge beside it
    PAGE_CURSOR = "page_cursor"  # a dump in pages, resumable by page number

    @property
    def dump(self) -> bool:
        return self in (Strategy.DUMP, Strategy.PAGE_CURSOR)


def check_edges(strategies: list[str]) -> list[Strategy]:
    """The strategies of one target's edges; pushed rows alone would lose deletes for good."""
    known = [Strategy(s) for s in strategies]
    if Strategy.WEBHOOK in known and not any(s.dump for s in known):
        raise ValueError("a webhook edge needs a dump edge to see what it dropped")
    return known


def probe(spark: SparkSession, now: str, last: str | None) -> bool:
    """Whether a fetch is due: the probe's token has changed."""
    return now != last


@dataclass
class Open:
    id: str
    strategy: Strategy
    expected: int | None = None


class Receipts:
    """Chunked receipts under one folder; any path that Spark writes will do."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def begin(self, strategy: str = "dump", chunks: int | None = None) -> str:
        """A new receipt's id; ``chunks`` is their number, where it is known beforehand."""
        name = uuid.uuid4().hex
        fs, p = self._fs(f"{self.root}/{name}/receipt.json")
        out = fs.create(p, True)
        out.write(bytearray(json.dumps({"strategy": Strategy(strategy).value, "chunks": chunks}).encode()))
        out.close()
        return name

    def _open(self, name: str) -> Open:
        fs, p = self._fs(f"{self.root}/{name}/receipt.json")
        if not fs.exists(p):
            raise ValueError(f"no such receipt: {name}")
        got = json.loads(self.spark.read.text(f"{self.root}/{name}/receipt.json", wholetext=True).first()[0])
        return Open(name, Strategy(got["strategy"]), got["chunks"])

    def rows(self, name: str, chunk: int, df: DataFrame) -> None:
        """Stage one chunk; the same number again replaces it."""
        self._open(name)
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/chunks/chunk={chunk}")

    def staged(self, name: str) -> list[int]:
        """Numbers of the chunks that are there: where to go on."""
        fs, p = self._fs(f"{self.root}/{name}/chunks")
        if not fs.exists(p):
            return []
        return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(p) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))

    def finish(self, name: str, target: DataFrame, key: list[str], policy: str = "source", edited: DataFrame | None = None) -> ingest.Receipt:
        """Apply all chunks as one receipt; of a key that several chunks show, the last shows
        it. A receipt that lacks chunks is refused: a dump would delete what they hold."""
        receipt, have = self._open(name), self.staged(name)
        want = list(range(receipt.expected)) if receipt.expected is not None else list(range(len(have)))
        if have != want:
            raise ValueError(f"chunks {have} of {want} are staged")
        if not have:
            return ingest.receive(target, target.limit(0), key, receipt.strategy.dump, policy, edited)
        rows = self.spark.read.option("basePath", f"{self.root}/{name}/chunks").option("mergeSchema", True).parquet(*[f"{self.root}/{name}/chunks/chunk={c}" for c in have])
        cols = [c for c in rows.columns if c != "chunk"]
        last = rows.groupBy(*key).agg(F.max(F.struct("chunk", *[c for c in cols if c not in key])).alias("_r"))
        one = last.select(*key, *[F.col(f"_r.{c}").alias(c) for c in cols if c not in key])
        return ingest.receive(target, one, key, receipt.strategy.dump, policy, edited)

    def abandon(self, name: str) -> None:
        """Forget a receipt and what was staged; call it, too, when a finished one is written."""
        fs, p = self._fs(f"{self.root}/{name}")
        fs.delete(p, True)


def open_conflicts(kept: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The list of conflicts after a receipt: a newer one of a key replaces the older."""
    return kept.join(new.select(*key), key, "left_anti").select(*kept.columns).unionByName(new.select(*kept.columns))


def resolve(target: DataFrame, conflicts: DataFrame, decisions: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(target, conflicts left). ``decisions`` are keys with ``take``: ``source`` writes what the
    source had (deleting the row where it was a delete), ``local`` lets the row be. Either
    closes the conflict; keys without a conflict are ignored."""
    bad = decisions.where(~F.col("take").isin("source", "local") | F.col("take").isNull())
    if not bad.isEmpty():
        raise ValueError("a conflict is resolved by source or local")
    closed = conflicts.join(decisions.select(*key, "take"), key)
    taken = closed.where("take = 'source'")
    values = [f.name for f in conflicts.schema["new"].dataType]
    gone = taken.where("op = 'delete'").select(*key)
    news = taken.where("op <> 'delete'").select(*key, F.col("new").alias("_new"))
    out = target.join(gone, key, "left_anti").join(news, key, "left")
    out = out.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in target.columns])
    return out, conflicts.join(decisions.select(*key), key, "left_anti").select(*conflicts.columns)
