"""Maps between table sets: bounded, resumable runs, and a journal that feeds them.

A run takes the dirty keys of a journal in order, at most so many at a time, recomputes the
mapped rows of those keys alone, and moves its cursor. A run that is broken off changes
nothing; the next one takes the same keys.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

JOURNAL = "seq long, op string"


def record(journal: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """The journal with the keys of some changes behind it, in no stated order among
    themselves. Numbers rise and may leave gaps."""
    top = journal.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("_top"))
    new = changes.select(*key, "op").withColumn("_m", F.monotonically_increasing_id()).crossJoin(F.broadcast(top))
    return journal.unionByName(new.select((F.col("_top") + F.col("_m") + 1).alias("seq"), "op", *key))


@dataclass
class Run:
    target: DataFrame
    cursor: int
    done: bool
    keys: DataFrame


def run(source: DataFrame, target: DataFrame, journal: DataFrame, key: list[str], mapping: Callable[[DataFrame], DataFrame], cursor: int = 0, limit: int | None = None) -> Run:
    """One bounded run: the first ``limit`` dirty keys past the cursor (all, without one). Rows
    of the target with those keys are replaced by ``mapping`` of the source rows with them;
    a key the source no longer has goes. Each key is taken once, at its last number, and
    changes of it that come later are taken by a later run."""
    last = journal.where(F.col("seq") > cursor).groupBy(*key).agg(F.max("seq").alias("seq"))
    if limit is not None:
        # the number of the last key that fits: one row
        edge = last.orderBy("seq").limit(limit).agg(F.max("seq")).first()[0]
    else:
        edge = last.agg(F.max("seq")).first()[0]
    if edge is None:
        return Run(target, cursor, True, last.select(*key))
    keys = last.where(F.col("seq") <= edge).select(*key)
    fresh = mapping(source.join(keys, key, "left_semi").select(*source.columns)).select(*target.columns)
    out = target.join(keys, key, "left_anti").select(*target.columns).unionByName(fresh)
    done = last.where(F.col("seq") > edge).isEmpty()
    # keys whose last change is past the edge may have older numbers before it: they stay dirty by the later one
    return Run(out, edge, done, keys)


def stream_journal(stream: DataFrame, key: list[str], path: str, checkpoint: str):
    """A change feed written as a journal: micro-batch and place in it make the number, so a
    batch that is run again writes the same rows in the same folder."""

    def write(batch: DataFrame, number: int) -> None:
        seq = (F.lit(number).cast("long") * F.lit(1 << 40)) + F.monotonically_increasing_id() % F.lit(1 << 40) + 1
        batch.select(seq.alias("seq"), "op", *key).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
