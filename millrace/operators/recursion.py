"""WITH RECURSIVE ... UNION: semi-naive evaluation that stops on cycles.

Spark's own recursive CTE refuses UNION. Each step joins only the rows that are new, each
once, and takes away what has been seen by an anti join. While at most ``SMALL`` rows have
been seen in all, they are held by the driver and several steps share one job; beyond that,
new rows are written to the shared folder, so neither the driver nor the lineage grows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL = "/tmp/millrace-checkpoints"
_MADE: list[str] = []
#: Steps in one job at most, and the number of rows up to which the driver holds them.
DEEPEST, SMALL = 8, 10_000


def folder(spark: SparkSession, name: str) -> str:
    """A new name in the cluster's shared checkpoint folder. A local folder stands in only
    where driver and executors are one process."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        where = _LOCAL
    path = f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` as a table in the shared folder."""
    spark: SparkSession = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> None:
    """Delete the intermediate tables made so far: for use when the results built on them
    have been written or collected."""
    for path in list(_MADE):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _MADE.remove(path)


def fixpoint(start: DataFrame, step: Callable[[DataFrame], DataFrame], key: list[str] | None = None, max_steps: int = 1000) -> DataFrame:
    """All rows that ``start`` and repeated ``step`` reach, each once.

    ``step`` takes the rows that were new and must return the same columns. ``key`` names
    the columns that make a row new (all, by default): with the depth left out of it, a row
    is kept at the first depth that reaches it, which is what an unobserved depth allows.
    NULLs are equal. More than ``max_steps`` steps raise.
    """
    spark, cols = start.sparkSession, start.columns
    key = key or cols
    rest = [c for c in cols if c not in key]

    def fresh(df: DataFrame) -> DataFrame:
        """Each key once: its first level, and the least of the other columns."""
        out = df.groupBy(*key).agg(F.min("_level").alias("_level"), *([F.min(F.struct(*rest)).alias("_r")] if rest else []))
        return out.select(*[c if c in key else F.col(f"_r.{c}").alias(c) for c in cols], "_level")

    def held(rows: pa.Table) -> DataFrame:
        """Rows of the driver as a local relation."""
        return spark.createDataFrame(rows.select(cols), schema).coalesce(1)

    first = fresh(start.select(*cols, F.lit(0).alias("_level"))).drop("_level")
    schema = first.schema
    known: pa.Table | None = first.limit(SMALL + 1).toArrow()
    if known.num_rows > SMALL:
        known, seen = None, written(first)
        frontier = seen
    else:
        frontier = seen = held(known)
    deep, steps, parts = 1, 0, 1
    while True:
        # a few steps in one job while little is new: every level is expanded, each row of it
        # once, so only rows first reached at the last one are still to be followed
        level, levels = frontier, None
        for i in range(1, deep + 1):
            level = step(level.select(*cols)).select(*cols)
            if i < deep:
                level = level.dropDuplicates(key) if not rest else fresh(level.withColumn("_level", F.lit(i))).select(*cols)
            tagged = level.withColumn("_level", F.lit(i))
            levels = tagged if levels is None else levels.unionAll(tagged)
        old = seen.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)])
        same = F.lit(True)
        for i, c in enumerate(key):
            same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
        new = fresh(levels).join(old, same, "left_anti").select(*[F.col(c).cast(schema[c].dataType).alias(c) for c in cols], "_level")
        steps += deep
        if known is not None:
            got = new.limit(SMALL + 1 - known.num_rows).toArrow()
            if known.num_rows + got.num_rows <= SMALL:
                known = pa.concat_tables([known, got.select(cols)], promote_options="permissive")
                seen = held(known)
                last = got.filter(pc.equal(got["_level"], deep))
                if not last.num_rows:
                    return seen
                if steps > max_steps:
                    raise RuntimeError(f"no fixpoint after {max_steps} steps")
                frontier = held(last)
                deep = min(2 * deep, DEEPEST)
                continue
            known, seen = None, written(seen)
        new, parts = written(new), parts + 1
        n, last = new.agg(F.count("*"), F.count(F.when(F.col("_level") == deep, 1))).first()
        if n:
            seen = seen.unionAll(new.select(*cols))
        if not last:
            return seen
        if steps > max_steps:
            raise RuntimeError(f"no fixpoint after {max_steps} steps")
        frontier = new.where(F.col("_level") == deep).select(*cols)
        if parts >= 16:  # keep the plan small however many steps there are
            seen, parts = written(seen), 1
        deep = min(2 * deep, DEEPEST) if n <= SMALL else 1
