"""Where intermediate tables go, how large inputs are, and how Arrow batches are cut.

Nothing here depends on the number of rows in a test: sizes come from the plan's own
statistics, and every broadcast made by the operators has the bound stated at its place.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL = "/tmp/millrace-checkpoints"
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees. A local one stands in only where driver and
    executors are one process; any other master without ``spark.checkpoint.dir`` is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        where = _LOCAL
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back: the lineage ends here, and
    a lost executor costs a re-read, not a recomputation. ``files`` deals small results of
    many tasks out again first, so that they do not become as many small files."""
    if files:
        df = df.repartition(files)
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _MADE.remove(path)


def drop(df: DataFrame) -> None:
    """Delete a table that ``cut`` made and that nothing reads any more."""
    if getattr(df, "_cut_path", None) in _MADE:
        _delete(df.sparkSession, df._cut_path)


def drop_all(spark: SparkSession) -> None:
    """Delete all tables that ``cut`` has made; call it when the results that were built on
    them have been written or collected, because results are computed only then."""
    for path in list(_MADE):
        _delete(spark, path)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files under ``df`` by the optimizer's statistics; where these are unknown
    or a product over a join (a petabyte or more), the strings' bytes are summed instead."""
    guess = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if guess < 1 << 50:
        return guess
    texts = [F.coalesce(F.sum(F.octet_length(f"`{c}`")), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary")]
    return int(sum(df.agg(*texts).first())) if texts else 0


def parts_for(df: DataFrame, bytes_each: int = 8 << 20, least: int = 8) -> int:
    """Number of hash buckets: in proportion to the input, so that one bucket's share of the
    work stays the same at every size."""
    return max(least, -(-input_bytes(df) // bytes_each))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
