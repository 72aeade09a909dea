"""A task queue as table snapshots: enqueue, claim with leases, complete, retry, reap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "id long, kind string, payload string, state string, attempts int, worker string, lease long, priority int"


def enqueue(queue: DataFrame, tasks: DataFrame) -> DataFrame:
    """New (id, kind, payload, priority) rows as ready tasks; known ids stay as they are."""
    new = tasks.join(queue.select("id"), "id", "left_anti")
    return queue.unionByName(new.select("id", "kind", "payload", F.lit("ready").alias("state"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("worker"), F.lit(None).cast("long").alias("lease"), F.coalesce("priority", F.lit(0)).alias("priority")))


def claim(queue: DataFrame, worker: str, n: int, now: int, lease: int) -> tuple[DataFrame, DataFrame]:
    """(queue, claimed): the n ready tasks of highest priority, then lowest id. Writers must
    take turns: snapshots have no locks."""
    taken = queue.where("state = 'ready'").orderBy(F.desc("priority"), "id").limit(n).select("id", F.lit(True).alias("_mine"))
    mine = F.coalesce(F.col("_mine"), F.lit(False))
    after = queue.join(F.broadcast(taken), "id", "left")
    after = after.select(
        "id", "kind", "payload", F.when(mine, "claimed").otherwise(F.col("state")).alias("state"), (F.col("attempts") + mine.cast("int")).alias("attempts"),
        F.when(mine, worker).otherwise(F.col("worker")).alias("worker"), F.when(mine, now + lease).otherwise(F.col("lease")).alias("lease"), "priority", mine.alias("_did"),
    )
    return after.drop("_did"), after.where("_did").drop("_did")


def finish(queue: DataFrame, done: DataFrame, ok: bool = True, retries: int = 3) -> DataFrame:
    """Completed tasks are done; failed ones are ready again until their attempts are used."""
    hit = queue.join(done.select("id", F.lit(True).alias("_hit")), "id", "left")
    state = F.lit("done") if ok else F.when(F.col("attempts") >= retries, "failed").otherwise("ready")
    mine = F.coalesce(F.col("_hit"), F.lit(False)) & (F.col("state") == "claimed")
    return hit.withColumn("state", F.when(mine, state).otherwise(F.col("state"))).withColumn("worker", F.when(~mine, F.col("worker"))).withColumn("lease", F.when(~mine, F.col("lease"))).select(*queue.columns)


def reap(queue: DataFrame, now: int) -> DataFrame:
    """Claims whose lease has run out are ready again."""
    late = (F.col("state") == "claimed") & (F.col("lease") < now)
    return queue.withColumn("state", F.when(late, "ready").otherwise(F.col("state")))
