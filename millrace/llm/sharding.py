"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Every row first belongs to one of P source partitions (by hash). From the P partition
sizes alone the matrix M[p, k], the number of rows that partition p sends to shard k, is
drawn from the exact multivariate hypergeometric law: it is the law that these counts have
under a uniform permutation of all rows. Each partition is then permuted locally and cut
by its row of the matrix, the rows are exchanged, and each shard is permuted again.

Everything that touches rows is DataFrame code. Only the P partition sizes reach the
driver, where the matrix is drawn: P is rows / 65,536 until the matrix has ``CELLS`` cells
(8 MB), which is the bound of what is collected and broadcast; beyond it partitions grow
instead, and their local permutation is a sort, which spills.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cluster import cut, table

ROWS_EACH = 65_536
CELLS = 1 << 20


def _hypergeometric(good: int, bad: int, draws: int, rng: np.random.Generator) -> int:
    """One exact draw. numpy's generator serves populations under 1e9; beyond that the
    distribution is inverted outwards from its mode, which costs a few standard deviations."""
    if good == 0 or draws == 0:
        return 0
    if bad == 0:
        return draws
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws))
    lo, hi = max(0, draws - bad), min(good, draws)
    mode = min(hi, max(lo, (draws + 1) * (good + 1) // (good + bad + 2)))
    lc = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    p = math.exp(lc(good, mode) + lc(bad, draws - mode) - lc(good + bad, draws))
    u, up, down, pu, pd = rng.random() - p, mode, mode, p, p
    while u > 0 and (up < hi or down > lo):
        if up < hi:
            pu *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= pu
            if u <= 0:
                return up
        if down > lo:
            pd *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= pd
            if u <= 0:
                return down
    return mode


def communication_matrix(sizes: list[int], targets: list[int], seed: int) -> list[list[int]]:
    """Rows sum to ``sizes`` and columns to ``targets``; drawn partition by partition from
    what is left of the targets, each row cell by cell."""
    if sum(sizes) != sum(targets):
        raise ValueError("sizes and targets must have the same sum")
    rng, left, out = np.random.default_rng(seed), list(targets), []
    for n in sizes:
        row, rest = [], sum(left)
        for k, room in enumerate(left):
            rest -= room
            got = _hypergeometric(room, rest, n, rng)
            row.append(got)
            left[k] -= got
            n -= got
        out.append(row)
    return out


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``u``, 0 to m - 1 for m rows that are equal in every column. Copies are
    counted by input partition first and numbered inside it, so no task meets all of them."""
    rows = cut(rows.select("*", F.xxhash64(*rows.columns).alias("v"), F.spark_partition_id().alias("q"), F.monotonically_increasing_id().alias("m")), "shard-input")
    every = Window.partitionBy("v")
    counts = rows.groupBy("v", "q").agg(F.count("*").alias("n"))
    before = F.sum("n").over(every.orderBy("q").rowsBetween(Window.unboundedPreceding, -1))
    copies = counts.select("v", "q", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(every).alias("all")).where("all > 1")
    out = rows.join(cut(copies.drop("all"), "shard-copies"), ["v", "q"], "left")
    local = F.row_number().over(Window.partitionBy("v", "q").orderBy("m"))
    u = F.when(F.col("before").isNull(), 0).otherwise(F.col("before") + local - 1)
    return cut(out.withColumn("u", u.cast("long")).drop("v", "q", "m", "before"), "shard-rows")


def shuffle_into_shards(df: DataFrame, shards: int, seed: int = 7, id_col: str = "doc_id", rows_each: int = ROWS_EACH) -> DataFrame:
    """``df`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard).

    Shard sizes are ``n // shards`` or one more. Pass narrow rows: all columns of ``df`` are
    written once and exchanged. Rows equal in every column are numbered, and the number takes
    part in all hashes: copies, null ids and repeated ids are spread like any other rows.
    Equal rows are interchangeable, so the result does not depend on the order or the
    partitions of the input. An empty table gives an empty result. Columns named
    ``shard`` or ``slot`` in the input are replaced. ``id_col`` must exist; its values are not special.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    spark = df.sparkSession
    cols = [c for c in df.columns if c not in ("shard", "slot")]
    base = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)])
    if id_col not in cols:
        raise ValueError(f"no column {id_col}")
    base = _numbered(base)
    every = [F.col(c) for c in base.columns]
    hashed = lambda k: F.xxhash64(F.lit(seed), F.lit(k), *every)
    n = base.count()
    parts = max(1, min(-(-n // rows_each), CELLS // shards))
    base = base.withColumn("p", F.pmod(hashed(1), F.lit(parts)))
    sizes = {r["p"]: r["n"] for r in base.groupBy("p").agg(F.count("*").alias("n")).collect()}
    order = sorted(sizes)
    targets = [n // shards + (k < n % shards) for k in range(shards)]
    matrix = communication_matrix([sizes[p] for p in order], targets, seed)
    cuts = [(p, np.cumsum(row).tolist()) for p, row in zip(order, matrix, strict=True)]
    plan = spark.createDataFrame(cuts, T.StructType([T.StructField("p", T.LongType()), T.StructField("cuts", T.ArrayType(T.LongType()))]))
    local = Window.partitionBy("p").orderBy(hashed(2), *every)
    dealt = (
        base.withColumn("r", F.row_number().over(local))
        .join(plan, "p")
        .withColumn("shard", F.size(F.filter("cuts", lambda c: c < F.col("r"))))
        .drop("p", "r", "cuts")
    )
    # the second permutation: by hash, in sub-ranges of the hash so that no task sorts a whole shard
    subs = max(1, -(-n // (shards * rows_each)))
    dealt = cut(dealt.withColumn("h", F.shiftrightunsigned(hashed(3), 33)).withColumn("b", F.shiftright(F.col("h") * subs, 31)), "shard-dealt")
    counts = dealt.groupBy("shard", "b").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))).select("shard", "b", F.coalesce("before", F.lit(0)).alias("before"))
    final = Window.partitionBy("shard", "b").orderBy("h", *every)
    out = dealt.withColumn("r", F.row_number().over(final)).join(before, ["shard", "b"])
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)], F.col("shard").cast("int").alias("shard"), (F.col("before") + F.col("r") - 1).cast("long").alias("slot"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 39 under the ``rows`` law. Size: UTF-8 bytes plus 16;
    a null text counts no bytes and has the checksum 0 of the empty string."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = shuffle_into_shards(docs, 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
