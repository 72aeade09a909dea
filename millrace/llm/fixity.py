"""Merkle fixity audit of WARC replicas.

Every row is one WARC record, hashed whole (SHA-256). Records lie in archive files in the
order of their ids, ``FILE`` ids to a file, so each has an offset there. Node n of level L
covers the ids n * 64^L to (n + 1) * 64^L - 1, which is one range of offsets, and hashes its
children's places, lengths and digests in order. Places come from ids, not from counts: a
lost record changes its own branch and moves no other. The roots of both replicas are
compared, and only children of nodes that differ are looked at, down to the records.

DataFrame functions only. Record bodies are hashed where they are read; digests are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .cluster import cut, parts_for, table

#: Bits of an id that one level takes, and bits of the ids in one archive file.
BITS = 6
FILE = 10
SCHEMA = "page_id long, file long, start long, end long, state string, expected string, found string"


def warc_record(page_id: F.Column, url: F.Column, html: F.Column) -> F.Column:
    """The bytes of one record. Different rows give different bytes: the length comes before
    the free text, a null url has no line and a null body is marked."""
    body = F.coalesce(html.cast("binary"), F.lit(b""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nContent-Length: "), F.octet_length(body).cast("string"),
        F.when(html.isNull(), F.lit("\r\nWARC-Truncated: unspecified")).otherwise(F.lit("")),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), url), F.lit("")), F.lit("\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), body, F.lit(b"\r\n\r\n"))


def records(pages: DataFrame) -> DataFrame:
    """(id, record) of a table of pages."""
    return pages.select(F.col("page_id").cast("long").alias("id"), warc_record(F.col("page_id").cast("long"), F.col("url"), F.col("html")).alias("record"))


def _leaves(side: int, rows: DataFrame) -> DataFrame:
    """(side, free, key, digest, size, n): ``free`` tells rows without an id, whose place
    comes from their digest."""
    rows = rows.select("id", F.sha2("record", 256).alias("digest"), F.octet_length("record").cast("long").alias("size"))
    free = F.col("id").isNull()
    key = F.when(free, F.shiftrightunsigned(F.xxhash64("digest"), 40)).otherwise(F.col("id"))
    rows = rows.select(F.lit(side).alias("side"), free.alias("free"), key.alias("key"), "digest", "size")
    return rows.groupBy("side", "free", "key", "digest", "size").agg(F.count("*").alias("n"))


def _node(children: DataFrame, *keys: str) -> DataFrame:
    """One row for each group of (key, size, digest): their bytes and the hash over all."""
    told = F.concat_ws(":", F.col("key").cast("string"), F.col("size").cast("string"), "digest")
    if "key" not in keys:
        keys = (*keys, "up")
    got = children.groupBy(*keys).agg(F.array_sort(F.collect_list(told)).alias("c"), F.sum("size").alias("size"))
    return got.select(*keys, "size", F.sha2(F.array_join("c", "\n").cast("binary"), 256).alias("digest")).withColumnRenamed("up", "key")


def _differing(nodes: DataFrame, parents: DataFrame | None) -> DataFrame:
    """(free, key) of the nodes, below ``parents`` if given, that the sides do not share."""
    if parents is not None:
        nodes = nodes.withColumn("up", F.shiftright("key", BITS)).join(parents.withColumnRenamed("key", "up"), ["free", "up"], "left_semi")
    one = [F.max(F.when(F.col("side") == s, F.col("digest"))).alias(f"d{s}") for s in (0, 1)]
    return nodes.groupBy("free", "key").agg(*one).where(~F.col("d0").eqNullSafe(F.col("d1"))).select("free", "key")


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """One row for each place at which the replicas, both (id, record), differ: ``page_id``,
    the archive ``file`` and offset range (``start``, ``end``) of its records in the primary,
    ``state`` (changed, missing in the replica, or extra there) and the digests ``expected``
    and ``found``, sorted, a digest's count before it where it is not 1.

    Records that share an id share a place and are held as a multiset. Records without an id
    are placed by their digest, so a changed one is one missing and one extra. Equal replicas
    give no rows; an extra record has no offsets.
    """
    spark = primary.sparkSession
    files = parts_for(primary, 64 << 20, 2)
    records = cut(_leaves(0, primary).unionByName(_leaves(1, replica)), "records", files)
    place = records.withColumn("digest", F.concat_ws("x", F.when(F.col("n") > 1, F.col("n").cast("string")), "digest")).withColumn("size", F.col("size") * F.col("n"))
    levels = [cut(_node(place, "side", "free", "key"), "places", files)]
    reach = levels[0].agg(F.max(F.greatest("key", -F.col("key") - 1))).first()[0]
    for up in range(BITS, (reach or 0).bit_length() + BITS, BITS):
        levels.append(cut(_node(levels[-1].withColumn("up", F.shiftright("key", BITS)), "side", "free"), "nodes", max(1, files >> up)))
    # what is left has at most the keys -1 and 0, with and without an id: the root's children
    roots = {r["side"]: r["digest"] for r in _node(levels[-1].withColumn("up", F.lit(0)).withColumn("key", F.concat_ws("/", F.col("free").cast("string"), F.col("key").cast("string"))), "side").collect()}
    if roots.get(0) == roots.get(1):
        return spark.createDataFrame([], SCHEMA)
    bad = None
    for nodes in reversed(levels):
        bad = cut(_differing(nodes, bad), "differing", files)
    file = F.shiftright("key", FILE)
    files = bad.select("free", file.alias("file")).distinct()
    there = place.where("side = 0").withColumn("file", file).join(files, ["free", "file"], "left_semi")
    # offsets need the records before a place in its file, and no other file
    there = there.groupBy("free", "file", "key").agg(F.sum("size").alias("size"))
    end = F.sum("size").over(Window.partitionBy("free", "file").orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    there = there.withColumn("end", end).select("free", "key", (F.col("end") - F.col("size")).alias("start"), "end")
    told = [F.array_join(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("digest")))), ",").alias(c) for s, c in ((0, "expected"), (1, "found"))]
    out = place.join(bad, ["free", "key"], "left_semi").groupBy("free", "key").agg(*told).join(there, ["free", "key"], "left")
    state = F.when(F.col("expected") == "", "extra").when(F.col("found") == "", "missing").otherwise("changed")
    return out.select(F.when(~F.col("free"), F.col("key")).alias("page_id"), file.alias("file"), "start", "end", state.alias("state"), *(F.when(F.col(c) != "", F.col(c)).alias(c) for c in ("expected", "found")))


def damaged(rows: DataFrame) -> DataFrame:
    """A replica of (id, record) rows with known damage: by id, one of 97 records has one byte
    changed in its middle, one of 101 is cut to half and one of 103 is lost."""
    r, half = F.col("record"), (F.octet_length("record") / 2).cast("int")
    other = F.when(F.expr("substring(record, cast(octet_length(record) / 2 as int) + 1, 1)") == F.lit(b" "), F.lit(b"!")).otherwise(F.lit(b" "))
    hit = lambda n: F.coalesce(F.pmod("id", F.lit(n)) == 7, F.lit(False))
    changed = F.concat(r.substr(F.lit(1), half), other, r.substr(half + 2, F.octet_length("record")))
    return rows.where(~hit(103)).withColumn("record", F.when(hit(97), changed).when(hit(101), r.substr(F.lit(1), half)).otherwise(r))


def op2_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a replica of all pages differs from them; the tables hold one copy, so the
    replica is made from it by ``damaged``."""
    rows = records(table(spark, sf_dir, "pages"))
    return audit(rows, damaged(rows))


#: The same by plain comparison of the records, as hex text; rows without an id are never damaged.
ORACLE = """
WITH p AS (SELECT CAST(page_id AS BIGINT) AS id, hex('WARC/1.1' || e || 'WARC-Type: resource' || e || 'WARC-Record-ID: <urn:page:' || page_id || '>' || e || 'Content-Length: ' || strlen(coalesce(html, ''))
             || CASE WHEN html IS NULL THEN e || 'WARC-Truncated: unspecified' ELSE '' END || coalesce(e || 'WARC-Target-URI: ' || url, '') || e || 'Content-Type: text/html; charset=utf-8' || e || e
             || coalesce(html, '') || e || e) AS h
           FROM pages, (SELECT chr(13) || chr(10) AS e) WHERE page_id IS NOT NULL),
r AS (SELECT id, CASE WHEN id % 97 = 7 THEN substr(h, 1, 2 * k) || CASE WHEN substr(h, 2 * k + 1, 2) = '20' THEN '21' ELSE '20' END || substr(h, 2 * k + 3) WHEN id % 101 = 7 THEN substr(h, 1, 2 * k) ELSE h END AS h
      FROM (SELECT *, len(h) // 4 AS k FROM p) WHERE id % 103 <> 7),
a AS (SELECT id, sum(n * size) AS size, string_agg(t, ',' ORDER BY t) AS told FROM (SELECT id, len(h) // 2 AS size, count(*) AS n, CASE WHEN count(*) > 1 THEN count(*) || 'x' ELSE '' END || sha256(unhex(h)) AS t FROM p GROUP BY id, h) GROUP BY id),
b AS (SELECT id, string_agg(t, ',' ORDER BY t) AS told FROM (SELECT id, CASE WHEN count(*) > 1 THEN count(*) || 'x' ELSE '' END || sha256(unhex(h)) AS t FROM r GROUP BY id, h) GROUP BY id),
o AS (SELECT *, sum(size) OVER (PARTITION BY id // 1024 ORDER BY id) AS till FROM a)
SELECT o.id AS page_id, o.id // 1024 AS file, CAST(till - size AS BIGINT) AS start, CAST(till AS BIGINT) AS "end", CASE WHEN b.told IS NULL THEN 'missing' ELSE 'changed' END AS state, o.told AS expected, b.told AS found
FROM o LEFT JOIN b ON o.id = b.id WHERE o.told IS DISTINCT FROM b.told
"""
