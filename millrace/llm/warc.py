"""WARC archives: packing records into files, reading files back, and auditing replicas of them.

An archive is a row (file, data): the bytes of one WARC file, plain or with one gzip member a
record. Archives come from ``spark.read.format("binaryFile")`` or from ``pack``. One file is
read by one task, as a gzip stream has to be; files are the unit that archives are cut into
for that reason.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import fixity
from .cluster import cut

RECORDS = "file string, number int, start long, end long, headers map<string,string>, body binary, record binary, state string"
_VERSION = b"WARC/"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(file, data) of all files under a path; any store that Spark reads."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("content").alias("data"))


def pack(records: DataFrame, file_bits: int = fixity.FILE, compress: bool = False) -> DataFrame:
    """(file, data) of (id, record) rows: 2^file_bits ids to a file, in order of id. Records
    without an id go to files of their own, by hash. Files are put together in SQL; gzip
    members are made in tasks."""
    rows = records.select("id", "record")
    if compress:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for x in batch.column("record").to_pylist():
                    z = zlib.compressobj(6, zlib.DEFLATED, 31)
                    out.append(None if x is None else z.compress(x) + z.flush())
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], ["id", "record"])

        rows = rows.mapInArrow(run, "id long, record binary")
    free = F.concat(F.lit("free-"), F.hex(F.pmod(F.xxhash64("record"), F.lit(64))))
    rows = rows.withColumn("file", F.when(F.col("id").isNull(), free).otherwise(F.concat(F.lit("part-"), F.shiftright("id", file_bits).cast("string"))))
    bytes_ = F.transform(F.array_sort(F.collect_list(F.struct("id", F.hex("record").alias("x")))), lambda r: F.coalesce(r["x"], F.lit("")))
    return rows.groupBy("file").agg(F.unhex(F.array_join(bytes_, "")).alias("data"))


def _members(data: bytes) -> Iterator[tuple[int, int, bytes, bool]]:
    """(start, end, bytes, whole) of the records' stretches in a file: its gzip members, or all
    of a plain one."""
    if data[:2] != b"\x1f\x8b":
        yield 0, len(data), data, True
        return
    at = 0
    while at < len(data):
        z = zlib.decompressobj(31)
        try:
            out = z.decompress(data[at:])
        except zlib.error:
            yield at, len(data), b"", False
            return
        end = len(data) - len(z.unused_data)
        yield at, end, out, z.eof
        at = end


def _parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes, str]]:
    """(start, end, headers, body, state) of the records in plain bytes. ``state`` is ok,
    truncated (the bytes end before the record does), marked (whole, and its header says the
    body was cut when it was taken) or malformed, which ends the file."""
    at = 0
    while at < len(data):
        if not data.startswith(_VERSION, at):
            yield at, len(data), {}, data[at:], "malformed" if not _VERSION.startswith(data[at : at + 5]) else "truncated"
            return
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0:
            yield at, len(data), {}, b"", "truncated"
            return
        headers = {}
        for line in data[at:stop].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        try:
            size = int(headers["content-length"])
        except (KeyError, ValueError):
            yield at, len(data), headers, data[stop + 4 :], "malformed"
            return
        end = stop + 4 + size + 4
        state = "truncated" if end > len(data) else "malformed" if data[end - 4 : end] != b"\r\n\r\n" else "marked" if "warc-truncated" in headers else "ok"
        yield at, min(end, len(data)), headers, data[stop + 4 : min(stop + 4 + size, len(data))], state
        if state == "malformed":
            return
        at = end


def parse(archives: DataFrame) -> DataFrame:
    """The records of archives (``RECORDS``), in files of any kind. Offsets are those of the
    file as it lies there, so of the gzip member for compressed ones. Null and empty files
    have no records; a damaged member is one record without content, state damaged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "number", "start", "end", "headers", "body", "record", "state"]
        types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.binary(), pa.string()]
        for batch in batches:
            for r in range(batch.num_rows):
                file, data = batch.column("file")[r].as_py(), batch.column("data")[r].as_py()
                rows: list[tuple] = []
                for a, b, plain, whole in _members(data or b""):
                    gzip = plain is not data
                    if not whole and not plain:
                        rows.append((file, len(rows), a, b, [], b"", b"", "damaged"))
                    for start, end, headers, body, state in _parse(plain):
                        place = (a, b) if gzip else (start, end)
                        rows.append((file, len(rows), *place, list(headers.items()), body, plain[start:end], state if whole else "truncated"))
                for at in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 64], strict=True), types, strict=True)], names)

    return archives.select("file", "data").mapInArrow(run, RECORDS)


def identified(parsed: DataFrame, pattern: str = r"<urn:page:(-?\d+)>") -> DataFrame:
    """(id, record, file, number, state): ids from the records' WARC-Record-ID; a record whose
    id does not fit has none."""
    found = F.regexp_extract(F.coalesce(F.element_at("headers", "warc-record-id"), F.lit("")), pattern, 1)
    return parsed.select(found.try_cast("long").alias("id"), "record", "file", "number", "state")


def audit_archives(primary: DataFrame, replicas: dict[str, DataFrame]) -> DataFrame:
    """``fixity.audit`` of each replica's archives against the primary's, with ``replica``; and
    ``reordered`` rows for files that hold the same records in another order: one for each
    record that is not at its place. The order of a file is compared as one hash, and only
    files whose hashes differ are looked into."""
    one = cut(identified(parse(primary)), "primary")
    out = None
    for name, archives in sorted(replicas.items()):
        two = cut(identified(parse(archives)), "replica")
        found = fixity.audit(one.select("id", "record"), two.select("id", "record")).withColumn("replica", F.lit(name))
        rows = found.unionByName(_reordered(one, two, name), allowMissingColumns=True)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no replica to audit")
    return out


def _reordered(one: DataFrame, two: DataFrame, name: str) -> DataFrame:
    def ranked(df: DataFrame, other: DataFrame) -> DataFrame:
        """Records of both replicas, ranked among themselves in each file."""
        shared = df.where("id is not null").join(other.select("file", "id").distinct(), ["file", "id"], "left_semi")
        w = Window.partitionBy("file").orderBy("number")
        return shared.select("file", "id", F.sha2("record", 256).alias("digest"), F.row_number().over(w).alias("rank"))

    a, b = ranked(one, two), ranked(two, one)
    order = lambda d: d.groupBy("file").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda r: r["id"].cast("string")), ",").cast("binary"), 256).alias("order"))
    files = order(a).join(order(b).withColumnRenamed("order", "other"), "file").where(F.col("order") != F.col("other")).select("file")
    moved = a.join(files, "file", "left_semi").join(b.select("file", "id", F.col("digest").alias("found"), F.col("rank").alias("now")), ["file", "id"]).where(F.col("rank") != F.col("now"))
    return moved.select(F.col("id").alias("page_id"), F.shiftright("id", fixity.FILE).alias("file"), F.lit("reordered").alias("state"), F.col("digest").alias("expected"), "found", F.lit(name).alias("replica"))


def sizes(parsed: DataFrame) -> DataFrame:
    """(file, records, bytes, states): an inventory of archives."""
    return parsed.groupBy("file").agg(F.count("*").alias("records"), F.sum(F.octet_length("record")).alias("bytes"), F.array_sort(F.collect_set("state")).alias("states"))
