"""Removal of words covered by windows that start in a document with a smaller id.

Every window of ``width`` words of every text is hashed (Rabin-Karp). The windows travel
as compressed blobs, one for each chunk of the input and hash bucket, of about ten bytes a
window: 64 hash bits, the place as differences; the bucket itself is taken from a second,
independent hash, whose bits add to the 64. A bucket's task finds the smallest document of
each hash and answers with the places of all later windows, grouped by document bucket,
where they meet the texts, merge into maximal intervals and are cut out.

Windows repeated inside a chunk are settled there: only those of the smallest document go
on, so a passage that a third of all rows shares reaches its bucket once a chunk. Bucket
counts grow with the input, so no task grows with it. Two different windows are taken for
equal with a probability of about windows^2 / 2^65 / buckets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import parts_for, table
from .words import Words, chunks, delta, int64s, mix, pack, release, undelta, unpack

WIDTH = 13
CHUNK_WINDOWS = 1 << 20
#: Shuffle partitions at most; beyond it each serves several buckets, one after another.
PARTITIONS = 1 << 14


def _group(ids: np.ndarray, tags: np.ndarray, groups: int) -> np.ndarray:
    """The document bucket of an id and a text's checksum."""
    return (mix(mix(ids.view(np.uint64)) ^ tags.astype(np.uint64)) >> np.uint64(1)).astype(np.int64) % groups


def _split(keys: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The arrays by key, in their order within a key."""
    order = np.argsort(keys.astype(np.uint16) if len(keys) and keys.max() < 65536 else keys, kind="stable")
    keys = keys[order]
    edges = np.flatnonzero(np.diff(keys, prepend=-1, append=-1)) if len(keys) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(keys[a]), [x[order[a:b]] for x in arrays]


def _places(ids: np.ndarray, tags: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    return [delta(ids), delta(tags), delta(at)]


def _rows(kind: int, items: Iterator[tuple[int, bytes]]) -> pa.RecordBatch:
    keys, blobs = [], []
    for key, blob in items:
        keys.append(key)
        blobs.append(blob)
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(keys), pa.int32()), pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], ["kind", "key", "blob"])


def _settled(h: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Where an equal hash has a smaller id."""
    order = np.argsort(h)
    sorted_h = h[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_h[1:] != sorted_h[:-1]])) if len(h) else np.zeros(0, np.int64)
    if not len(h):
        return np.zeros(0, bool)
    least = np.minimum.reduceat(ids[order], first)
    out = np.empty(len(h), bool)
    out[order] = ids[order] > np.repeat(least, np.diff(np.append(first, len(h))))
    return out


def _send(width: int, buckets: int, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            h, b, ids, tags, at = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            done = _settled(h, ids)
            yield _rows(1, ((g, pack(*_places(*x))) for g, x in _split(_group(ids[done], tags[done], groups), ids[done], tags[done], at[done])))
            go = ~done
            yield _rows(0, ((k, pack(*_places(*x[1:]), x[0])) for k, x in _split(b[go], h[go], ids[go], tags[go], at[go])))

        for batch in chunks(batches):
            ids, known = int64s(batch, "id")
            tags, _ = int64s(batch, "tag")
            words = Words(batch.column("text"))
            docs = words.docs()
            one, two = words.hashes(11), words.hashes(23)
            at, h = words.windows(one, width, 31)
            _, other = words.windows(two, width, 47)
            keep = known[docs[at]]
            at, h, other = at[keep], h[keep], other[keep]
            d = docs[at]
            held.append((h, ((other >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64), ids[d], tags[d], (at - words.first[d]).astype(np.int32)))
            if sum(len(x[0]) for x in held) >= CHUNK_WINDOWS:
                yield from flush()
        if held:
            yield from flush()

    return run


def _answer(groups: int):
    """Rows of kind 1 pass; the blobs of a bucket, which come together, are settled together."""

    def settle(blobs: list[bytes]) -> pa.RecordBatch:
        parts = [unpack(x) for x in blobs]
        ids, tags, at = (np.concatenate([undelta(p[i]) for p in parts]) for i in range(3))
        h = np.concatenate([p[3] for p in parts])
        del parts
        late = _settled(h, ids)
        ids, tags, at = ids[late], tags[late], at[late]
        order = np.lexsort((at, ids))
        out = list(_split(_group(ids[order], tags[order], groups), ids[order], tags[order], at[order]))
        return pa.RecordBatch.from_arrays([pa.array([g for g, _ in out], pa.int64()), pa.array([pack(*_places(*x)) for _, x in out], pa.binary())], ["g", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        bucket = None
        for batch in batches:
            kind, key = batch.column("kind").to_numpy(), batch.column("key").to_numpy()
            through = np.flatnonzero(kind == 1)
            if len(through):
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(through)), batch.column("blob").take(pa.array(through))], ["g", "blob"])
            for i in np.flatnonzero(kind == 0).tolist():
                if held and key[i] != bucket:
                    blobs, held = held, []
                    yield settle(blobs)
                bucket = key[i]
                held.append(batch.column("blob")[i].as_py())
        if held:
            yield settle(held)
        release()

    return run


def _texts(groups: int):
    """Blobs of rows (id, tag, text) by document bucket; packed together, texts take about
    half of what single rows would."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=8 << 20):
            ids, _ = int64s(batch, "id")
            tags, _ = int64s(batch, "tag")
            keys, blobs = [], []
            texts = pc.fill_null(batch.column("text").cast(pa.large_binary()), b"")
            for g, (rows,) in _split(_group(ids, tags, groups), np.arange(len(ids))):
                mine = texts.take(pa.array(rows))
                sizes = np.asarray(pc.binary_length(mine), np.int64)
                raw = np.frombuffer(b"".join(mine.to_pylist()), np.uint8)
                keys.append(g)
                blobs.append(pack(ids[rows], tags[rows], sizes, raw))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], ["g", "blob"])

    return run


def _cut(width: int, whole: bool):
    """The texts of a document bucket with the answers about them."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        blobs = [unpack(x.as_py()) for x in answers.column("blob")]
        ids, tags, at = (np.concatenate([np.zeros(0, np.int64), *[undelta(p[i]).astype(np.int64) for p in blobs]]) for i in range(3))
        del blobs
        order = np.lexsort((at, tags, ids))
        ids, tags, at = ids[order], tags[order], at[order]
        rows = []
        for blob in docs.column("blob"):
            own, marks, sizes, raw = unpack(blob.as_py())
            ends = np.concatenate([[0], np.cumsum(sizes)])
            words = Words(pa.LargeStringArray.from_buffers(len(own), pa.py_buffer(ends), pa.py_buffer(raw)))
            data = raw.tobytes()
            for r in range(len(own)):
                a, b = int(words.first[r]), int(words.first[r + 1])
                lo, hi = np.searchsorted(ids, own[r]), np.searchsorted(ids, own[r], "right")
                places = at[lo:hi][tags[lo:hi] == marks[r]]
                edge = np.zeros(b - a + 1, np.int32)
                np.add.at(edge, places, 1)
                np.add.at(edge, np.minimum(places + width, b - a), -1)
                gone = np.cumsum(edge)[:-1] > 0
                keep = np.flatnonzero(~gone) + a
                kept = b" ".join([data[s:e] for s, e in zip(words.starts[keep].tolist(), words.ends[keep].tolist(), strict=True)])
                value = kept.decode() if whole else None
                rows.append((int(own[r]), int(marks[r]), b - a, int(gone.sum()), hashlib.sha256(kept).hexdigest(), value))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("id", "tag", "n_words", "n_removed", "kept_sha256", "kept"), cols, types, strict=True)})

    return run


def _whole(whole: bool):
    """Rows without an id: all of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            words = Words(batch.column("text"))
            data = words.data.tobytes()
            kept = [b" ".join([data[s:e] for s, e in zip(words.starts[a:b].tolist(), words.ends[a:b].tolist(), strict=True)]) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
            n = len(kept)
            cols = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(np.diff(words.first), pa.int64()), pa.array(np.zeros(n, np.int64)), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array([k.decode() if whole else None for k in kept], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "tag", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def remove_repeated_windows(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", whole: bool = True) -> DataFrame:
    """One row for each row of ``docs``: id, n_words, n_removed, kept_sha256 and, if
    ``whole``, the kept words joined by one space (``kept``).

    Null texts have no words. Rows with a null id are kept whole and never count as an
    earlier document; rows that share an id do not remove each other's words. Windows are
    judged on the input. Columns other than the id and the text are not read.
    """
    if width < 1:
        raise ValueError("width must be positive")
    parts = parts_for(docs, 4 << 20)
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.crc32(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")).alias("tag"), F.col(f"`{text_col}`").alias("text"))
    known = base.where(F.col("id").isNotNull())
    sent = known.mapInArrow(_send(width, parts, parts), "kind int, key long, blob binary")
    few = min(parts, PARTITIONS)
    sent = sent.repartitionById(few, F.pmod("key", F.lit(few)).cast("int")).sortWithinPartitions("kind", "key")
    answers = sent.mapInArrow(_answer(parts), "g long, blob binary")
    texts = known.mapInArrow(_texts(parts), "g long, blob binary")
    schema = "id long, tag long, n_words long, n_removed long, kept_sha256 string, kept string"
    out = texts.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(_cut(width, whole), schema)
    out = out.unionByName(base.where(F.col("id").isNull()).mapInArrow(_whole(whole), schema))
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_sha256", *(["kept"] if whole else []))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated_windows(docs, whole=False)


ORACLE = """
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS word,
                  generate_subscripts(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+'), 1) AS pos FROM documents),
g AS (SELECT doc_id, pos, count(*) OVER d AS n, string_agg(word, ' ') OVER d AS key
      FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
m AS (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY key) AS least FROM g WHERE n = 13),
c AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 13)) AS pos FROM m WHERE least < doc_id),
k AS (SELECT w.doc_id, count(*) AS n_words, count(c.pos) AS n_removed,
             coalesce(string_agg(word, ' ' ORDER BY w.pos) FILTER (WHERE c.pos IS NULL), '') AS kept
      FROM w LEFT JOIN c ON w.doc_id = c.doc_id AND w.pos = c.pos GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""
