"""Exact self-join of documents by the Jaccard similarity of their word shingles.

Prefix filtering with a rare-first order finds candidate lists: of the shingles that two sets
of similarity t or more share, the first l are among the first n - ceil(t n) + l of each set.
With l = ``_least(n)`` a set whose prefix has fewer shingles in common with all other sets
together than any partner would need has no partner, and goes before any set is sent. Set
relations then save the work that pairs would cost:

* Equal sets are one class and are joined once.
* Each list goes to the group of its smallest document, so lists that overlap meet and a
  set is sent about once, not once a shingle; no list is ever expanded into pairs.
* Inside a group, index lists are ordered by set size (the position of a set), and blocks
  of positions whose sizes cannot qualify are skipped as a whole.
* Overlaps of a set with all others are derived from those of the most similar set before
  it, by walking only the index lists of the shingles in which the two differ.
* Links inside one component are not repeated: a group answers with a star for each
  component it found.

A group larger than a block is cut into blocks and joined block by block, so no task grows
with a group. The rare-first order needs counts of frequent shingles only: they come from
all documents, and the most frequent 2^18 are broadcast (4 MB at most). The order decides
speed, never the result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import cut, parts_for, table
from .components import components
from .words import Words, chunks, int64s, mix, release, rolling

SHINGLE = 5
HOT = 1 << 18
HOT_LEAST = 16
BLOCK_BYTES = 24 << 20
BLOOM_BITS = 1 << 26
FLUSH = 1 << 21
ENTRIES = 1 << 19


def shingle_sets(batch: pa.RecordBatch, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(batch.column("text"), lower=True)
    h = words.hashes(5)
    at, win = words.windows(h, k, 17)
    edge = np.searchsorted(at, words.first)
    out = []
    for d in range(batch.num_rows):
        a, b = words.first[d], words.first[d + 1]
        if b - a >= k:
            out.append(np.unique(win[edge[d] : edge[d + 1]]))
        else:
            out.append(rolling(h, np.array([a]), np.array([b]), 17) if b > a else np.zeros(0, np.uint64))
    return out


def _prints(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit fingerprints of a set."""
    return int(s.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D))).view(np.int64)) if len(s) else 0


def _survey(k: int):
    """kind 0: (id, set size, fingerprints) of each row. kind 1: (shingle, sets that hold it)
    for shingles that several distinct sets of one chunk hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[tuple[int, int]] = set()

        def flush() -> Iterator[pa.RecordBatch]:
            h = np.sort(np.concatenate(held))
            held.clear()
            seen.clear()
            edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
            n = np.diff(edge)
            h, n = h[edge[:-1]][n > 1], n[n > 1]
            yield _table(1, pa.nulls(len(h), pa.int64()), n, h.view(np.int64), np.zeros(len(h), np.int64))

        for batch in chunks(batches):
            sets = shingle_sets(batch, k)
            prints = [_prints(s) for s in sets]
            yield _table(0, batch.column("id").cast(pa.int64()), np.array([len(s) for s in sets], np.int64), np.array([p[0] for p in prints], np.int64), np.array([p[1] for p in prints], np.int64))
            for s, p in zip(sets, prints, strict=True):
                if len(s) and p not in seen:
                    seen.add(p)
                    held.append(s)
            if sum(map(len, held)) >= FLUSH:
                yield from flush()
        if held:
            yield from flush()

    return run


def _table(kind: int, ids: pa.Array, n: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int32)), ids, pa.array(n, pa.int64()), pa.array(x), pa.array(y)], ["kind", "id", "n", "x", "y"])


def _least(n: int, num: int, den: int) -> int:
    """How many common shingles a prefix of a set of n must show (a tenth of n at 80 %)."""
    return max(1, n * (den - num) // (2 * den))


def _prefixes(k: int, num: int, den: int, buckets: int, shared: Broadcast):
    """Blobs of prefix entries (shingle, id, size) by shingle bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_h, hot_n = shared.value
        maybe = np.zeros(1 << 22, bool)
        maybe[(hot_h >> np.uint64(42)).astype(np.int64)] = True
        held: list[tuple[np.ndarray, ...]] = []
        seen: set[tuple[int, int]] = set()

        def flush() -> Iterator[pa.RecordBatch]:
            h, ids, n = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            seen.clear()
            key = (mix(h) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(key.astype(np.uint16) if buckets < 65536 else key, kind="stable")
            edge = np.flatnonzero(np.diff(key[order], prepend=-1, append=-1))
            rows = [(int(key[order[a]]), *(x[order[a:b]].tobytes() for x in (h, ids, n))) for a, b in zip(edge[:-1], edge[1:], strict=True)]
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["bucket", "h", "ids", "n"])

        for batch in chunks(batches):
            ids, known = int64s(batch, "id")
            for i, s in enumerate(shingle_sets(batch, k)):
                p = _prints(s) if len(s) else None
                if p is None or not known[i] or p in seen:
                    continue
                seen.add(p)
                m = len(s)
                take = m - -(-num * m // den) + _least(m, num, den)
                low = maybe[(s >> np.uint64(42)).astype(np.int64)]
                if low.any():
                    at = np.minimum(np.searchsorted(hot_h, s[low]), max(len(hot_h) - 1, 0))
                    count = np.zeros(m, np.int64)
                    count[low] = np.where(hot_h[at] == s[low], hot_n[at], 0)
                    s = s[np.argsort(count, kind="stable")]
                s = s[:take]
                held.append((s, np.full(len(s), ids[i]), np.full(len(s), m, np.int32)))
            if sum(len(x[0]) for x in held) >= ENTRIES:
                yield from flush()
        if held:
            yield from flush()

    return run


def _lists(num: int, den: int):
    """(list, id) of every index list of two sets or more. Lists are ordered by set size and
    cut where no smaller set can qualify for a larger one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: dict[int, list[tuple[bytes, ...]]] = defaultdict(list)
        for batch in batches:
            cols = [batch.column(c) for c in ("h", "ids", "n")]
            for i, key in enumerate(batch.column("bucket").to_pylist()):
                mine[key].append(tuple(c[i].as_py() for c in cols))
        for key in list(mine):
            blobs = mine.pop(key)
            h, ids, n = (np.concatenate([np.frombuffer(b[j], t) for b in blobs]) for j, t in enumerate((np.uint64, np.int64, np.int32)))
            del blobs
            order = np.argsort(h)
            same = h[order][1:] == h[order][:-1]
            again = np.zeros(len(h), bool)
            again[1:] |= same
            again[:-1] |= same
            order = order[again]
            if not len(order):
                continue
            order = order[np.lexsort((n[order], h[order]))]
            hh, nn = h[order], n[order].astype(np.int64)
            new = np.concatenate([[True], (hh[1:] != hh[:-1]) | (nn[:-1] * den < num * nn[1:])])
            edge = np.append(np.flatnonzero(new), len(new))
            size = np.diff(edge)
            name = np.repeat(mix(hh[edge[:-1]] + nn[edge[:-1]].astype(np.uint64)), size).view(np.int64)
            live = np.repeat(size > 1, size)
            yield pa.RecordBatch.from_arrays([pa.array(name[live]), pa.array(ids[order][live])], ["list", "id"])
        release()

    return run


def _wanted(k: int, shared: Broadcast):
    """(id, set) of the documents whose bits are set; eight bytes a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            ids, known = int64s(batch, "id")
            slots = _slots(ids)
            keep = known & ((bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1).all(1)
            if not keep.any():
                continue
            for piece in chunks(iter([batch.filter(pa.array(keep))]), last=False):
                sets = shingle_sets(piece, k)
                blobs = [np.sort(s).tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([piece.column("id").cast(pa.int64()), pa.array(blobs, pa.binary())], ["id", "set"])

    return run


def _slots(ids: np.ndarray) -> np.ndarray:
    h = mix(ids.view(np.uint64))
    return np.stack([h & np.uint64(BLOOM_BITS - 1), h >> np.uint64(38)], 1).astype(np.int64)


def _bloom(ids: DataFrame) -> np.ndarray:
    """A bit table of fixed size (2^26 bits, two a key; 8 MB) over all ids, built by SQL bitmap
    aggregates. When it fills up it lets more documents through, never fewer."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _slots(int64s(batch, "id")[0]).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(s)], ["s"])

    got = ids.mapInArrow(slots, "s long").groupBy(F.expr("bitmap_bucket_number(s + 1)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(s + 1))").alias("bits")).collect()
    out = np.zeros(BLOOM_BITS // 8, np.uint8)
    for r in got:
        at = (r["b"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def _overlap_links(sets: list[np.ndarray], sizes: np.ndarray, num: int, den: int, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links of a block (of the links across, with ``sides``).

    Sets are taken by size. ``count`` holds the overlaps of the last set with those before
    it, from the first position whose size can qualify; the next set's are derived from it
    through the index lists of the shingles that only one of the two has, or computed anew
    where that is shorter. Index lists are in order of position, and of each list only the
    block between the first position that can qualify and the set itself is read.
    """
    order = np.argsort(sizes, kind="stable")
    n = sizes[order]
    flat = np.concatenate([sets[i] for i in order]) if len(order) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(order), dtype=np.int32), n)
    vocab, code = np.unique(flat, return_inverse=True)
    by = np.argsort(code, kind="stable")
    lists = owner[by]
    place = code[by] * len(order) + lists  # sorted: by list, then by position
    own = np.split(code, np.cumsum(n)[:-1])
    parent = np.arange(len(order))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def counts(codes: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """How many of the codes the sets at positions lo to hi - 1 have: blocks of their index
        lists, counted together."""
        a, b = np.searchsorted(place, codes * len(order) + lo), np.searchsorted(place, codes * len(order) + hi)
        size = b - a
        total = int(size.sum())
        if not total:
            return np.zeros(hi - lo, np.int64)
        at = np.repeat(a - np.cumsum(size) + size, size) + np.arange(total)
        return np.bincount(lists[at] - lo, minlength=hi - lo)

    links, count, start = [], np.zeros(0, np.int64), 0
    low = np.searchsorted(n * den, num * n).tolist()  # the positions before hold sizes that cannot qualify: skipped
    for x, lo in enumerate(low):
        if lo < x:
            mine, last = own[x], own[x - 1]
            plus, minus = np.setdiff1d(mine, last, assume_unique=True), np.setdiff1d(last, mine, assume_unique=True)
            if len(plus) + len(minus) < len(mine):
                count = count[lo - start :] + counts(plus, lo, x) - counts(minus, lo, x)
            else:
                count = counts(mine, lo, x)
        else:
            count = np.zeros(0, np.int64)
        y = np.arange(lo, x)
        hit = y[count * den >= num * (n[x] + n[y] - count)]
        count, start = np.append(count, n[x]), lo  # a set shares all it has with itself
        if sides is not None:
            hit = hit[sides[order[hit]] != sides[order[x]]]
        for z in hit.tolist():
            r, s = root(z), root(x)
            if r != s:
                parent[max(r, s)] = min(r, s)
                links.append((int(order[z]), int(order[x])))
    return links


def _join_groups(num: int, den: int):
    """The links of each (g, i, j); rows come sorted by it, so one group is held at a time."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        sets = [np.frombuffer(r[5], np.uint64) for r in rows]
        across = rows[0][1] != rows[0][2]
        links = _overlap_links(sets, np.array([len(s) for s in sets], np.int64), num, den, np.array([r[3] for r in rows]) if across else None)
        return pa.RecordBatch.from_arrays([pa.array([rows[a][4] for a, _ in links], pa.int64()), pa.array([rows[b][4] for _, b in links], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("g", "i", "j", "block", "id", "set")), strict=True):
                if held and held[0][:3] != row[:3]:
                    yield solve(held)
                    held = []
                held.append(row)
        if held:
            yield solve(held)

    return run


def jaccard_components(docs: DataFrame, percent: int = 80, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of ``docs``: id, n_shingles, component_id.

    Words are runs outside white space, A-Z in lower case. A text of fewer than ``k`` words
    is one shingle; a text without words, or null, has none and is linked with nothing. Two
    rows link when 100 * |intersection| >= percent * |union|; component_id is the smallest
    id reachable by links. Null ids take no part and get a null component. Rows that share
    an id count each with its own set. Other columns are not read.
    """
    if not 1 <= percent <= 100 or k < 1:
        raise ValueError("percent must be 1 to 100 and k positive")
    spark, num, den = docs.sparkSession, percent, 100
    parts = parts_for(docs)
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    survey = cut(base.mapInArrow(_survey(k), "kind int, id long, n long, x long, y long"), "sets", max(2, parts // 8))
    hot = survey.where("kind = 1").groupBy("x").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_LEAST).orderBy(F.desc("n"), "x").limit(HOT).collect()
    hot_h = np.array([r["x"] for r in hot], np.int64).view(np.uint64)
    order = np.argsort(hot_h)
    hot_h, hot_n = hot_h[order], np.array([r["n"] for r in hot], np.int64)[order]
    info = survey.where("kind = 0").select("id", "n", "x", "y")
    classes = info.where("n > 0 and id is not null").groupBy("x", "y", "n").agg(F.min("id").alias("rep"))
    # both sides are tables, so that AQE can split the class that a third of all rows may be in
    classes = cut(classes, "representatives")
    known = cut(info.join(classes, ["x", "y", "n"], "left").select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("rep")), "classes")
    share = spark.sparkContext.broadcast
    sent = base.mapInArrow(_prefixes(k, num, den, parts, share((hot_h, hot_n))), "bucket long, h binary, ids binary, n binary")
    entries = cut(sent.repartitionById(parts, F.col("bucket").cast("int")).mapInArrow(_lists(num, den), "list long, id long"), "entries", max(2, parts // 8))
    # sets that share too little with all others together have no link; the rest meet by list
    sets = known.where("id is not null and n_shingles > 0").groupBy("id", "rep").agg(F.max("n_shingles").alias("n"))
    need = F.greatest(F.lit(1), F.expr(f"ceil(n * {num} / {den}) * {den - num} div {2 * den}"))
    live = entries.groupBy("id").agg(F.count("*").alias("c")).join(sets, "id").where(F.col("c") >= need).select("id", "rep")
    listed = cut(entries.join(live, "id").select("list", "rep").distinct(), "listed")
    heads = listed.groupBy("list").agg(F.min("rep").alias("g"), F.max("rep").alias("last")).where("g < last").select("list", "g")
    lists = cut(listed.join(heads, "list").select("g", F.col("rep").alias("id")).distinct(), "lists")
    # a group larger than a block is cut into blocks; each pair of its blocks meets once
    sizes = known.groupBy(F.col("rep").alias("id")).agg(F.max("n_shingles").alias("n"))
    total = lists.join(sizes, "id").groupBy("g").agg(F.count("*").alias("m"), F.sum("n").alias("n")).where("m > 1")
    total = total.select("g", F.ceil(F.col("n") * 8 / block_bytes).cast("int").alias("blocks"))
    work = lists.join(total, "g").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    work = work.select("g", "id", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    work = cut(work.select("g", "id", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")), "work")
    sets = base.mapInArrow(_wanted(k, share(_bloom(work.select("id").distinct()))), "id long, set binary")
    meet = work.join(sets, "id").repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")
    links = meet.mapInArrow(_join_groups(num, den), "a long, b long")
    comps = components(links)
    out = known.join(comps, known["rep"] == comps["node"], "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "rep").alias("component_id"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = """
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
r AS (SELECT doc_id AS id, doc_id AS to_id FROM documents UNION SELECT r.id, l.b FROM r JOIN l ON r.to_id = l.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.to_id) AS component_id
FROM documents d JOIN r ON r.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
