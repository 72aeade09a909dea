"""Approximate nearest neighbours by collision counting over single projections.

Vectors are indexed in blocks. A block keeps, for each of ``projections`` random directions,
the projected values in sorted order. A query opens a window around its own projection in
every array; a vector collides once for each window it is in. Virtual rehashing widens all
windows by the same factor until at least ``share`` of the block (and k vectors) have
collided ``need`` times or more; exactly those are verified, with inner products in double
precision on the original vectors.

Largest inner product becomes a nearest-neighbour search by one added coordinate,
sqrt(M^2 - |x|^2), which is 0 for unit vectors; queries are scaled to length M with 0 there.
That coordinate says little about direction, so it has to stay small: a block is cut into
bands of nearly equal norm, each with its own M. Bands are met from the longest vectors on,
and those whose bound |q| M is below the k-th score so far are skipped.

Queries (a stated part of the rows) meet all blocks in blocks of their own: a data block
goes to one task, once, and the query blocks follow it there. Each meeting answers with one
blob of its k best, and the answers to a query block are merged as they come, so that only
the best so far are held.

Collisions are counted over ranks, a projection at a time, rather than by walking the window
in the sorted array: at the widths that recall needs, windows hold four fifths of an array,
and walking them takes two to three times as long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import cut, table

PROJECTIONS = 64
SHARE = 0.12
NEED = 0.85
GROWTH = 1.08
BLOCK = 16384
QUERY_BLOCK = 512
#: Largest ratio of norms in a band, and vectors that a band has to have to be worth an index.
BAND = 1.1
LEAST = 256


def directions(dim: int, count: int, seed: int) -> np.ndarray:
    """Random directions as columns, orthonormal in sets of ``dim``: together they tell more
    about a distance than independent ones."""
    rng = np.random.default_rng(seed)
    sets = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-count // dim))]
    return np.concatenate(sets, 1)[:, :count].copy()


class Index:
    """Sorted projection arrays of one block."""

    def __init__(self, vectors: np.ndarray, top: float, projections: int, seed: int = 1):
        self.vectors, self.top, self.level = vectors, top, 0
        self.directions = directions(vectors.shape[1] + 1, projections, seed)
        extra = np.sqrt(np.maximum(top * top - (vectors**2).sum(1), 0))
        values = (np.concatenate([vectors, extra[:, None]], 1) @ self.directions).T
        order = np.argsort(values, axis=1, kind="stable")
        # the sorted arrays end to end, each moved past the one before, so that one search serves all
        reach = 4 * top * max(1.0, float(np.abs(values).max() / top))
        self.shift = np.arange(projections) * reach
        self.bound = reach / 2.5
        self.values = (np.take_along_axis(values, order, 1) + self.shift[:, None]).ravel()
        self.rank = np.empty(order.shape, np.uint16 if order.shape[1] < 65536 else np.uint32)
        np.put_along_axis(self.rank, order, np.arange(order.shape[1], dtype=self.rank.dtype)[None], 1)

    def collisions(self, centre: np.ndarray, width: float) -> np.ndarray:
        """For each vector, the number of windows it is in."""
        n, m = len(self.vectors), len(self.rank)
        ends = np.clip(np.stack([centre - width, np.nextafter(centre + width, np.inf)]), -self.bound, self.bound) + self.shift
        lo, hi = np.clip(np.searchsorted(self.values, ends) - np.arange(m) * n, 0, n)
        count = np.zeros(n, np.uint8 if m < 256 else np.uint16)
        kind = self.rank.dtype.type
        for r, a, s in zip(self.rank, lo.tolist(), (hi - lo).tolist(), strict=True):
            if s:
                count += ((r - kind(a)) < kind(s)).view(np.uint8) if s < n else kind(1)
        return count

    def candidates(self, q: np.ndarray, k: int, share: float, need: float, growth: float = GROWTH) -> np.ndarray:
        """Vectors that collide with the query in ``need`` of the windows, at the first width
        of the ladder at which enough of them do. Hits grow with the width, so the search for
        that width starts where the last query's ended."""
        n, m = len(self.vectors), len(self.rank)
        goal, most = min(n, max(k, int(np.ceil(share * n)))), max(1, int(np.ceil(need * m)))
        centre = (q * (self.top / np.sqrt((q * q).sum()))) @ self.directions[:-1]
        base = self.top * 0.5 / np.sqrt(len(self.directions) / 2)

        def at(level: int) -> np.ndarray:
            return np.flatnonzero(self.collisions(centre, base * growth**level) >= most)

        level, hit = self.level, at(self.level)
        if len(hit) >= goal:
            while level > 0 and len(less := at(level - 1)) >= goal:
                level, hit = level - 1, less
        else:
            while len(hit) < goal:
                level += 1
                hit = at(level)
        self.level = level
        return hit


class Bands:
    """The vectors of one block in bands of falling norm. Where fewer than ``least`` are of
    nearly equal norm, as many make a band that is verified whole."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, projections: int, least: int = LEAST):
        norms = _norms(vectors)
        order = np.argsort(-norms, kind="stable")
        rows, ids, vectors, norms = rows[order], ids[order], vectors[order], norms[order]
        self.parts, at = [], 0
        while at < len(ids):
            end = int(np.searchsorted(-norms, -norms[at] / BAND, "right"))
            index = end - at >= least
            end = end if index else min(at + least, len(ids))
            v = vectors[at:end]
            self.parts.append((float(norms[at]), rows[at:end], ids[at:end], v, Index(v / norms[at], 1.0, projections) if index else None))
            at = end

    def search(self, q: np.ndarray, own: int, k: int, share: float, need: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, row numbers, scores) of the k best found, the row ``own`` left out."""
        size = _norms(q[None])[0]
        best, number, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for top, rows, ids, vectors, index in self.parts:
            if len(best) == k and size * top * (1 + 1e-9) < score[-1]:
                break
            near = np.arange(len(ids)) if index is None else index.candidates(q / size, k + 1, share, need)
            near = near[rows[near] != own]
            best, number = np.concatenate([best, ids[near]]), np.concatenate([number, rows[near]])
            score = np.concatenate([score, np.einsum("ij,j->i", vectors[near], q)])
            order = np.lexsort((number, best, -score))[:k]
            best, number, score = best[order], number[order], score[order]
        return best, number, score


def _norms(vectors: np.ndarray) -> np.ndarray:
    most = np.abs(vectors).max(1)
    return most * np.sqrt(((vectors / most[:, None]) ** 2).sum(1))


_BLOB = ["rows", "ids", "vecs"]


def _blocks(size: int | None):
    """Rows of a partition as blobs (row numbers, ids, vectors) of ``size`` vectors, or as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([np.concatenate(x).tobytes()], pa.binary()) for x in zip(*held, strict=True)], _BLOB)
            held.clear()
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, size or max(1, batch.num_rows)):
                part = batch.slice(at, size or batch.num_rows)
                if size and held and sum(len(x[0]) for x in held) + part.num_rows > size:
                    yield flush()
                held.append((np.asarray(part.column("u"), np.int64), np.asarray(part.column("id"), np.int64), np.asarray(part.column("v").flatten(), np.float64)))
        if held:
            yield flush()

    return run


def _unblob(batch: pa.RecordBatch, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, ids = (np.frombuffer(batch.column(c)[r].as_py(), np.int64) for c in _BLOB[:2])
    return rows, ids, np.frombuffer(batch.column("vecs")[r].as_py(), np.float64).reshape(len(rows), -1)


def _meet(k: int, projections: int, share: float, need: float):
    """Each data block's row (``asked`` is -1) is followed by the query blocks that meet it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, bands = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                block, asked = batch.column("block")[r].as_py(), batch.column("asked")[r].as_py()
                rows, ids, vecs = _unblob(batch, r)
                if asked < 0:
                    bands, last = Bands(rows, ids, vecs, projections), block
                    continue
                if block != last:
                    continue  # no data there
                found = [bands.search(v, u, k, share, need) for u, v in zip(rows.tolist(), vecs, strict=True)]
                query = np.repeat(np.arange(len(rows)), [len(x[0]) for x in found])
                cols = [query, *(np.concatenate([x[j] for x in found]) for j in range(3))]
                yield pa.RecordBatch.from_arrays([batch.column("asked").slice(r, 1), pa.array([ids.tobytes()], pa.binary()), *(pa.array([c.tobytes()], pa.binary()) for c in cols)], ["asked", "q_ids", "query", "ids", "rows", "scores"])

    return run


def _best(k: int):
    """The k best of each query of a query block; answers come sorted by block, and only the
    best so far are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, q_ids, held = None, None, []

        def top() -> list[np.ndarray]:
            q, v, u, s = (np.concatenate([h[i] for h in held]) for i in range(4))
            order = np.lexsort((u, v, -s, q))
            q, v, u, s = q[order], v[order], u[order], s[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            keep = rank < k
            return [q[keep], v[keep], u[keep], s[keep], rank[keep] + 1]

        def told() -> pa.RecordBatch:
            q, v, _, s, rank = top()
            return pa.RecordBatch.from_arrays([pa.array(q_ids[q]), pa.array(rank.astype(np.int32)), pa.array(v), pa.array(s)], ["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            for r in range(batch.num_rows):
                asked = batch.column("asked")[r].as_py()
                if asked != last:
                    if held:
                        yield told()
                    last, q_ids, held = asked, np.frombuffer(batch.column("q_ids")[r].as_py(), np.int64), []
                held.append([np.frombuffer(batch.column(c)[r].as_py(), t) for c, t in (("query", np.int64), ("ids", np.int64), ("rows", np.int64), ("scores", np.float64))])
                if len(held) >= 16:
                    held = [top()[:4]]
        if held:
            yield told()

    return run


def nearest(vectors: DataFrame, queries: F.Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", projections: int = PROJECTIONS, share: float = SHARE, need: float = NEED, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product found for each row
    that ``queries`` selects, its own id left out; ties go to the smaller id.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part,
    as queries or as answers, nor do null ids. Only vectors of the most common length are
    comparable; other lengths take no part either. Rows of equal id and vector count once;
    rows that share an id but not the vector each ask and are found, a query being kept from
    its own row alone. With k rows or fewer, all are returned.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("q"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(~bad & F.exists("v", lambda x: x != 0))
    v = v.groupBy("id", "v").agg(F.max("q").alias("q"))
    v = cut(v.withColumn("u", F.monotonically_increasing_id()), "vectors")
    sizes = v.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.count(F.when(F.col("q"), 1)).alias("q")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    v = v.where(F.size("v") == sizes["d"])
    blocks = max(1, -(-sizes["n"] // block))
    q_blocks = max(1, -(-sizes["q"] // QUERY_BLOCK))
    blob = "rows binary, ids binary, vecs binary"
    # dealt by row number, so that blocks are of even size whatever the ids
    packed = v.select("u", "id", "v").repartition(blocks, F.xxhash64("u")).mapInArrow(_blocks(None), blob)
    packed = cut(packed.select(F.spark_partition_id().alias("block"), F.lit(-1).cast("long").alias("asked"), *_BLOB), "blocks")
    asked = v.where("q").select("u", "id", "v").repartition(q_blocks, F.xxhash64("u")).mapInArrow(_blocks(QUERY_BLOCK), blob)
    asked = cut(asked.withColumn("asked", F.monotonically_increasing_id()), "asked")
    # every query block goes to every data block: the numbers of the blocks, not their rows, are exploded
    last = packed.agg(F.max("block")).first()[0]
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(last))).alias("block"), "asked", *_BLOB)
    pairs = packed.unionByName(asked).repartitionById(last + 1, F.col("block")).sortWithinPartitions("block", "asked")
    found = pairs.mapInArrow(_meet(k, projections, share, need), "asked long, q_ids binary, query binary, ids binary, rows binary, scores binary")
    found = found.repartition(q_blocks, "asked").sortWithinPartitions("asked")
    return found.mapInArrow(_best(k), "query_id long, rank int, vec_id long, score double")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
