"""Benchmark passages inside documents, by greedy string tiling.

Documents and benchmark items first meet through shared seeds: runs of ``tile`` words, the
least that a tile can have. All tiles of a pair lie on words that its shared seeds cover, so
a pair whose seeds cover less than ``percent`` of the item cannot be a leak, and no other
pair is put aside. For each one that is left, running Karp-Rabin greedy string tiling
repeatedly marks the longest non-overlapping common runs of words, down to ``tile`` words,
so reordered or interrupted passages still add up. An item is leaked where the tiles cover
at least ``percent`` of its words.

The benchmark is the stated query set: it is read in blocks of at most ``BLOCK_BYTES`` of
text (one block for any usual benchmark), each broadcast and held against all documents in
one pass without a shuffle. Coverage is a matter of one document and one item, so blocks
are independent.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import table
from .words import Words, chunks, int64s, rolling

TILE = 3
#: Meetings of seeds that are held at once.
MEETINGS = 1 << 20
PERCENT = 80
BLOCK_BYTES = 8 << 20
_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _words(texts: pa.Array) -> tuple[Words, np.ndarray]:
    """Runs of letters and digits, A-Z in lower case; punctuation and spacing don't count."""
    words = Words(texts, lower=True, space=_BREAK)
    return words, words.hashes(9)


def greedy_tiles(pattern: np.ndarray, text: np.ndarray, tile: int) -> list[tuple[int, int, int]]:
    """(place in pattern, place in text, length) of the tiles of two word sequences.

    Running Karp-Rabin: substrings of the search length are hashed, equal ones extended and
    queued by length; a match over twice the search length restarts the scan with it.
    """
    tile = max(1, min(tile, len(pattern)))
    # words that the pattern lacks split the text; shorter pieces can hold no tile
    inside = np.isin(text, pattern)
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    pieces = [(a, b) for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a >= tile]
    if not pieces:
        return []
    where = np.concatenate([np.append(np.arange(a, b), -1) for a, b in pieces])
    t_word = np.where(where >= 0, text[where], 0)
    p_used, t_used = np.zeros(len(pattern) + 1, bool), np.append(where < 0, True)
    p_used[-1] = True
    out, size = [], min(max(tile, 20), len(pattern))
    while True:
        p_at = _free(p_used, size)
        t_at = _free(t_used, size)
        found: list[tuple[int, int, int]] = []
        longest = 0
        if len(p_at) and len(t_at):
            index: dict[int, list[int]] = defaultdict(list)
            for h, a in zip(rolling(pattern, p_at, p_at + size, 1).tolist(), p_at.tolist(), strict=True):
                index[h].append(a)
            th = rolling(t_word, t_at, t_at + size, 1)
            near = np.isin(th, np.array(list(index), np.uint64))
            for h, b in zip(th[near].tolist(), t_at[near].tolist(), strict=True):
                for a in index[h]:
                    if a and b and not p_used[a - 1] and not t_used[b - 1] and pattern[a - 1] == t_word[b - 1]:
                        continue  # part of the match that starts one word before
                    n = 0
                    while not p_used[a + n] and not t_used[b + n] and pattern[a + n] == t_word[b + n]:
                        n += 1
                    if n >= size:
                        found.append((n, a, b))
                        longest = max(longest, n)
        if longest > 2 * size:
            size = longest
            continue
        queue = sorted(found, key=lambda x: (-x[0], x[1], x[2]))
        for n, a, b in queue:
            if not p_used[a : a + n].any() and not t_used[b : b + n].any():
                p_used[a : a + n] = t_used[b : b + n] = True
                out.append((a, int(where[b]), n))
        if any(len(_free(p_used[a : a + n] | t_used[b : b + n], size)) for n, a, b in queue):
            continue  # a match that was cut off has left a part that is long enough
        if size <= tile:
            return out
        size = max(tile, size // 2)


def _free(used: np.ndarray, size: int) -> np.ndarray:
    """Starts of ``size`` unused places in a row."""
    total = np.concatenate([[0], np.cumsum(used)])
    return np.flatnonzero(total[size:] == total[:-size]) if len(used) >= size else np.zeros(0, np.int64)


class Items:
    """A block of the benchmark: seeds in order of hash with the places of each, and each
    item's words. A place counts the words of all items before it."""

    def __init__(self, ids: list[int | None], texts: list[str], tile: int):
        words, h = _words(pa.array(texts, pa.string()))
        self.ids = ids
        self.first = words.first
        self.words = [h[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        length = np.diff(words.first)
        # an item shorter than a tile is its own seed
        self.size = np.minimum(length, tile)
        self.sizes = sorted(set(self.size.tolist()) - {0})
        owner = np.repeat(np.arange(len(ids)), length)
        at = np.arange(len(h))
        at = at[at + self.size[owner] <= words.first[1:][owner]]
        seeds = rolling(h, at, at + self.size[owner[at]], 2)
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.place = seeds[order], at[order]
        self.owner = owner


def _meetings(d: np.ndarray, s: np.ndarray, items: Items) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, place) of every seed that a document shares, about ``MEETINGS`` at a time;
    a document's meetings stay together."""
    lo, hi = np.searchsorted(items.seeds, s), np.searchsorted(items.seeds, s, "right")
    total = np.cumsum(hi - lo)
    at = 0
    while at < len(d):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + MEETINGS)))
        to = int(np.searchsorted(d, d[to - 1], "right"))
        n = hi[at:to] - lo[at:to]
        yield np.repeat(d[at:to], n), items.place[np.repeat(lo[at:to] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        at = to


def candidates(words: Words, h: np.ndarray, items: Items, percent: int) -> list[tuple[int, int]]:
    """(document, item) of all pairs whose shared seeds cover ``percent`` of the item or more."""
    docs, d, s = words.docs(), [], []
    for k in items.sizes:
        at, seeds = words.windows(h, k, 2)
        lo = np.minimum(np.searchsorted(items.seeds, seeds), max(len(items.seeds) - 1, 0))
        hit = items.seeds[lo] == seeds
        d.append(docs[at[hit]])
        s.append(seeds[hit])
    if not d or not sum(map(len, d)):
        return []
    d, s = np.concatenate(d), np.concatenate(s)
    order = np.lexsort((s, d))
    d, s = d[order], s[order]
    new = np.append(True, (d[1:] != d[:-1]) | (s[1:] != s[:-1]))
    out, n = [], max(1, len(items.owner))
    for doc, place in _meetings(d[new], s[new], items):
        # places in order: each covers words up to the next one of its item, at most a seed's
        key = np.unique(doc * n + place)
        doc, place = key // n, key % n
        item = items.owner[place]
        last = np.append((doc[1:] != doc[:-1]) | (item[1:] != item[:-1]), True)
        gap = np.append(place[1:] - place[:-1], 0)
        covers = np.where(last, items.size[item], np.minimum(gap, items.size[item]))
        start = np.flatnonzero(np.append(True, last[:-1]))
        covered = np.add.reduceat(covers, start)
        length = np.diff(items.first)[item[start]]
        ok = 100 * covered >= percent * length
        out += zip(doc[start][ok].tolist(), item[start][ok].tolist(), strict=True)
    return sorted(out)


def leaks(batch: pa.RecordBatch, items: Items, tile: int, percent: int) -> list[tuple]:
    words, h = _words(batch.column("text"))
    ids, known = int64s(batch, "id")
    out = []
    for doc, i in candidates(words, h, items, percent):
        tiles = greedy_tiles(items.words[i], h[words.first[doc] : words.first[doc + 1]], tile)
        size, covered = len(items.words[i]), sum(n for _, _, n in tiles)
        if 100 * covered >= percent * size:
            out.append((int(ids[doc]) if known[doc] else None, items.ids[i], size, covered, len(tiles)))
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, tile: int = TILE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, item_id, item_words, covered_words, n_tiles) of every leaked item in every row.

    Words are runs of letters and digits with A-Z in lower case. Items with fewer than
    ``tile`` words have themselves as their one tile; items and texts that are null or
    without words match nothing. Null ids are reported as null; a document row repeated is
    reported again, an item row repeated is not. An empty table on either side gives no rows.
    """
    if tile < 1 or not 1 <= percent <= 100:
        raise ValueError("tile must be positive, percent 1 to 100")
    spark = docs.sparkSession
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("i"), F.col(f"`{item_text}`").alias("t")).where("t is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks, out = max(1, -(-size // block_bytes)), []
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()
        part.sort(key=lambda r: (r["i"] is None, r["i"] or 0, r["t"]))
        shared = spark.sparkContext.broadcast(([r["i"] for r in part], [r["t"] for r in part]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = Items(*shared.value, tile)
            for batch in chunks(batches):
                found = leaks(batch, items, tile, percent)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["id", "item_id", "item_words", "covered_words", "n_tiles"])

        out.append(base.mapInArrow(run, "id long, item_id long, item_words long, covered_words long, n_tiles long"))
    return reduce(DataFrame.unionAll, out).withColumnRenamed("id", id_col)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaked items of all documents, with the share of the item that tiles cover."""
    out = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.withColumn("coverage", F.col("covered_words") / F.col("item_words"))
