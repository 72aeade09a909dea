"""Byte-level BPE encoding and decoding by DuckDB recursive queries inside each partition.

Texts are cut into pretokens by the tokenizer's pattern. A pretoken that is itself in the
vocabulary is one token; every other distinct one starts as rows (word, position, next
position, token) of single bytes. A recursive query joins neighbouring tokens with the merge table, finds each
word's leftmost pair of least rank and contracts it, for all words at once, until no word
has a pair left. The merge table holds every split of every vocabulary entry into two
entries, which is what merging by the rank of the joined bytes means.

Decoding joins the ids with the vocabulary and concatenates bytes by an ordered aggregate.

Distinct words repeat, so a task remembers the words it has encoded, up to ``REMEMBER``, then
starts anew; at its end it forgets them, because workers outlive tasks. One step a merge is
quadratic in a word's length, so a word of more than ``LONG`` bytes contracts more in a step:
all places of its pair of least rank, from the left, up to the first one whose new neighbours
make a pair of lower rank, which is the one that the order of ranks puts next. The result is
the same. One pass, no shuffle, DuckDB on one thread without files and with memory in
proportion to the longest word.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import table
from .words import chunks, release

REMEMBER = 1_200_000
LONG = 256
WORDS_AT_ONCE = 40_000
TOKENS_AT_ONCE = 500_000
_MERGE = """
WITH RECURSIVE s(w, p, n, t, live) AS (
  SELECT w, p, n, t, true FROM start
  UNION ALL
  (WITH hits AS (SELECT a.w, a.p, a.n AS q, b.n, m FROM s a JOIN s b ON a.n = b.p AND b.live JOIN merges ON a.t = l AND b.t = r WHERE a.live),
        best AS (SELECT w, min(m::BIGINT * 4294967296 + p) AS k FROM hits GROUP BY w),
        pick AS (SELECT hits.* FROM hits JOIN best ON hits.w = best.w AND m::BIGINT * 4294967296 + p = k)
   SELECT s.w, s.p, CASE WHEN s.p = x.p THEN x.n ELSE s.n END, CASE WHEN s.p = x.p THEN x.m ELSE s.t END, x.w IS NOT NULL
   FROM s LEFT JOIN pick x ON s.w = x.w WHERE s.live AND (x.w IS NULL OR s.p <> x.q)))
SELECT w, t FROM s WHERE NOT live ORDER BY w, p
"""
_MERGE_LONG = """
WITH RECURSIVE s(w, p, t) USING KEY (w, p) AS (
  SELECT w, p, t FROM start
  UNION
  (WITH pairs AS (SELECT w, p, t, lead(t) OVER o AS nt, lead(p) OVER o AS np, lead(t, 2) OVER o AS t3, lag(t) OVER o AS t0, row_number() OVER o AS i
                  FROM recurring.s WHERE t IS NOT NULL WINDOW o AS (PARTITION BY w ORDER BY p)),
        hits AS (SELECT w, i, p, np, m, t0, t3 FROM pairs JOIN merges ON t = l AND nt = r),
        best AS (SELECT w, min(m) AS m FROM hits GROUP BY w),
        runs AS (SELECT h.*, h.i - row_number() OVER (PARTITION BY h.w ORDER BY h.i) AS run FROM hits h JOIN best b ON h.w = b.w AND h.m = b.m),
        odd AS (SELECT w, i, p, np, m, t3, CASE WHEN lag(i) OVER (PARTITION BY w ORDER BY i) = i - 2 THEN m ELSE t0 END AS t0
                FROM (SELECT *, row_number() OVER (PARTITION BY w, run ORDER BY i) AS k FROM runs) WHERE k % 2 = 1),
        stop AS (SELECT w, min(i) AS i FROM odd JOIN back b ON m = b.t AND CASE WHEN b.after THEN t3 ELSE t0 END = b.x GROUP BY w),
        pick AS (SELECT odd.w, p, np, m FROM odd LEFT JOIN stop ON odd.w = stop.w WHERE stop.i IS NULL OR odd.i <= stop.i)
   SELECT w, unnest([p, np]) AS p, unnest([m, NULL]) AS t FROM pick))
SELECT w, t FROM s WHERE t IS NOT NULL ORDER BY w, p
"""
#: For each token, the neighbours with which it makes a token of lower rank.
_BACK = "CREATE TABLE back AS SELECT l AS t, r AS x, true AS after FROM merges WHERE m < l UNION ALL SELECT r, l, false FROM merges WHERE m < r"
_DECODE = "SELECT d, array_to_string(list(h ORDER BY p), '') AS x FROM ids JOIN vocab USING (id) GROUP BY d ORDER BY d"


@dataclass(frozen=True)
class Vocabulary:
    """Ranks in file order (the id is the rank) and the pretoken pattern; fixed size."""

    tokens: tuple[bytes, ...]
    ids: tuple[int, ...]
    pattern: str


def read_vocabulary(path: str, pattern: str) -> Vocabulary:
    """Lines of base64 bytes and a rank. Read on the driver; the path is a parameter."""
    with open(path, "rb") as f:
        rows = [line.split() for line in f if line.strip()]
    return Vocabulary(tuple(base64.b64decode(a) for a, _ in rows), tuple(int(b) for _, b in rows), pattern)


class _Known(dict):
    """Numbers of words in order of arrival; new ones are noted."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Codec:
    """One worker's DuckDB tables and remembered words."""

    def __init__(self, vocabulary: Vocabulary):
        self.ranks = dict(zip(vocabulary.tokens, vocabulary.ids, strict=True))
        self.pattern = regex.compile(vocabulary.pattern)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        splits = [(l, r, m) for t, m in self.ranks.items() for i in range(1, len(t)) if (l := self.ranks.get(t[:i])) is not None and (r := self.ranks.get(t[i:])) is not None]
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "256MB", "temp_directory": ""})
        left, right, to = (pa.array(x, pa.int32()) for x in zip(*splits, strict=True)) if splits else (pa.array([], pa.int32()),) * 3
        self._load("merges", pa.table({"l": left, "r": right, "m": to}))
        self.con.execute(_BACK)
        self._load("vocab", pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "h": pa.array([t.hex() for t in self.ranks])}))
        self.valid = np.zeros(max(self.ranks.values()) + 1, bool)
        self.valid[list(self.ranks.values())] = True
        self._forget()

    def _load(self, name: str, rows: pa.Table) -> None:
        self.con.register("incoming", rows)
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.con.unregister("incoming")

    def _forget(self) -> None:
        self.known = _Known()
        self.flat: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def end(self) -> None:
        """Free what a task has gathered."""
        self._forget()
        for name in ("start", "ids"):
            self.con.execute(f"DROP TABLE IF EXISTS {name}")
        release()

    def _learn(self, words: list[str]) -> None:
        """Encode new distinct words, in the order of their numbers."""
        raw = [w.encode() for w in words]
        whole = list(map(self.ranks.get, raw))
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        known = np.array([x is not None for x in whole])
        short, long = np.flatnonzero(~known & (length <= LONG)), np.flatnonzero(~known & (length > LONG))
        one = np.flatnonzero(known)
        found = [(one, np.array([whole[i] for i in one.tolist()], np.int32), np.ones(len(one), np.int64))]
        self.con.execute(f"SET memory_limit = '{256 + int(length[long].max(initial=0)) // 4096}MB'")
        parts = [(short[a : a + WORDS_AT_ONCE], _MERGE) for a in range(0, len(short), WORDS_AT_ONCE)] + [(long[i : i + 1], _MERGE_LONG) for i in range(len(long))]
        found += [(part, *self._contract([raw[i] for i in part.tolist()], sql)) for part, sql in parts]
        size = np.empty(len(raw), np.int64)
        for part, _, n in found:
            size[part] = n
        start = np.cumsum(size) - size
        flat = np.empty(int(size.sum()), np.int32)
        for part, ids, n in found:
            flat[np.repeat(start[part] - np.cumsum(n) + n, n) + np.arange(len(ids))] = ids
        self.flat.append(flat)
        self.sizes.append(size)

    def _contract(self, raw: list[bytes], sql: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of each word's) by one of the recursions."""
        size = np.array([len(b) for b in raw])
        data = np.frombuffer(b"".join(raw), np.uint8)
        w = np.repeat(np.arange(len(raw), dtype=np.int32), size)
        p = np.arange(len(data), dtype=np.int32)
        last = np.zeros(len(data), bool)
        last[np.cumsum(size) - 1] = True
        self._load("start", pa.table({"w": w, "p": p, "n": pa.array(p + 1, mask=last), "t": self.single[data]}))
        out = self.con.sql(sql).to_arrow_table()
        return out.column("t").to_numpy(), np.bincount(out.column("w").to_numpy(), minlength=len(raw))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, first of each text and the end)."""
        if len(self.known) > REMEMBER:
            self._forget()
        found = [self.pattern.findall(t) for t in texts]
        word_end = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
        if not word_end[-1]:
            return np.zeros(0, np.int32), word_end
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(found)), np.int64, word_end[-1])
        if self.known.new:
            self._learn(self.known.new)
            self.known.new = []
            self.flat, self.sizes = [np.concatenate(self.flat)], [np.concatenate(self.sizes)]
        flat, size = self.flat[0], self.sizes[0]
        start = np.cumsum(size) - size
        n = size[at]
        end = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(start[at] - end[:-1], n) + np.arange(end[-1])]
        return ids, end[word_end]

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[bytes]:
        """The bytes of each text; an id outside the vocabulary raises ValueError."""
        out: list[bytes] = []
        at, n = 0, len(first) - 1
        if len(ids) and not (0 <= ids.min() and ids.max() < len(self.valid) and self.valid[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        while at < n:
            to = max(at + 1, int(np.searchsorted(first, first[at] + TOKENS_AT_ONCE, "right")) - 1)
            out += [b""] * (to - at)
            part = ids[first[at] : first[to]]
            d = np.repeat(np.arange(at, to, dtype=np.int64), np.diff(first[at : to + 1]))
            self._load("ids", pa.table({"d": d, "p": np.arange(len(part), dtype=np.int64), "id": part}))
            got = self.con.sql(_DECODE).to_arrow_table()
            for i, x in zip(got.column("d").to_pylist(), got.column("x").to_pylist(), strict=True):
                out[i] = bytes.fromhex(x)
            at = to
        return out


_CODECS: dict[int, Codec] = {}


def _codec(vocabulary: Vocabulary) -> Codec:
    """Kept for the life of a worker, so that tasks share the tables."""
    key = hash(vocabulary)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(vocabulary)
    return _CODECS[key]


def _texts(batch: pa.RecordBatch) -> list[str]:
    return pc.fill_null(batch.column("text"), "").to_pylist()


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", digest: bool = False, ids_col: str = "ids") -> DataFrame:
    """``docs`` without its text, with ``n_tokens`` and ``ids`` (array<int>); or, with
    ``digest``, with ``n_tokens``, ``ids_sha256`` and the ``decoded_sha256`` of the ids decoded
    again. No special tokens; null texts are empty; every text is encoded whole. Other
    columns pass unchanged, those of these names are replaced.
    """
    new = ("n_tokens", "ids_sha256", "decoded_sha256") if digest else ("n_tokens", ids_col)
    keep = [c for c in docs.columns if c != text_col and c not in new]
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in chunks(batches, limit=1 << 20):
            ids, first = codec.encode(_texts(batch))
            made = [pa.array(np.diff(first), pa.int64())]
            if digest:
                plain = codec.decode(ids, first)
                words = ids.astype("<u4")
                made.append(pa.array([hashlib.sha256(words[a:b].tobytes()).hexdigest() for a, b in zip(first[:-1], first[1:], strict=True)], pa.string()))
                made.append(pa.array([hashlib.sha256(x).hexdigest() for x in plain], pa.string()))
            else:
                made.append(pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32())))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made], [*batch.schema.names[1:], *(f"m{i}" for i in range(len(made)))])
        codec.end()

    base = docs.select(F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)])
    kinds = ("long", "string", "string") if digest else ("long", "array<int>")
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in base.schema][1:] + [f"m{i} {k}" for i, k in enumerate(kinds)]
    out = base.mapInArrow(run, ", ".join(fields))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[F.col(f"m{i}").alias(c) for i, c in enumerate(new)])


def decode(tokens: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``tokens`` with the ids' bytes as text (invalid UTF-8 replaced) instead of the ids."""
    keep = [c for c in tokens.columns if c not in (ids_col, text_col)]
    shared = tokens.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            rows = [np.asarray(x if x is not None else [], np.int32) for x in batch.column("ids").to_pylist()]
            first = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)
            plain = codec.decode(np.concatenate([np.zeros(0, np.int32), *rows]), first)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([x.decode("utf-8", "replace") for x in plain], pa.string())], [*batch.schema.names[1:], "m0"])

    base = tokens.select(F.col(f"`{ids_col}`").alias("ids"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)])
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in base.schema][1:] + ["m0 string"]
    out = base.mapInArrow(run, ", ".join(fields))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("m0").alias(text_col))


def default_vocabulary() -> Vocabulary:
    return read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), default_vocabulary(), digest=True)
