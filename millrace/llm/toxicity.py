"""Toxicity scores by a small convolutional text classifier, trained in numpy.

A word is the sum of hashed embeddings of itself and of its first four and five bytes, so
inflected and unseen forms share weight. Filters of widths 1, 2 and 3 slide over the words
of the whole text, the maximum of each filter over all positions is kept, and a logistic
layer gives the score. Embeddings start from lower confidence bounds of log odds (their
first component) and noise, and all weights are trained by stochastic gradients.

The classifier is fitted on the driver from a bounded sample of labelled documents: at most
``sample`` rows (``SAMPLE``), the ones of least hash of doc_id, whole texts, read in blocks.
A fifth of them is kept back from training and calibrates the thresholds.
Scores use the text alone. Language serves only to calibrate thresholds for filtering.
Scoring is one pass without a shuffle; the model (about 1 MB) is broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import cut, table
from .words import Words, _codes, chunks, mix, rolling

SAMPLE = 3000
#: One of so many sampled rows is kept back from training, for the thresholds.
KEEP_BACK = 5
BUCKETS = 1 << 15
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def word_ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket numbers, three a word; first word of each text and the end)."""
    words = Words(texts, lower=True, space=_BREAK)
    codes = _codes(3)[words.data]
    out = np.empty((len(words.starts), 3), np.int32)
    for j, size in enumerate((1 << 30, 4, 5)):
        h = rolling(codes, words.starts, np.minimum(words.ends, words.starts + size), 4)
        out[:, j] = (mix(h ^ np.uint64(j)) >> np.uint64(7)).astype(np.int64) % BUCKETS
    return out, words.first


@dataclass
class Model:
    emb: np.ndarray
    filters: list[np.ndarray]  # for each width: (width, DIM, FILTERS)
    out: np.ndarray
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)

    def vectors(self, ids: np.ndarray) -> np.ndarray:
        x = self.emb[ids[:, 0]]
        x += self.emb[ids[:, 1]]
        x += self.emb[ids[:, 2]]
        return x

    def maps(self, x: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """Filter values at every position; words beyond the text's end count as zero."""
        left = np.repeat(first[1:], np.diff(first)) - np.arange(len(x))
        out = []
        for f in self.filters:
            y = x @ f[0]
            for o in range(1, len(f)):
                z = x[o:] @ f[o]
                z[left[:-o] <= o] = 0
                y[: len(z)] += z
            out.append(y)
        return out

    def pooled(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        n = len(first) - 1
        out = np.zeros((n, len(self.filters) * FILTERS), np.float32)
        full = np.flatnonzero(np.diff(first))
        if len(full):
            maps = self.maps(self.vectors(ids), first)
            out[full] = np.concatenate([np.maximum.reduceat(y, first[full]) for y in maps], 1)
        return np.tanh(out)

    def scores(self, texts: pa.Array) -> np.ndarray:
        ids, first = word_ids(texts)
        return _sigmoid(self.pooled(ids, first).astype(np.float64) @ self.out + self.bias)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _log_odds(docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Lower confidence bounds of each bucket's log odds of label 1, 0 where below 0."""
    count = np.zeros((2, BUCKETS))
    for ids, label in zip(docs, y, strict=True):
        count[int(label), np.unique(ids)] += 1
    n = np.array([max(1, (y == 0).sum()), max(1, (y == 1).sum())])
    a, b = count[1] + 0.5, count[0] + 0.5
    odds = np.log(a / (n[1] + 1)) - np.log(b / (n[0] + 1)) - 3 * np.sqrt(1 / a + 1 / b)
    return np.maximum(odds, 0)


def train(docs: list[np.ndarray], labels: np.ndarray, epochs: int = 9, seed: int = 5, rate: float = 0.02) -> Model:
    """Fit on word ids of whole texts. With one class only, or no rows, the scores are the
    smoothed share of label 1."""
    y = np.asarray(labels, np.float64)
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32)
    filters = [rng.normal(0, 0.15, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    share = (y.sum() + 0.5) / (len(y) + 2)
    model = Model(emb, filters, np.zeros(len(WIDTHS) * FILTERS), float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    emb[:, 0] += 0.5 * _log_odds(docs, y)
    for f in filters:
        f[:, 0, : FILTERS // 2] += 0.4
    model.out += rng.normal(0.3, 0.1, len(model.out))
    square = {"emb": np.full(BUCKETS, 1e-4), "out": np.full(len(model.out), 1e-4), "bias": 1e-4, "f": [np.full(f.shape, 1e-4) for f in filters]}
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        step = rate * (1 - epoch / epochs)
        for at in range(0, len(order), 32):
            take = [i for i in order[at : at + 32] if len(docs[i])]
            if not take:
                continue
            ids = np.concatenate([docs[i] for i in take])
            first = np.concatenate([[0], np.cumsum([len(docs[i]) for i in take])])
            x = model.vectors(ids)
            maps = model.maps(x, first)
            best = [np.stack([y_[a:b].argmax(0) + a for a, b in zip(first[:-1], first[1:], strict=True)]) for y_ in maps]
            feats = np.tanh(np.concatenate([np.take_along_axis(m, p, 0) for m, p in zip(maps, best, strict=True)], 1)).astype(np.float64)
            error = (_sigmoid(feats @ model.out + model.bias) - y[take]) / len(take)
            back = (error[:, None] * model.out) * (1 - feats**2)
            grad_out, grad_bias = feats.T @ error + 1e-4 * model.out, error.sum()
            rows, grads = [], []
            for j, (f, p) in enumerate(zip(model.filters, best, strict=True)):
                g = back[:, j * FILTERS : (j + 1) * FILTERS].astype(np.float32)
                gf = np.zeros_like(f)
                for o in range(len(f)):
                    at_ = np.minimum(p + o, len(x) - 1)
                    live = (p + o < first[1:, None]).astype(np.float32) * g
                    gf[o] = np.einsum("dfk,df->kf", x[at_], live)
                    rows.append(at_.ravel())
                    grads.append((live[:, :, None] * f[o].T[None]).reshape(-1, DIM))
                square["f"][j] += gf**2
                f -= step * (gf + 1e-5 * f) / np.sqrt(square["f"][j])
            rows, grads = np.concatenate(rows), np.concatenate(grads)
            cells = ids[rows]
            for c in range(3):
                np.add.at(square["emb"], cells[:, c], (grads**2).mean(1))
                np.add.at(emb, cells[:, c], (-step * grads / np.sqrt(square["emb"][cells[:, c]])[:, None]).astype(np.float32))
            square["out"] += grad_out**2
            square["bias"] += grad_bias**2
            model.out -= 2 * step * grad_out / np.sqrt(square["out"])
            model.bias -= 2 * step * grad_bias / np.sqrt(square["bias"])
    return model


def calibrate(scores: np.ndarray, labels: np.ndarray, langs: list, least: int = 10) -> dict[str, float]:
    """For each language, the cut with the fewest errors, in the middle of the gap it falls in;
    0.5 where a language has fewer than ``least`` rows of a class."""
    out = {}
    names = np.array([x or "" for x in langs], object)
    for name in sorted(set(names)):
        s, y = scores[names == name], labels[names == name]
        if min((y == 0).sum(), (y == 1).sum()) < least:
            continue
        order = np.argsort(-s, kind="stable")
        s, y = s[order], y[order]
        cut_ok = np.append(s[:-1] > s[1:], True)
        errors = np.where(cut_ok, np.cumsum(y == 0) + (y == 1).sum() - np.cumsum(y == 1), len(y) + 1)
        k = int(errors.argmin())
        out[name] = float(np.clip((s[k] + (s[k + 1] if k + 1 < len(s) else 0)) / 2, 0.05, 0.95))
    return out


def held_out(doc_id: F.Column) -> F.Column:
    """crc32 of the id's text modulo 5 is 0; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str | None = "lang") -> Model:
    """A model from at most ``sample`` labelled rows outside the held-out fifth. Rows with a
    null id or label are not used; a doc_id labelled several times counts once, as its
    greatest label."""
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    marks = marks.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    lang = F.col(f"`{lang_col}`") if lang_col and lang_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), lang.alias("lang"))
    # the sample's ids first, from the labels alone; then the texts of those ids
    chosen = marks.join(docs.select(F.col(f"`{id_col}`").alias("id")), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(sample)
    small = cut(chosen, "sample")
    found = rows.join(F.broadcast(small), "id").select("id", "y", "lang", "text")
    ids, y, langs = [], [], []
    for row in cut(found.repartition(8, "id").sortWithinPartitions("id"), "train").toLocalIterator():
        got, _ = word_ids(pa.array([row["text"]], pa.string()))
        ids.append((row["id"], row["y"], row["lang"], got))
    ids.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0], len(r[3])))
    docs_, y, langs = [r[3] for r in ids], np.array([r[1] for r in ids], np.float64), [r[2] for r in ids]
    # thresholds come from scores of rows that the model which gave them has not seen
    back = np.arange(len(docs_)) % KEEP_BACK == 0
    if len(docs_):
        seen = train([d for d, b in zip(docs_, back, strict=True) if not b], y[~back])
        scores = np.array([_sigmoid(seen.pooled(d, np.array([0, len(d)])).astype(np.float64) @ seen.out + seen.bias)[0] for d, b in zip(docs_, back, strict=True) if b])
        seen.thresholds = calibrate(scores, y[back], [x for x, b in zip(langs, back, strict=True) if b])
        return seen
    return train(docs_, y)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the ``keep`` columns, and ``score``, one row for each row of ``docs``. Null and
    empty texts get the score of no words; null ids stay; repeated rows give repeated
    results."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    extra = [c for c in keep if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            got = shared.value.scores(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got)], [*batch.schema.names, "new_score"])

    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(extra)])
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema)
    out = base.mapInArrow(run, f"{fields}, new_score double")
    return out.select(F.col("id").alias(id_col), *[F.col(f"k{i}").alias(c) for i, c in enumerate(extra)], *([F.col("text").alias(text_col)] if text_col in keep else []), F.col("new_score").alias("score"))


def rejected(docs: DataFrame, model: Model, lang_col: str = "lang") -> DataFrame:
    """``docs`` with ``score`` and ``reject`` (columns of these names are replaced): the score
    reaches its language's threshold (0.5 for languages without one, and without ``lang_col``)."""
    out = score(docs, model, keep=tuple(c for c in docs.columns if c not in ("doc_id", "score", "reject")))
    cuts = F.lit(0.5)
    for name, value in model.thresholds.items() if lang_col in docs.columns else ():
        cuts = F.when(F.coalesce(F.col(lang_col), F.lit("")) == name, value).otherwise(cuts)
    return out.withColumn("reject", F.col("score") >= cuts)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
