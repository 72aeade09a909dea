"""The pipeline's stages against plain code, on documents with planted cases."""

import hashlib
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from millrace.llm import bpe

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, rk int, n_removed int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    path = str(tmp_path_factory.mktemp("tables"))
    prose = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 5000, n))
    item = prose(30)
    rows, labels = [], []
    for i in range(300):
        text = "\n".join(prose(25) for _ in range(4))
        if i % 6 == 1:
            w = text.split(" ")
            w[int(rng.integers(0, len(w)))] = f"scum{rng.integers(0, 9)}"
            text = " ".join(w)
        labels.append((i, 1, int(i % 6 == 1)))
        rows.append((i, text, "en" if i % 2 else "fr"))
    clean = [r for r in rows if r[0] % 6 != 1]
    near = clean[3][1].split(" ")
    near[5] = "changed"
    rows += [
        (1000, clean[0][1], "en"), (1001, " ".join(near).replace("\n", " "), "en"), (1002, prose(20) + "\n" + item + "\n" + prose(9), None),
        (1003, prose(12) + "\n" + "\n".join(clean[2][1].split("\n")[1:3]) + "\n" + prose(11), "de"), (1004, None, "en"), (1005, "", None), (1006, " \n ", "en"), (None, prose(40), "en"), (1007, "one word", "en"), (1008, prose(30_000), "en"),
    ]
    docs = [(a, b, c, f"s{k % 3}", None if b is None else len(b), "clash", 1, 2) for k, (a, b, c) in enumerate(rows)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def by_id(df):
    out = {}
    for r in df.collect():
        assert r["doc_id"] not in out
        out[r["doc_id"]] = r["text"]
    return out


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [by_id(docs)]
    for k, (name, stage) in enumerate(P.STAGES[:-1]):
        out = stage(spark, docs, folder)
        assert out.columns == list(P.COLUMNS), name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(by_id(docs))
    start, toxic, lines, near, clean = kept
    # toxicity: planted words go, clean documents stay
    bad = {i for i, t in start.items() if t and "scum" in t}
    assert len(bad & set(toxic)) <= 0.1 * len(bad)
    assert len(set(toxic) - bad) >= 0.97 * (len(start) - len(bad))
    # line dedup: windows of two non-blank lines that start earlier elsewhere
    first = {}
    parts = {i: (t or "").split("\n") for i, t in toxic.items()}
    full = {i: [k for k, x in enumerate(v) if x.strip()] for i, v in parts.items()}
    windows = lambda i: [(k, full[i][k : k + 2]) for k in range(max(1, len(full[i]) - 1) if full[i] else 0)]
    for i in sorted(x for x in toxic if x is not None):
        for k, w in windows(i):
            first.setdefault(tuple(parts[i][j] for j in w), (i, k))
    want = {}
    for i, t in toxic.items():
        gone = {j for k, w in windows(i) if i is not None and first[tuple(parts[i][j] for j in w)] < (i, k) for j in w}
        left = "\n".join(x for j, x in enumerate(parts[i]) if j not in gone)
        if not gone or left.strip():
            want[i] = left if gone else t
    assert lines == want and 1000 not in lines and len(lines[1003].split("\n")) == 2
    # near duplicates: the smallest id of each component
    sets = {}
    for i, t in lines.items():
        w = WORD.findall(t or "")
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    gone = {max(a, b) for a, b in combinations([i for i in lines if i is not None], 2) if (o := len(sets[a] & sets[b])) and 100 * o >= 80 * len(sets[a] | sets[b])}
    assert near == {i: t for i, t in lines.items() if i not in gone} and 1001 in gone
    # decontamination: the planted item
    assert clean == {i: t for i, t in near.items() if i != 1002} and 1002 in near
    # encoding
    tiktoken = pytest.importorskip("tiktoken")
    voc = bpe.default_vocabulary()
    enc = tiktoken.Encoding("t", pat_str=voc.pattern, mergeable_ranks=dict(zip(voc.tokens, voc.ids)), special_tokens={})
    final = {r["doc_id"]: r for r in P.STAGES[-1][1](spark, docs, folder).collect()}
    assert set(final) == set(clean)
    for i, t in clean.items():
        assert final[i]["ids_sha256"] == hashlib.sha256(np.array(enc.encode_ordinary(t or ""), "<u4").tobytes()).hexdigest()
        assert final[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_run_and_empty(spark, folder, tmp_path):
    rows = P.run(spark, folder)
    assert rows.count() > 200
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    unlabelled = P.drop_toxic(spark, docs.where(F.col("doc_id") < 20), str(tmp_path))
    assert unlabelled.count() == 20
