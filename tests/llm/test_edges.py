"""Nulls, ties, repeats, clashing columns and plain re-computation, operator by operator."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import bpe, cluster, jaccard_join, line_dedup, sharding, toxicity
from millrace.llm.components import components
from millrace.llm.queries import QUERIES


def plain_runs(rows, run, alone):
    """Kept text and count of removed lines, by plain loops."""
    def windows(t):
        lines = (t or "").split("\n")
        at = [k for k, x in enumerate(lines) if x.strip(" \t\r\x0b\f")]
        out = [(k, at[k : k + run]) for k in range(max(1, len(at) - run + 1) if at else 0)]
        if alone and run > 1:
            out += [(k, [j]) for k, j in enumerate(at) if len(lines[j].split()) >= alone]
        return lines, out

    first = {}
    for i, t in rows:
        lines, found = windows(t)
        for k, at in found if i is not None else ():
            key = tuple(lines[j] for j in at)
            first[key] = min(first.get(key, (i, k)), (i, k))
    out = []
    for i, t in rows:
        lines, found = windows(t)
        gone = {j for k, at in found if i is not None and first[tuple(lines[j] for j in at)] < (i, k) for j in at}
        out.append((i, None if t is None else "\n".join(x for j, x in enumerate(lines) if j not in gone), len(gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("run", "alone"), [(1, None), (2, None), (3, None), (4, 2), (6, None)])
def test_line_runs_of_every_length(spark, run, alone):
    rng = np.random.default_rng(run)
    line = lambda: ["a", "b", "a b", "c c c", "", " ", "d", "é"][rng.integers(0, 8)]
    rows = [(int(rng.integers(-5, 30)), "\n".join(line() for _ in range(int(rng.integers(0, 14))))) for _ in range(60)]
    rows += [(50, "x\ny\nz\nx\ny\nz\nx\ny\nz"), (51, "y\nz\nx\ny"), (52, None), (None, "x\ny\nz"), (53, ""), (54, "q\n" * 300), (54, "q\n" * 300), (55, "z\nx\ny\nz\nx")]
    rows = list({(i, t): None for i, t in rows}) + [(54, "q\n" * 300)]
    df = spark.createDataFrame([(i, t, 1, "fp", 2) for i, t in rows], "doc_id long, text string, n_lines int, fp string, rk int")
    got = line_dedup.remove_repeated_runs(df, run, alone=alone)
    assert got.columns == ["doc_id", "text", "fp", "rk", "n_lines", "n_removed"]
    assert sorted(((r["doc_id"], r["text"], r["n_removed"]) for r in got.collect()), key=repr) == plain_runs(rows, run, alone)


def test_winnowing_selects_fewer_than_windows(spark):
    rng = np.random.default_rng(1)
    docs = spark.createDataFrame([(i, 0, "\n".join(f"line {x}" for x in rng.integers(0, 10**9, 200))) for i in range(20)], "id long, rk int, t string")
    for run, most in ((2, 0.75), (4, 0.5), (8, 0.3)):
        places = line_dedup.positions(docs, run, None)
        rows = places.collect()
        windows = [w["i"] for r in rows for w in r["windows"]]
        assert len(windows) == 20 * (200 - run + 1) and len(rows) < most * 20 * 200
        assert all(len(r["windows"]) <= run for r in rows)


def test_one_long_document(spark):
    text = "\n".join(f"line {i % 5000}" for i in range(30_000))
    df = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_lines"], r["n_removed"]) for r in line_dedup.remove_repeated_runs(df).collect()) == [(1, 30_000, 25_000 - 0), (2, 30_000, 30_000)]


def test_copies_spread_over_partitions(spark):
    df = spark.range(0, 20_000, 1, 4).select(F.lit(1).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit("x").alias("shard"), F.lit(0).alias("u"))
    rows = sharding._numbered(df.select(F.col("doc_id").alias("c0")))
    share = rows.groupBy(F.pmod(F.xxhash64(F.lit(7), F.lit(1), *rows.columns), F.lit(40)).alias("p")).count().collect()
    assert len(share) == 40 and max(r["count"] for r in share) < 2 * 20_000 / 40
    assert [r["n"] for r in rows.select(F.countDistinct("u").alias("n")).collect()] == [20_000]
    out = sharding.shuffle_into_shards(df, 40, rows_each=1000)
    got = out.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    assert len(got) == 40 and all((r["n"], r["d"], r["m"]) == (500, 500, 499) for r in got) and out.columns == ["doc_id", "text", "u", "shard", "slot"]


def test_sharding_is_uniform(spark):
    """Each row falls into each shard about equally often over many seeds."""
    df = spark.createDataFrame([(i,) for i in range(30)] + [(3,), (3,)], "doc_id long")
    count = np.zeros((30, 4))
    for seed in range(24):
        for r in sharding.shuffle_into_shards(df, 4, seed, rows_each=7).collect():
            count[r["doc_id"], r["shard"]] += 1
    single = np.delete(count, 3, 0)
    assert (count.sum(1)[[0, 3]] == [24, 72]).all() and ((single - 6) ** 2 / 6).sum() < 29 * 3 * 1.6


def test_sharding_query(spark, tmp_path):
    rows = [(i if i % 9 else None, None if i % 11 == 0 else "é" * (i % 50)) for i in range(500)] + [(1, "é")] * 100
    spark.createDataFrame([(i, t, "shard", 5) for i, t in rows], "doc_id long, text string, lang string, slot int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op7_sharding"](spark, str(tmp_path)).collect()
    want = sorted(((i, 16 + len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t in rows), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr) == want
    for k in range(40):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(15))
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}


def test_components_against_union_find(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 150, (120, 2))] + [(200 + i, 201 + i) for i in range(40)] + [(7, 7), (None, 3), (300, 301), (301, 300), (300, 301)] + [(-1, 400 + i) for i in range(50)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_jaccard_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(5, text, 1, "x", 2), (3, text, 1, "y", 3), (None, text, 0, "z", 0)], "doc_id long, text string, n_shingles int, component_id string, rep int")
    assert sorted(tuple(r) for r in jaccard_join.jaccard_components(df.where("doc_id is not null")).collect()) == [(3, 26, 3), (5, 26, 3)]
    assert jaccard_join.jaccard_components(df).count() == 3


def test_overlaps_in_blocks_against_all_pairs():
    rng = np.random.default_rng(4)
    for _ in range(60):
        base = rng.choice(60, 30, False)
        sets = []
        for _ in range(int(rng.integers(1, 30))):
            s = set(base.tolist()) if rng.random() < 0.7 else set()
            s ^= set(rng.integers(0, 80, int(rng.integers(1, 8))).tolist())
            sets.append(np.array(sorted(s or {1}), np.uint64))
        sides = rng.integers(0, 2, len(sets)) if rng.random() < 0.5 else None
        links = jaccard_join._overlap_links(sets, np.array([len(s) for s in sets]), 80, 100, sides)
        pairs = {(i, j) for i in range(len(sets)) for j in range(i) if (sides is None or sides[i] != sides[j]) and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}

        def groups(es):
            root = list(range(len(sets)))
            for _ in sets:
                for a, b in es:
                    root[a] = root[b] = min(root[a], root[b])
            return root

        assert groups(links) == groups(pairs) and all((max(p), min(p)) in pairs for p in links)


def test_bpe_clashing_columns(spark):
    voc = bpe.default_vocabulary()
    df = spark.createDataFrame([(1, "some text", 5, "x", "k"), (2, None, 6, "y", "l")], "doc_id long, text string, n_tokens int, ids string, k0 string")
    out = bpe.encode(df, voc)
    assert out.columns == ["doc_id", "k0", "n_tokens", "ids"]
    back = bpe.decode(out.withColumn("text", F.lit("old")), voc)
    assert sorted((r["doc_id"], r["text"], r["k0"]) for r in back.collect()) == [(1, "some text", "k"), (2, "", "l")]


def test_toxicity_scores_by_plain_loops_and_clashes(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"v{x}" for x in rng.integers(0, 50, 20)) + (" scum" if i % 3 == 0 else "") for i in range(150)]
    ids = [toxicity.word_ids(pa.array([t]))[0] for t in texts]
    model = toxicity.train(ids, np.array([i % 3 == 0 for i in range(150)], float))
    for t in [*texts[:12], "", "one", "Scum, SCUM! " * 700]:
        words = toxicity.word_ids(pa.array([t]))[0]
        x = np.array([sum(model.emb[w] for w in row) for row in words], np.float32).reshape(-1, toxicity.DIM)
        feats = []
        for f in model.filters:
            for k in range(toxicity.FILTERS):
                best = [sum(float(x[p + o] @ f[o][:, k]) for o in range(len(f)) if p + o < len(x)) for p in range(len(x))]
                feats.append(np.tanh(max(best)) if best else 0.0)
        want = 1 / (1 + np.exp(-(np.array(feats) @ model.out + model.bias)))
        assert model.scores(pa.array([t]))[0] == pytest.approx(want, abs=1e-5)
    df = spark.createDataFrame([(1, "scum v1", "en", 9, "x", "k"), (2, None, None, 8, "y", "l"), (2, None, None, 8, "y", "l")], "doc_id long, text string, lang string, score int, reject string, k0 string")
    model.thresholds = {"en": 0.4}
    out = toxicity.rejected(df, model)
    assert {f.name: f.dataType.simpleString() for f in out.schema}["score"] == "double" and out.count() == 3
    assert out.columns.count("reject") == 1 and toxicity.rejected(df.drop("lang"), model).count() == 3


def test_intermediate_tables_go(spark, tmp_path):
    before = list(cluster._MADE)
    df = cluster.cut(spark.range(5), "x")
    assert df.count() == 5 and len(cluster._MADE) == len(before) + 1
    cluster.drop(df)
    assert cluster._MADE == before
    cluster.drop(df)


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Conf:
        @staticmethod
        def get(key, default):
            return default

    class Session:
        sparkContext, conf = Context, Conf

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        cluster.shared_dir(Session)


def test_session_settings_stay(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    bpe.encode(spark.createDataFrame([(1, "x")], "doc_id long, text string"), bpe.default_vocabulary()).collect()
    assert spark.conf.get(key) == before


def test_pipeline_stages_with_repeated_ids(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "en", "s", 5), (1, text, "en", "s", 5), (1, "other words", None, None, None), (None, text, "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    near = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert near.count() == 4
    spark.createDataFrame([(1, text)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [r["doc_id"] for r in corpus_pipeline.drop_leaks(spark, docs, str(tmp_path)).collect()] == [None]
    out = corpus_pipeline.encode(spark, docs, "").collect()
    assert len(out) == 4 and {r["decoded_sha256"] for r in out} == {hashlib.sha256(t.encode()).hexdigest() for t in (text, "other words")}
