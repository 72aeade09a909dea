import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import neighbours


def brute(ids, vecs, queries, k):
    out = {}
    for q in queries:
        i = ids.index(q)
        s = [(-(float(np.dot(vecs[i], v))), j) for j, v in zip(ids, vecs) if j != q]
        out[q] = [j for _, j in sorted(s)[:k]]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    n = 3000
    vecs = rng.standard_normal((n, 24)) * rng.uniform(0.3, 2, (n, 1))
    vecs[100:140] = vecs[7]
    rows = [(i, [float(np.float32(x)) for x in v], "x") for i, v in enumerate(vecs)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=20, block=700).collect()
    exact = brute([r[0] for r in rows], [np.array(r[1]) for r in rows], range(0, n, 20), 20)
    hit = 0
    for q, want in exact.items():
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert all(r["score"] == pytest.approx(float(np.dot(rows[q][1], rows[r["vec_id"]][1])), rel=1e-12) for r in mine)
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        hit += len({r["vec_id"] for r in mine} & set(want))
    assert hit / (20 * len(exact)) >= 0.9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (None, [1.0, 1.0]), (20, [1.0, 1.0]), (20, [1.0, 1.0]), (40, [1.0]), (60, []), (7, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 7, 1.0), (0, 2, 20, 1.0), (0, 3, 1, 0.0), (20, 1, 7, 2.0), (20, 2, 0, 1.0), (20, 3, 1, 1.0)]
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert neighbours.nearest(df.where("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("case", ["unit", "outlier", "uniform", "lognormal", "all lengths"])
def test_recall_on_unequal_norms(spark, case):
    rng = np.random.default_rng(4)
    n = 4000
    vecs = rng.standard_normal((n, 64))
    vecs /= np.linalg.norm(vecs, axis=1)[:, None]
    one, outlier = np.ones(n), np.where(np.arange(n) == 777, 10.0, 1.0)
    vecs *= {"unit": one, "outlier": outlier, "uniform": rng.uniform(0.3, 2, n), "lognormal": rng.lognormal(0, 0.3, n), "all lengths": 10 ** rng.uniform(-90, 90, n)}[case][:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 40 == 0, k=20).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = 0
    for q in range(0, n, 40):
        score = vecs @ vecs[q]
        score[q] = -np.inf
        hit += len(got[q] & set(np.argsort(-score)[:20].tolist()))
    assert hit / (20 * (n // 40)) >= 0.9


def test_rows_that_share_an_id(spark):
    rows = [(5, [1.0, 0.0]), (5, [9.0, 0.0]), (20, [1.0, 0.0]), (20, [2.0, 0.0]), (20, [2.0, 0.0]), (7, [1.0, 3.0])]
    df = spark.createDataFrame([(i, v, 1.0, 2, "x", 3) for i, v in rows], "vec_id long, embedding array<float>, score double, rank int, rows string, u int")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=3).collect())
    # each of the two rows of 20 asks; exact copies count once
    assert got == sorted([(20, 1, 5, 9.0), (20, 2, 20, 2.0), (20, 3, 5, 1.0), (20, 1, 5, 18.0), (20, 2, 5, 2.0), (20, 3, 7, 2.0)])


def test_many_rows_of_one_id(spark):
    rng = np.random.default_rng(8)
    vecs = rng.standard_normal((900, 8))
    df = spark.createDataFrame([(40 if i % 3 else i * 20, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=5, block=100).collect()
    assert len(got) == 900 * 5
