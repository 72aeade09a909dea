import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import substring_dedup as S


@pytest.mark.parametrize("partitions", [3, 1 << 14])
def test_one_id_and_one_text_in_many_rows(spark, monkeypatch, partitions):
    """Rows that share an id, rows without one, and copies, over few and many partitions."""
    monkeypatch.setattr(S, "PARTITIONS", partitions)
    monkeypatch.setattr(S, "CHUNK_WINDOWS", 50)
    monkeypatch.setattr(S, "parts_for", lambda df, size: 11)
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 30, n))
    same = text(12)
    rows = [(7, text(int(rng.integers(0, 20)))) for _ in range(40)] + [(None, same) for _ in range(30)] + [(9, same) for _ in range(30)] + [(i, text(15)) for i in range(30)] + [(8, same + " " + text(3)), (6, None), (None, None), (5, "")]
    first = {}
    for i, t in rows:
        w = (t or "").split()
        for k in range(len(w) - 3):
            if i is not None:
                first[tuple(w[k : k + 4])] = min(i, first.get(tuple(w[k : k + 4]), i))
    want = []
    for i, t in rows:
        w, gone = (t or "").split(), set()
        for k in range(len(w) - 3):
            if i is not None and first[tuple(w[k : k + 4])] < i:
                gone |= set(range(k, k + 4))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    df = spark.createDataFrame([(i, t, 1, "x", b"y") for i, t in rows], "doc_id long, text string, n_removed int, g string, blob binary").repartition(5)
    got = [tuple(r) for r in S.remove_repeated_windows(df, 4).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(r[2] for r in want) > 100
    assert S.remove_repeated_windows(df.where(F.col("doc_id").isNull()), 4).count() == 31
