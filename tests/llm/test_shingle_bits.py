import numpy as np
import pyarrow as pa

from millrace.llm import jaccard_join


class Shared:
    value = np.full(jaccard_join.BLOOM_BITS // 8, 255, np.uint8)


def test_sets_are_sent_whole(monkeypatch):
    """Shingles that differ in their low 16 bits alone stay apart until overlaps are counted."""
    left = np.arange(10, dtype=np.uint64) + np.uint64(7 << 40)
    right = left + np.uint64(5)  # 5 of 15 are shared
    monkeypatch.setattr(jaccard_join, "shingle_sets", lambda piece, k: [left, right])
    batch = pa.RecordBatch.from_pydict({"id": pa.array([1, 2]), "text": pa.array(["a", "b"])})
    sent = next(jaccard_join._wanted(5, Shared)(iter([batch])))
    rows = {"g": [0, 0], "i": [0, 0], "j": [0, 0], "block": [0, 0], "id": [1, 2], "set": sent.column("set").to_pylist()}
    assert [len(x) for x in rows["set"]] == [80, 80]
    for num, links in ((33, 1), (34, 0), (80, 0)):
        out = list(jaccard_join._join_groups(num, 100)(iter([pa.RecordBatch.from_pydict(rows)])))
        assert sum(b.num_rows for b in out) == links
