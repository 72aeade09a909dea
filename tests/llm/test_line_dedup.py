import corpus_pipeline
import pytest

from millrace.llm import line_dedup

LONG = " ".join(f"w{i}" for i in range(12))
ROWS = [(1, f"a\n{LONG}\nb"), (2, f"c\n{LONG}\nd"), (3, LONG), (4, f"short\n\t\n{LONG}"), (5, "short\ne"), (6, "short"), (7, f"{LONG}\n{LONG} \nf"), (None, LONG), (8, None)]


@pytest.mark.parametrize("alone", [None, 12, 13])
def test_long_lines_alone(spark, alone):
    out = line_dedup.remove_repeated_runs(spark.createDataFrame(ROWS, "doc_id long, text string"), alone=alone)
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in out.collect()}
    want = {i: (t, 0) for i, t in ROWS}
    if alone == 12:  # all but the first place, in documents of any number of lines
        want |= {2: ("c\nd", 1), 3: ("", 1), 4: ("short\n\t", 1), 7: (f"{LONG} \nf", 1)}
    assert got == want


def test_pipeline_drops_long_lines(spark):
    line = " ".join(f"w{i}" for i in range(corpus_pipeline.LONG_LINE))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in ((1, f"a\n{line}\nb"), (2, f"c\n{line}\nd"), (3, line), (4, "a\nc"))], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    assert got == {1: f"a\n{line}\nb", 2: "c\nd", 4: "a\nc"}
