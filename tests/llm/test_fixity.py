import hashlib

from millrace.llm import fixity
from millrace.llm.queries import QUERIES


def sha(b):
    return hashlib.sha256(b).hexdigest()


def tables(spark, left, right):
    return [spark.createDataFrame([(i, bytearray(b)) for i, b in x], "id long, record binary") for x in (left, right)]


def test_audit_locates_all_damage(spark):
    left = [(i, b"record %d " % i * (i % 5 + 1)) for i in (*range(-70, 300), 5000, 2**40, -(2**62))]
    left += [(8, b"twice"), (9, b"copy"), (9, b"copy"), (None, b"no id"), (None, b"lost")]
    right = [(i, b[:-1] + b"?" if i in (-70, 77, 2**40) else b) for i, b in left if i not in (0, 299, -(2**62)) and b != b"lost"]
    right.remove((9, b"copy"))
    right += [(301, b"new"), (10**6, b"far")]
    got = {(r["page_id"], r["state"]): r for r in fixity.audit(*tables(spark, left, right)).collect()}
    want = {(i, "changed") for i in (-70, 77, 9, 2**40)} | {(i, "missing") for i in (0, 299, -(2**62), None)} | {(i, "extra") for i in (301, 10**6)}
    assert set(got) == want
    r = got[77, "changed"]
    before = sum(len(b) for i, b in left if i is not None and 0 <= i < 77)
    old = b"record 77 " * 3
    assert (r["file"], r["start"], r["end"], r["expected"], r["found"]) == (0, before, before + len(old), sha(old), sha(old[:-1] + b"?"))
    assert "2x" + sha(b"copy") in got[9, "changed"]["expected"] and "2x" not in got[9, "changed"]["found"]
    assert got[301, "extra"]["start"] is None and got[301, "extra"]["expected"] is None and got[301, "extra"]["found"] == sha(b"new")


def test_equal_replicas_in_any_order(spark):
    left = [(i, b"%d" % i) for i in range(200)] + [(None, b"x"), (3, b"again")]
    assert fixity.audit(*tables(spark, left, left[::-1])).count() == 0
    assert fixity.audit(*tables(spark, [], [])).count() == 0
    assert [r["state"] for r in fixity.audit(*tables(spark, [], left[:2])).collect()] == ["extra"] * 2


def test_records_keep_rows_apart(spark):
    rows = [(1, None, None), (1, "", None), (1, None, ""), (1, "", ""), (1, "u", "v"), (1, "uv", ""), (None, "u", "v")]
    got = [bytes(r["record"]) for r in fixity.records(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert len(set(got)) == len(rows)
    assert got[4] == b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 1\r\nWARC-Target-URI: u\r\nContent-Type: text/html; charset=utf-8\r\n\r\nv\r\n\r\n"


def test_query_finds_the_stated_damage(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>page {i} é</p>" * 5) for i in range(1200)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r["page_id"], r["state"]) for r in QUERIES["op2_merkle_audit"](spark, str(tmp_path)).collect()}
    assert got == {(i, "missing" if i % 103 == 7 else "changed") for i in range(1200) if 7 in (i % 97, i % 101, i % 103)}
