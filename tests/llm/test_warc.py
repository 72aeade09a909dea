import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import fixity, warc


def record(i, body, extra=b""):
    return b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: %d%s\r\n\r\n%s\r\n\r\n" % (i, len(body), extra, body)


def frame(spark, files):
    return spark.createDataFrame([(n, None if d is None else bytearray(d)) for n, d in files], "file string, data binary")


@pytest.mark.parametrize("compress", [False, True])
def test_round_trip(spark, tmp_path, compress):
    rows = [(i, f"http://h/{i}", f"<p>page {i} é</p>" * (i % 7)) for i in range(130)] + [(130, None, None), (131, "u", ""), (None, "n", "no id")]
    records = fixity.records(spark.createDataFrame(rows, "page_id long, url string, html string"))
    packed = warc.pack(records, 6, compress)
    assert {r["file"] for r in packed.select("file").collect() if r["file"].startswith("part")} == {"part-0", "part-1", "part-2"}
    for r in packed.collect():
        (tmp_path / r["file"]).write_bytes(r["data"])
    got = warc.parse(warc.read_archives(spark, str(tmp_path))).collect()
    want = {bytes(r["record"]) for r in records.collect()}
    assert {bytes(r["record"]) for r in got} == want and len(got) == len(rows)
    assert {r["state"] for r in got} == {"ok", "marked"}
    for r in got:
        data = (tmp_path / r["file"]).read_bytes()[r["start"] : r["end"]]
        assert (gzip.decompress(data) if compress else data) == bytes(r["record"])
    page = next(r for r in got if r["headers"].get("warc-record-id") == "<urn:page:8>")
    assert page["headers"]["warc-target-uri"] == "http://h/8" and bytes(page["body"]) == "<p>page 8 é</p>".encode()


def test_damaged_files(spark):
    a, b, c = record(1, b"one"), record(2, b"two" * 50), record(3, b"")
    z = [gzip.compress(x) for x in (a, b, c)]
    files = [("empty", b""), ("null", None), ("cut", a + b[:-20]), ("cut header", a + b"WARC/1.1\r\nConte"), ("cut word", a + b"WAR"), ("noise", a + b"??" + b), ("bad length", a + record(9, b"x").replace(b"Content-Length: 1", b"Content-Length: x") + b), ("wrong length", record(5, b"abc").replace(b": 3", b": 2") + a)]
    files += [("gz", b"".join(z)), ("gz cut", z[0] + z[1][:-9]), ("gz noise", z[0] + b"\x1f\x8bnonsense"), ("one gz", gzip.compress(a + b))]
    got = {}
    for r in warc.parse(frame(spark, files)).orderBy("file", "number").collect():
        got.setdefault(r["file"], []).append(r["state"])
    assert got == {
        "cut": ["ok", "truncated"], "cut header": ["ok", "truncated"], "cut word": ["ok", "truncated"], "noise": ["ok", "malformed"], "bad length": ["ok", "malformed"], "wrong length": ["malformed"],
        "gz": ["ok"] * 3, "gz cut": ["ok", "truncated"], "gz noise": ["ok", "damaged"], "one gz": ["ok", "ok"],
    }
    assert warc.parse(frame(spark, files[:2])).count() == 0
    assert {tuple(r)[:2] for r in warc.sizes(warc.parse(frame(spark, files))).where("file = 'gz'").collect()} == {("gz", 3)}


def brute(one, two):
    """States by id of two lists of (id, bytes)."""
    a, b = {}, {}
    for side, rows in ((a, one), (b, two)):
        for i, x in rows:
            side.setdefault(i, []).append(hashlib.sha256(x).hexdigest())
    return {(i, "extra" if i not in a else "missing" if i not in b else "changed") for i in a.keys() | b.keys() if sorted(a.get(i, [])) != sorted(b.get(i, []))}


def test_audit_of_several_replicas(spark):
    rows = [(i, record(i, b"page %d " % i * (i % 9 + 1))) for i in range(300)]
    pack = lambda rs: frame(spark, [(f"part-{k}", b"".join(x for i, x in rs if i >> 6 == k)) for k in range(6)])
    flipped = [(i, x[:-6] + b"?" + x[-5:] if i in (5, 200) else x) for i, x in rows]
    lost = [(i, x) for i, x in rows if i not in (0, 64, 299)] + [(301, record(301, b"new"))]
    swapped = list(rows)
    swapped[10], swapped[20] = swapped[20], swapped[10]
    replicas = {"same": rows, "flipped": flipped, "lost": lost, "swapped": swapped}
    got = {}
    for r in warc.audit_archives(pack(rows), {n: pack(x) for n, x in replicas.items()}).collect():
        got.setdefault(r["replica"], set()).add((r["page_id"], r["state"]))
    want = {n: brute(rows, x) for n, x in replicas.items()}
    assert got == {"flipped": want["flipped"], "lost": want["lost"], "swapped": {(10, "reordered"), (20, "reordered")}} and not want["same"] and len(want["lost"]) == 4
    cut_off = warc.audit_archives(pack(rows), {"cut": pack(rows).withColumn("data", F.expr("substring(data, 1, octet_length(data) - 6)"))}).collect()
    assert {r["state"] for r in cut_off} == {"changed"} and {r["page_id"] for r in cut_off} == {63, 127, 191, 255, 299}
    nothing = frame(spark, [])
    assert warc.audit_archives(nothing, {"r": nothing}).count() == 0
    assert {r["state"] for r in warc.audit_archives(nothing, {"r": pack(rows)}).collect()} == {"extra"}
    with pytest.raises(ValueError):
        warc.audit_archives(nothing, {})
