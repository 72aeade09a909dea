"""Secret scan with structural confirmation.

Base spans come from three patterns (assigned values, access keys, long hex runs). The
method then looks for encoded material: base64 or hex candidates are decoded and parsed.
A span is reported only if its structure holds: a DER key whose nested lengths add up and
whose parts are those of a key format (PKCS#1, PKCS#8 plain or encrypted, SEC1, DSA, or a
subject public key; certificates, signatures and other sequences are none), an
SSH public or private key whose length-prefixed fields fill it, or a signed token whose
header decodes to a JSON object that names an algorithm. Candidates begin wherever the
first digits fit the structure's first byte, in any length form or spacing. One pass, no shuffle.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import table
from .words import chunks

ASSIGN = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: How base64 of a JSON object begins, white space before its brace and after it included.
OBJECT = r"(?:e[w-z0-9_-]|I[A-P]|C[Q-Za-v]|D[Q-Za-f])[A-Za-z0-9_-]+"
#: Every run with two more after it; the header may begin inside the first one.
JWT = rf"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]+)(?=\.({OBJECT})\.([A-Za-z0-9_-]*))"
#: What may stand between the lines of a wrapped key: a line end, plain or escaped, and indents.
BREAK = r"[ \t]*(?:\r?\n|(?:\\+r)?\\+n)[ \t]*"
#: How a key begins: the two digits of a DER sequence's tag (the length may take any form),
#: AAAA (an SSH length) or an OpenSSH private key's magic.
START = rf"M(?:{BREAK})?[A-P]|A(?:{BREAK})?A(?:{BREAK})?A(?:{BREAK})?A(?!AA)|b(?:{BREAK})?3(?:{BREAK})?B(?:{BREAK})?l(?:{BREAK})?b"
HEXSTART = rf"3(?:{BREAK})?0"
#: Base64 digits, and hex digits, that a key has at least.
LEAST = 23
HEXLEAST = 42
KINDS = ("assign", "access", "hex", "jwt", "key")

_ASSIGN = re.compile(ASSIGN, re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(ACCESS)
#: Runs shorter than 32 are dropped anyhow, and a run's leftmost match is the whole run.
_HEX = re.compile(r"[0-9a-f]{32,}")
_JWT = re.compile(JWT)
_START = re.compile(START)
_BREAK = re.compile(BREAK)
_RUN = re.compile(r"[A-Za-z0-9+/]+")
#: Padding by the number of digits over four: a line break may precede it where it belongs.
_PAD = [re.compile(x) for x in (r"={0,2}", r"={0,2}", rf"(?:(?:{BREAK})?=){{1,2}}(?!=)|={{0,2}}", rf"(?:{BREAK})?=(?!=)|={{0,2}}")]
_OBJECT = re.compile(OBJECT)
_HEXSTART = re.compile(HEXSTART)
_HEXRUN = re.compile(r"[0-9A-Fa-f]+")
#: Literals without which no pattern of a group can match; RE2 tests them over whole columns.
_GATES = {
    "assign": (r"(?:password|passwd|secret|token|api_?key)[\"']? *[:=]", True),
    "access": (r"AKIA[A-Z0-9]", False),
    "hex": (r"[0-9a-f]{32}", False),
    "jwt": (rf"{OBJECT}\.{OBJECT}\.", False),
    "key": (rf"(?:{START.replace('(?!AA)', '')})(?:(?:{BREAK})?[A-Za-z0-9+/]){{{LEAST - 4}}}|{HEXSTART}(?:(?:{BREAK})?[0-9A-Fa-f]){{{HEXLEAST - 2}}}", False),
}


def der_ok(data: bytes, depth: int = 0) -> bool:
    """Whether ``data`` is one DER element whose nested lengths fill it exactly."""
    try:
        tag, at, end = _der(data, 0)
    except (IndexError, ValueError):
        return False
    if end != len(data) or tag != 0x30 or depth > 16:
        return False
    parts = 0
    while at < end:
        try:
            tag, inner, stop = _der(data, at)
        except (IndexError, ValueError):
            return False
        if stop > end or (tag == 0x30 and not der_ok(data[at:stop], depth + 1)):
            return False
        parts, at = parts + 1, stop
    return parts > 0 or depth > 0


def der_parts(data: bytes) -> list[tuple[int, bytes]]:
    """(tag, content) of what the sequence ``data`` holds; ``data`` passes ``der_ok``."""
    _, at, end = _der(data, 0)
    out = []
    while at < end:
        tag, inner, stop = _der(data, at)
        out.append((tag, data[inner:stop]))
        at = stop
    return out


def _algorithm(part: tuple[int, bytes]) -> bytes | None:
    """The object identifier that an algorithm sequence begins with."""
    tag, body = part
    if tag != 0x30 or len(body) < 3 or body[0] != 6 or 2 + body[1] > len(body):
        return None
    return body[2 : 2 + body[1]]


#: The object identifiers 1.2.840.113549.1.1.1 (RSA) and 1.2.840.10045.2.1 (EC).
RSA_OID = bytes.fromhex("2a864886f70d010101")
EC_OID = bytes.fromhex("2a8648ce3d0201")


def der_key(data: bytes) -> bool:
    """Whether ``data`` is a DER element of a key format, by version, algorithm and parts."""
    if not der_ok(data):
        return False
    parts = der_parts(data)
    tags, body = [t for t, _ in parts], [b for _, b in parts]
    small = body[0] in (b"\0", b"\1")
    if set(tags) == {2}:
        # RSA private, DSA private, or an RSA modulus and exponent: two shorter numbers are a signature
        return len(tags) >= 9 and small or len(tags) == 6 and body[0] == b"\0" or len(tags) == 2 and len(body[0]) >= 64 and (len(body[1]) <= 8 or len(body[0]) >= 96)
    if tags[:3] == [2, 0x30, 4]:
        oid = _algorithm(parts[1])
        if oid == RSA_OID and not (der_key(body[2]) and der_parts(body[2])[0][0] == 2):
            return False
        if oid == EC_OID and not der_key(body[2]):
            return False
        return small and oid is not None and all(t in (0xA0, 0xA1, 0x81) for t in tags[3:])
    if tags in ([0x30, 4], [0x30, 3]):
        return _algorithm(parts[0]) is not None and (tags[1] == 4 or body[1][:1] == b"\0")
    return tags[:2] == [2, 4] and body[0] == b"\1" and all(t in (0xA0, 0xA1) for t in tags[2:])


def _der(data: bytes, at: int) -> tuple[int, int, int]:
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4:
            raise ValueError("length form")
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
    if at + size > len(data):
        raise ValueError("length")
    return tag, at, at + size


def ssh_type(name: bytes) -> bool:
    return re.fullmatch(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]+", name) is not None


def ssh_ok(data: bytes) -> bool:
    """An SSH public key blob (length-prefixed fields, the first names the type) or the
    magic of an OpenSSH private key followed by such fields."""
    magic = b"openssh-key-v1\0"
    at, fields = (len(magic), 0) if data.startswith(magic) else (0, 0)
    private = at > 0
    while at + 4 <= len(data) and not (private and fields >= 3):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return False
        if not private and not fields and not ssh_type(data[at + 4 : at + 4 + size]):
            return False
        at, fields = at + 4 + size, fields + 1
    return fields >= 3 if private else fields >= 2 and at == len(data)


def _decode(text: str, url: bool = False) -> bytes | None:
    raw = re.sub(r"\s|=", "", text)
    try:
        return base64.b64decode(raw + "=" * (-len(raw) % 4), b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def _json(part: str) -> object:
    raw = _decode(part, True)
    try:
        return json.loads(raw) if raw is not None else None
    except (ValueError, RecursionError):
        return None


def jwt_ok(text: str) -> bool:
    head, body = map(_json, text.split(".", 2)[:2])
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


class Block:
    """Runs of ``digits`` joined over line breaks, read as one string from any digit on."""

    def __init__(self, text: str, at: int, digits: re.Pattern[str]):
        self.starts, self.ends, self.before, parts = [], [], [0], []
        while run := digits.match(text, at):
            self.starts.append(run.start())
            self.ends.append(run.end())
            parts.append(run[0])
            self.before.append(self.before[-1] + len(run[0]))
            gap = _BREAK.match(text, run.end())
            at = gap.end() if gap else run.end()
        self.digits, self.end = "".join(parts), self.ends[-1]

    def offset(self, at: int) -> int:
        """Digits before the one at ``at`` in the text."""
        k = bisect.bisect_right(self.starts, at) - 1
        return self.before[k] + at - self.starts[k]

    def place(self, count: int) -> int | None:
        """Where in the text the first ``count`` digits end, if a run ends there."""
        k = bisect.bisect_left(self.before, count)
        return self.ends[k - 1] if 0 < k < len(self.before) and self.before[k] == count else None


def der_size(head: bytes) -> int | None:
    """Bytes of the DER sequence that begins so, by its length field."""
    if len(head) < 2 or head[0] != 0x30:
        return None
    n = head[1] & 0x7F if head[1] & 0x80 else 0
    if n > 4 or head[1] == 0x80 or len(head) < 2 + n:
        return None
    return 2 + n + (int.from_bytes(head[2 : 2 + n], "big") if n else head[1])


def ssh_sizes(data: bytes) -> list[int]:
    """Sizes at which an SSH blob that begins so can end, the longest first."""
    magic = b"openssh-key-v1\0"
    out: list[int] = []
    if data.startswith(magic):
        at, left = len(magic), 3  # cipher, derivation and its options; then the public keys and one private part
        while left and at + 4 <= len(data):
            at, left = at + 4 + int.from_bytes(data[at : at + 4], "big"), left - 1
            if left == 0 and not out and at + 4 <= len(data):
                left, at = int.from_bytes(data[at : at + 4], "big") + 1, at + 4
                out.append(0)
        # a cipher may add a tag of 16 bytes; other forms are taken whole, as far as they go
        return ([at + 16, at] if not left and out and at <= len(data) else []) + [len(data)]
    at, fields = 0, 0
    while at + 4 <= len(data):
        at, fields = at + 4 + int.from_bytes(data[at : at + 4], "big"), fields + 1
        if at > len(data) or fields == 1 and not ssh_type(data[4:at]):
            break
        if fields >= 2:
            out.append(at)
    return out[::-1]


def keys(text: str) -> list[tuple[int, int]]:
    """(start, end) of base64 keys: the longest prefix of a candidate that parses and ends
    where a run of digits ends, whatever lines follow."""
    out: list[tuple[int, int]] = []
    block, past, pos = None, 0, 0
    while m := _START.search(text, pos):
        at = m.start()
        pos = at + 1
        if at >= past:
            block = Block(text, at, _RUN)
            past = block.end
        k = block.offset(at)
        for size in _key_sizes(block.digits, k):
            count = -(-size * 4 // 3)
            end = block.place(k + count) if count >= LEAST else None
            if end is not None and key_ok(block.digits[k : k + count]):
                pos = _PAD[count % 4].match(text, end).end()
                out.append((at, pos))
                break
    return out


def _key_sizes(digits: str, k: int) -> list[int]:
    head = digits[k : k + 16]
    got = _decode(head[: len(head) // 4 * 4]) or b""
    if got[:1] == b"\x30":
        return [x] if (x := der_size(got)) else []
    if not (got.startswith(b"openssh-key") or re.match(rb"\0{3}.(?:s|e)", got, re.DOTALL)):
        return []
    rest = len(digits) - k
    return ssh_sizes(_decode(digits[k : k + rest - (rest % 4 == 1)]) or b"")


def key_ok(text: str) -> bool:
    data = _decode(text)
    return data is not None and (der_key(data) or ssh_ok(data))


def hex_keys(text: str) -> list[tuple[int, int]]:
    """(start, end) of hex keys, by the same rules."""
    out: list[tuple[int, int]] = []
    block, past, pos = None, 0, 0
    while m := _HEXSTART.search(text, pos):
        at = m.start()
        pos = at + 1
        if at >= past:
            block = Block(text, at, _HEXRUN)
            past = block.end
        k = block.offset(at)
        head = block.digits[k : k + 12]
        count = 2 * (der_size(bytes.fromhex(head[: len(head) // 2 * 2])) or 0)
        end = block.place(k + count) if count >= HEXLEAST else None
        if end is not None and der_key(bytes.fromhex(block.digits[k : k + count])):
            out.append((at, end))
            pos = end
    return out


def tokens(text: str) -> list[tuple[int, int]]:
    """(start, end) of signed tokens."""
    out: list[tuple[int, int]] = []
    for m in _JWT.finditer(text):
        if (out and m.start() < out[-1][1]) or not isinstance(_json(m[2]), dict):
            continue
        for k in range(m.start(), m.end()):
            if _OBJECT.match(text, k, m.end()) and jwt_ok(text[k : m.end(3)]):
                out.append((k, m.end(3)))
                break
    return out


def scan(text: str, gates: tuple[bool, ...] = (True,) * 5) -> list[tuple[int, int, int]]:
    """(start, kind, end) of one text, sorted; kind is an index of KINDS."""
    out: list[tuple[int, int, int]] = []
    if gates[0]:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if gates[1]:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if gates[2]:
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if gates[3]:
        out += [(a, 3, b) for a, b in tokens(text)]
    if gates[4]:
        out += [(a, 4, b) for a, b in keys(text)]
        out += [(a, 4, b) for a, b in hex_keys(text)]
    return sorted(set(out))


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, limit=8 << 20):
        texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
        n = len(texts)
        gates = np.stack([np.asarray(pc.match_substring_regex(texts, g, ignore_case=low), bool) for g, low in _GATES.values()], 1)
        rows: list[tuple] = [(0, 0, 0, _EMPTY, "", 0)] * n
        for r in np.flatnonzero(gates.any(1)).tolist():
            spans = scan(texts[r].as_py(), tuple(gates[r]))
            count = [sum(k == i for _, k, _ in spans) for i in range(5)]
            base = spans_text([x for x in spans if x[1] < 3])
            rows[r] = (*count[:3], hashlib.sha256(base.encode()).hexdigest(), spans_text(spans), count[3] + count[4])
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"])


_EMPTY = hashlib.sha256(b"").hexdigest()


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_assign, n_access, n_hex, base_sha256, spans
    and n_confirmed (the spans that decoding added).

    Offsets are code points, ends exclusive. Null and empty texts have no spans (empty
    string); null ids stay null; repeated rows give repeated results; other columns are
    not read. Every text is scanned whole.
    """
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    out = base.mapInArrow(_scan_batches, "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long")
    return out.withColumnRenamed("id", id_col)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
