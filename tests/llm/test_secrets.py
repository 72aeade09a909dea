import base64
import json

import pytest

from millrace.llm import secrets


def tlv(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2, "big")) + body


def ssh(*fields):
    return b"".join(len(x).to_bytes(4, "big") + x for x in fields)


def b64(data):
    return base64.b64encode(data).decode()


def found(text):
    gate = secrets.pc.match_substring_regex(secrets.pa.array([text]), secrets._GATES["key"][0])[0].as_py()
    return [text[a:b] for a, k, b in secrets.scan(text) if k == 4] if gate else []


RAND = bytes((i * 37 + 11) % 256 for i in range(600))
#: 51 and 312 bytes: no padding
ED = b64(ssh(b"ssh-ed25519", RAND[:32]))
RSA = b64(tlv(0x30, tlv(2, RAND[:150]), tlv(2, RAND[:150])))
PRIVATE = b64(b"openssh-key-v1\0" + ssh(b"none", b"none", b"") + (1).to_bytes(4, "big") + ssh(ssh(b"ssh-ed25519", RAND[:32]), RAND[:140]))


@pytest.mark.parametrize("after", ["\nNext line", "\r\nNext line", "\n\nx", "", " x", "\nssh-ed25519 abc", "\\nNext"])
def test_a_key_ends_at_its_own_line(after):
    assert len(RSA) % 4 == 0 and RSA[-1] != "=" and ED[-1] != "="
    assert found("a " + ED + after) == [ED] and found("a " + RSA + after) == [RSA]
    assert found(f"ssh-ed25519 {ED}\nssh-ed25519 {ED}{after}") == [ED, ED]


@pytest.mark.parametrize("sep", ["\n", "\r\n", "\n    ", "\n\t", "\\n", "\\r\\n", " \n"])
@pytest.mark.parametrize("key", [ED, RSA, PRIVATE])
@pytest.mark.parametrize("width", [3, 64])
def test_wrapped_keys(key, sep, width):
    wrapped = sep.join(key[i : i + width] for i in range(0, len(key), width))
    assert found(f"-----BEGIN KEY-----{sep}{wrapped}{sep}Some more words") == [wrapped]
    assert found(f"-----BEGIN KEY-----{sep}{wrapped[:-4]}{sep}") == [] or key is PRIVATE


ED_PRIVATE = tlv(0x30, tlv(2, b"\0"), tlv(0x30, tlv(6, b"\x2b\x65\x70")), tlv(4, tlv(4, RAND[:32])))
ED_PUBLIC = tlv(0x30, tlv(0x30, tlv(6, b"\x2b\x65\x70")), tlv(3, b"\0" + RAND[:32]))
EC_OIDS = (tlv(6, bytes.fromhex("2a8648ce3d0201")), tlv(6, bytes.fromhex("2a8648ce3d030107")))
EC_PUBLIC = tlv(0x30, tlv(0x30, *EC_OIDS), tlv(3, b"\0\x04" + RAND[:64]))
EC_PRIVATE = tlv(0x30, tlv(2, b"\1"), tlv(4, RAND[:32]), tlv(0xA0, EC_OIDS[1]), tlv(0xA1, tlv(3, b"\0\x04" + RAND[:64])))


@pytest.mark.parametrize(("der", "head"), [(ED_PRIVATE, "MC4CAQAwBQYDK2Vw"), (ED_PUBLIC, "MCow"), (EC_PUBLIC, "MFkw"), (EC_PRIVATE, "MHcCAQEE")])
def test_short_der_keys(der, head):
    key = b64(der)
    assert key.startswith(head)
    for before in ("", "k=", "MAMBMCMD", "-----BEGIN KEY-----\\n", "-----BEGIN KEY-----\n"):
        for after in ("", "\n-----END KEY-----", "\nNext line", " MI"):
            assert found(before + key + after) == [key]
            assert found(before + key.rstrip("=") + after) == [key.rstrip("=")]
    assert found(key[:20] + key[24:]) == []
    for text in (der.hex(), der.hex().upper(), "0x" + der.hex(), "cafe3001" + der.hex(), der.hex()[:64] + "\n  " + der.hex()[64:]):
        assert any(text.endswith(x) and len(x) >= 2 * len(der) for x in found(text))


@pytest.mark.parametrize("head", ['{"alg":"HS256"}', '{ "alg": "none" }', '{\n  "alg": "RS256"\n}', ' {"alg":"x"}', '\r\n\t{"alg":"x"}', '\n{"alg":"x"}'])
@pytest.mark.parametrize("before", ["", "tok.", "eyJe0.eyI.", "Bearer "])
def test_token_headers(head, before):
    enc = lambda x: base64.urlsafe_b64encode(x.encode()).decode().rstrip("=")
    for body in ("{}", '{"sub":1}', '{\n"sub": 1}'):
        token = f"{enc(head)}.{enc(body)}.c2ln"
        gate = secrets.pc.match_substring_regex(secrets.pa.array([before + token]), secrets._GATES["jwt"][0])[0].as_py()
        assert gate and [(before + token)[a:b] for a, k, b in secrets.scan(before + token) if k == 3] == [token]
        assert secrets.tokens(f"{enc(json.dumps({'typ': 'JWT'}))}.{enc(body)}.c2ln") == []


def test_long_runs_stay_cheap():
    assert secrets.hex_keys("30" * 200_000) == [] and secrets.tokens("eyJ0" * 100_000 + ".x.y") == []
    for text in ("MAMA" * 100_000, "MFkw" * 100_000, "MIIB" * 100_000, "A" * 400_000, ("MIIBAAAA" * 8 + "\n") * 8_000, "MIIBIj\n" * 50_000):
        assert secrets.keys(text) == []


INT = lambda n: tlv(2, RAND[:n])
RSA_PRIVATE = tlv(0x30, tlv(2, b"\0"), *(INT(n) for n in (129, 3, 128, 64, 64, 64, 64, 64)))
RSA_PKCS8 = tlv(0x30, tlv(2, b"\0"), tlv(0x30, tlv(6, secrets.RSA_OID), tlv(5)), tlv(4, RSA_PRIVATE))
EC_PKCS8 = tlv(0x30, tlv(2, b"\0"), tlv(0x30, *EC_OIDS), tlv(4, tlv(0x30, tlv(2, b"\1"), tlv(4, RAND[:32]))))
ENCRYPTED = tlv(0x30, tlv(0x30, tlv(6, RAND[:9]), tlv(0x30, INT(8))), tlv(4, RAND[:200]))
RSA_PUBLIC = tlv(0x30, INT(129), tlv(2, b"\1\0\1"))
CERTIFICATE = tlv(0x30, tlv(0x30, tlv(0xA0, tlv(2, b"\2")), INT(8), tlv(0x30, tlv(6, RAND[:9]))), tlv(0x30, tlv(6, RAND[:9])), tlv(3, b"\0" + RAND[:128]))


@pytest.mark.parametrize("der", [RSA_PRIVATE, RSA_PKCS8, EC_PKCS8, ENCRYPTED, RSA_PUBLIC, ED_PRIVATE, ED_PUBLIC, EC_PUBLIC, EC_PRIVATE])
def test_key_formats(der):
    assert found("x " + b64(der) + "\nend") == [b64(der)]
    assert der.hex() in found(der.hex())[0]


@pytest.mark.parametrize(
    "der",
    [
        CERTIFICATE, tlv(0x30, tlv(0x0C, b"some plain text, no key")), tlv(0x30, INT(33), INT(32)), tlv(0x30, INT(66), INT(66)), tlv(0x30, tlv(4, RAND[:40])),
        tlv(0x30, tlv(2, b"\0"), tlv(0x30, tlv(6, secrets.RSA_OID), tlv(5)), tlv(4, RAND[:60])), tlv(0x30, tlv(2, b"\7"), tlv(4, RAND[:40])), tlv(0x30, tlv(0x30, tlv(2, b"\1")), tlv(3, b"\0" + RAND[:32])),
    ],
)
def test_other_sequences_are_no_keys(der):
    assert secrets.der_ok(der) and found("x " + b64(der) + "\nend") == [] and found(der.hex()) == []


def test_random_base64_is_no_key():
    import random

    rng = random.Random(1)
    for _ in range(3000):
        assert found(b64(rng.randbytes(rng.randrange(20, 200)))) == []


def test_base_spans_against_plain_code():
    import random
    import re

    rng = random.Random(2)
    bits = ["password", "Secret", "api_key", "apikey", "TOKEN", "=", ": ", " ", "'", "abcd1234", "x", "é", "AKIA", "ABCDEFGH12345678", "0123456789abcdef" * 2, "deadbeef", "\n", "==", "/+", "\u017f", "\u212a"]
    for _ in range(2000):
        text = "".join(rng.choices(bits, k=rng.randrange(0, 25)))
        want = []
        for i, (pattern, flags, least, group) in enumerate(((secrets.ASSIGN, re.A | re.I, 8, 2), (secrets.ACCESS, 0, 16, 0), (secrets.HEX, 0, 32, 0))):
            want += [(m.start(), i, m.end()) for m in re.finditer(pattern, text, flags) if len(m[group]) >= least]
        gates = tuple(secrets.pc.match_substring_regex(secrets.pa.array([text]), g, ignore_case=low)[0].as_py() for g, low in secrets._GATES.values())
        assert [x for x in secrets.scan(text, gates) if x[1] < 3] == sorted(want)
