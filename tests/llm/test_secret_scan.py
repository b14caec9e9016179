import base64
import json
import re

from hypothesis import given, settings, strategies as st

from llm import secret_scan as S


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


def number(n):
    return der(2, b"\x01" + bytes(range(n)))


RSA = der(0x30, der(2, b"\0"), number(128), der(2, b"\1\0\1"), *(number(64) for _ in range(6)))
EC = der(0x30, der(2, b"\1"), der(4, bytes(range(32))), der(0xA0, der(6, b"\x2a\x86\x48")))
PKCS8 = der(0x30, der(2, b"\0"), der(0x30, der(6, b"\x2b\x65\x70")), der(4, der(4, bytes(range(32)))))


def field(data):
    return len(data).to_bytes(4, "big") + data


SSH = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(field(b"ssh-ed25519") + field(bytes(32))) + field(bytes(64))


def b64(data, url=False):
    return (base64.urlsafe_b64encode(data).rstrip(b"=") if url else base64.b64encode(data)).decode()


def jwt(head, n, payload=b'{"sub":"1"}'):
    return ".".join([b64(json.dumps(head).encode(), True), b64(payload, True), b64(bytes(n), True)])


def kinds(text):
    return [k for _, k, _ in S.spans(text) if k not in S.BASE_KINDS]


def test_confirmed_kinds():
    for key in (RSA, EC, PKCS8):
        assert kinds(f"x {b64(key)} y") == ["der"]
        assert kinds(f"x {key.hex().upper()} y") == ["der"]
        assert kinds(f"x {b64(key[:-1])} y") == [], "lengths must agree"
    assert kinds(f"({b64(SSH)})") == ["ssh"]
    assert kinds(b64(SSH[:-8])) == []
    assert kinds("see " + jwt({"alg": "HS256"}, 32)) == ["jwt"]
    for wrong in (jwt({"alg": "HS256"}, 31), jwt({"typ": "JWT"}, 32), jwt({"alg": "HS256"}, 32, b"[1]"), "www.example-site.com"):
        assert kinds(wrong) == []
    body = "\n".join(re.findall(".{1,64}", b64(RSA)))
    assert kinds(f"-----BEGIN RSA PRIVATE KEY-----\n{body}\n-----END RSA PRIVATE KEY-----") == ["pem"]
    assert kinds(f"-----BEGIN RSA PRIVATE KEY-----\n{body[:-20]}\n-----END RSA PRIVATE KEY-----") == []


def test_tokens_beside_full_stops_and_dashes():
    for token in (jwt({"alg": "HS256"}, 32), jwt({"alg": "RS256"}, 256), jwt({"alg": "none"}, 0)):
        for before in ("", "The leaked one is ", "so ...", "see it.", "longer-words.", "--", "_", "id-", "extra_", "eyJ-"):
            for after in ("", ".", "...", ". Next", "--", "_", "-.", ".\n", ", "):
                found = [(s, e) for s, k, e in S.spans(before + token + after) if k == "jwt"]
                assert found == [(len(before), len(before + token))], (before, token, after)
        assert kinds(token + ".abc") == kinds(token + "._") == kinds("x" + token) == []
    assert S.redact("It is " + jwt({"alg": "HS256"}, 32) + ".") == "It is [SECRET]."


def test_dsa_keys():
    key = der(0x30, der(2, b"\0"), number(128), number(20), number(128), number(128), number(19))
    body = "\n".join(re.findall(".{1,64}", b64(key)))
    assert kinds(f"-----BEGIN DSA PRIVATE KEY-----\n{body}\n-----END DSA PRIVATE KEY-----") == ["pem"]
    assert kinds(f"x {b64(key)} y") == kinds(f"x {key.hex()} y") == ["der"]
    for wrong in (key[:-1], der(0x30, der(2, b"\0"), *(number(19) for _ in range(5))), der(0x30, der(2, b"\1"), number(128), number(20), number(128), number(128), number(19))):
        assert kinds(f"x {b64(wrong)} y") == []


def plain(text):
    """The base kinds, read letter by letter from their statement."""
    found = []
    at = 0
    pattern = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    while m := pattern.search(text, at):
        at = m.end()
        if len(m[2]) >= 6:
            found.append((m.start(), "assign", m.end()))
    for kind, p, n in (("access", r"AKIA[A-Z0-9]+", 20), ("hex", r"[0-9a-f]+", 24)):
        found += [(m.start(), kind, m.end()) for m in re.finditer(p, text) if m.end() - m.start() >= n]
    return sorted(found, key=lambda s: (s[0], S.BASE_KINDS.index(s[1])))


PIECES = ["password", "ToKen", "secret", "api_key", "APIKEY", "ſecret", "toKen", '"', "'", " ", "  ", ":", "=", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "abc", "xyz12", "\n", "é", "😀"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join))
def test_base_kinds_as_stated(text):
    assert [s for s in S.spans(text) if s[1] in S.BASE_KINDS] == plain(text)


def test_table_and_redaction(spark):
    secret = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'
    texts = [(1, f"é {secret} b {secret}"), (1, None), (2, ""), (None, "AKIA" + "B" * 16), (3, "a" * 2_000_000)]
    rows = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS spans")
    got = S.scan(rows).collect()
    assert [len(r.spans) for r in got] == [4, 0, 0, 1, 1]
    assert [(s.kind, s.start, s.end) for s in got[0].spans[:2]] == [("assign", 2, 2 + len(secret) - 1), ("hex", 11, 51)]
    cleaned = S.redacted(rows).collect()
    assert [r.text for r in cleaned[:4]] == ['é [SECRET]" b [SECRET]"', None, "", "[SECRET]"]
    assert S.scan(rows.limit(0)).count() == S.redacted(rows.limit(0)).count() == 0


def test_header_search_is_linear_and_equals_a_search_of_every_start():
    import base64
    import json
    import random
    import time

    rng = random.Random(6)
    for _ in range(300):
        body = {"alg": "none", **{rng.choice("ab\"{}\\") * rng.randint(1, 3): rng.choice(["x", '{"', "\\", {"a": "}"}, [1]]) for _ in range(rng.randint(0, 3))}}
        part = base64.urlsafe_b64encode(json.dumps(body, separators=rng.choice([(",", ":"), (", ", ": ")])).encode()).decode().rstrip("=")
        part = rng.choice(["", "-", "_", "--", "-_-", "eyJ-", "abc-", "-eyJ9-"]) + part
        wanted = [h.start() for h in S._HEADER.finditer(part) if S._object(part[h.start() :])]
        assert [h for h in S._headers(part) if S._object(part[h:])] == wanted and wanted
    took = {}
    for n in (50_000, 200_000):
        text = "-eyJ" * n + ".eyJhIjoxfQ." + "x" * 43
        began = time.perf_counter()
        assert not [s for s in S.spans(text) if s[1] == "jwt"]
        took[n] = time.perf_counter() - began
    assert took[200_000] < 10 * took[50_000] + 1
