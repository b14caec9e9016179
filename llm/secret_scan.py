"""Secret scan with structural confirmation.

Three base kinds are patterns alone: assign, access, hex. Further kinds are reported only after their content has been
decoded and parsed:

* jwt: three base64url parts; the first two are JSON objects, the header names its algorithm, and the signature has
  a length that algorithm gives. A full stop, dash or underscore may stand before or after it, but no fourth part.
* pem: a private key between BEGIN and END lines whose base64 body parses as a key or, with an encryption header, as whole cipher blocks.
* der: a bare base64 or hex run that decodes to a private key: nested lengths all agree and the fields are those of a
  PKCS#1, DSA, PKCS#8, encrypted PKCS#8 or SEC 1 key.
* ssh: a bare base64 run that decodes to an OpenSSH private key container whose nested lengths agree.

Offsets are code points, end exclusive. Nulls: a null text counts as empty: no spans. Repeated rows each get a row; null ids are
carried. An empty table gives no rows. Only the id and text columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from llm.common import map_arrow, texts_of

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "jwt", "pem", "der", "ssh")

# The base patterns; a match is dropped if too short, which leaves no room for another in it.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

_JWT = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{8,}+)\.([A-Za-z0-9_-]{2,}+)\.([A-Za-z0-9_-]*+)(?!\.[A-Za-z0-9_-])")
# An opening brace, then a quote or white space, in base64.
_HEADER = re.compile(r"(?<![A-Za-z0-9])e(?:y[A-DI-L]|w[k-r0-3])")
_PEM = re.compile(
    r"-----BEGIN ((?:[A-Z0-9]{1,12} ){0,3})PRIVATE KEY-----((?:\s*[A-Za-z-]{1,40}: [^\r\n\\]{0,200}){0,4})((?:[A-Za-z0-9+/=\s]|\\[rn])*)-----END \1PRIVATE KEY-----"
)
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
_LONG_HEX = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){40,}(?![0-9A-Fa-f])")
# Signature bytes by algorithm; None: any modulus from 1024 bits on.
_SIGNATURES = {"none": 0, "HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "EdDSA": 64} | dict.fromkeys(
    ("RS256", "RS384", "RS512", "PS256", "PS384", "PS512")
)
#: Characters of signatures of these algorithms and of moduli from 1024 to 4096 bits.
_SIGNATURE_CHARS = sorted({(n * 4 + 2) // 3 for n in (0, 32, 48, 64, 96, 128, 132, 256, 384, 512)})
_INTEGER, _OCTETS, _OID, _SEQUENCE = 0x02, 0x04, 0x06, 0x30
_SSH_MAGIC = b"openssh-key-v1\0"


def unbase64(text: str) -> bytes | None:
    """Decode either alphabet, padded or not; None if it is no base64."""
    body = text.rstrip("=").translate({ord("-"): "+", ord("_"): "/"})
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (ValueError, binascii.Error):
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of consecutive DER values that fill data exactly, lengths in shortest form; else None."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data) or data[at] & 0x1F == 0x1F:
            return None
        tag, length, at = data[at], data[at + 1], at + 2
        if length & 0x80:
            size = length & 0x7F
            if not 1 <= size <= 4 or at + size > len(data) or data[at] == 0:
                return None
            length = int.from_bytes(data[at : at + size], "big")
            if length < 0x80:
                return None
            at += size
        if at + length > len(data):
            return None
        items.append((tag, data[at : at + length]))
        at += length
    return items


def _algorithm(content: bytes) -> bool:
    items = der_items(content)
    return bool(items) and items[0][0] == _OID and len(items[0][1]) >= 3


def is_private_key(data: bytes) -> bool:
    """Whether data is one DER value with the fields of a private key."""
    outer = der_items(data) if data[:1] == b"\x30" else None
    if not outer or len(outer) != 1:
        return False
    items = der_items(outer[0][1])
    if not items:
        return False
    tags = [t for t, _ in items]
    if tags[0] == _INTEGER and items[0][1] in (b"\0", b"\1"):
        if len(tags) >= 9 and set(tags[:9]) == {_INTEGER}:
            return len(items[1][1]) >= 64 and len(items[3][1]) >= 32
        if len(tags) == 6 and set(tags) == {_INTEGER}:  # DSA: p, q, g, y, x
            return items[0][1] == b"\0" and len(items[1][1]) >= 64 and 20 <= len(items[2][1]) <= 33 and 0 < len(items[5][1]) <= len(items[2][1])
        if tags[1:3] == [_SEQUENCE, _OCTETS]:
            return _algorithm(items[1][1]) and len(items[2][1]) >= 16
        return items[0][1] == b"\1" and len(tags) >= 2 and tags[1] == _OCTETS and len(items[1][1]) >= 20 and set(tags[2:]) <= {0xA0, 0xA1}
    return tags == [_SEQUENCE, _OCTETS] and _algorithm(items[0][1]) and len(items[1][1]) >= 16


def is_ssh_key(data: bytes) -> bool:
    """Whether data is an OpenSSH private key container: four-byte lengths agree down to the key types."""
    if not data.startswith(_SSH_MAGIC):
        return False

    def take(at: int) -> tuple[bytes, int]:
        end = at + 4 + int.from_bytes(data[at : at + 4], "big")
        if at + 4 > len(data) or end > len(data):
            raise ValueError
        return data[at + 4 : end], end

    try:
        at = len(_SSH_MAGIC)
        for _ in range(3):  # cipher, key derivation, its options
            _, at = take(at)
        keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
        if not 1 <= keys <= 16:
            return False
        for _ in range(keys):
            public, at = take(at)
            if 4 + int.from_bytes(public[:4], "big") > len(public):
                return False
        private, at = take(at)
    except ValueError:
        return False
    return at == len(data) and len(private) % 8 == 0 and len(private) > 0


def _object(part: str) -> dict | None:
    data = unbase64(part)
    try:
        found = json.loads(data) if data and data[:1] == b"{" else None
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def is_signed_token(header: str, payload: str, signature: str) -> bool:
    head = _object(header)
    algorithm = head.get("alg") if head else None
    if not isinstance(algorithm, str) or algorithm not in _SIGNATURES or _object(payload) is None:
        return False
    data, want = unbase64(signature) if signature else b"", _SIGNATURES[algorithm]
    return data is not None and (len(data) >= 128 if want is None else len(data) == want)


_MARKS = re.compile(rb'["{}]')


def _opening(data: bytes) -> int | None:
    """Place of the brace that the closing one at the end belongs to, read backwards once; no other place can begin an object that ends there."""
    data = data.rstrip(b" \t\r\n")
    if not data.endswith(b"}"):
        return None
    depth, quoted = 0, False
    for m in reversed(list(_MARKS.finditer(data))):
        at = m.start()
        if m[0] == b'"':
            before = at
            while before and data[before - 1] == 0x5C:  # a backslash
                before -= 1
            quoted ^= (at - before) % 2 == 0
        elif not quoted:
            depth += 1 if m[0] == b"}" else -1
            if depth == 0:
                return at
    return None


def _headers(part: str) -> list[int]:
    """Where a token's header may begin that ends with the part: one place at most for each way to align groups of four characters."""
    found = []
    for first in range(min(4, len(part))):
        data = unbase64(part[first:])
        at = _opening(data) if data else None
        if at is not None and at % 3 == 0 and _HEADER.match(part, first + at // 3 * 4):
            found.append(first + at // 3 * 4)
    return sorted(found)


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of signed tokens; dashes and underscores around one are in its alphabet, so decoding tells what is part of it."""
    at = 0
    while m := _JWT.search(text, at):
        at = m.end(1)  # the second part may be a token's first
        if _object(m[2]) is None:
            continue
        least = len(m[3].rstrip("-_"))
        signatures = [m[3][:n] for n in (*_SIGNATURE_CHARS, len(m[3]), least) if least <= n <= len(m[3])]
        for start in _headers(m[1]):
            found = next((s for s in signatures if is_signed_token(m[1][start:], m[2], s)), None)
            if found is not None:
                yield m.start() + start, m.start(3) + len(found)
                at = m.end()
                break


def _is_key(data: bytes | None) -> bool:
    return data is not None and (is_private_key(data) or is_ssh_key(data))


def _confirmed(text: str) -> Iterator[tuple[int, str, int]]:
    if "." in text:
        for start, end in _tokens(text):
            yield start, "jwt", end
    if "PRIVATE KEY-----" in text:
        for m in _PEM.finditer(text):
            data = unbase64(re.sub(r"\s|\\[rn]", "", m[3]))
            if _is_key(data) or ("ENCRYPTED" in m[2] and data and len(data) % 8 == 0):
                yield m.start(), "pem", m.end()
    for m in _BASE64.finditer(text):
        if data := unbase64(m[0]):
            if is_private_key(data):
                yield m.start(), "der", m.end()
            elif is_ssh_key(data):
                yield m.start(), "ssh", m.end()
    for m in _LONG_HEX.finditer(text):
        if is_private_key(bytes.fromhex(m[0])):
            yield m.start(), "der", m.end()


def spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of all secrets by start, then kind in the order of KINDS."""
    found = {(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6}
    found |= {(m.start(), "access", m.end()) for m in _ACCESS.finditer(text)}
    found |= {(m.start(), "hex", m.end()) for m in _HEX.finditer(text)}
    found |= set(_confirmed(text))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, spans (array of kind, start, end)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batch):
        found = [[{"kind": k, "start": s, "end": e} for s, k, e in spans(t)] for t in texts_of(batch)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, _SPANS)], names=["doc_id", "spans"])

    return map_arrow(rows, run, f"doc_id {kind}, spans array<struct<kind: string, start: int, end: int>>")


def redact(text: str, mark: str = "[SECRET]") -> str:
    """The text with every stretch that spans cover replaced by one mark."""
    out, at = [], 0
    end = -1
    for start, _, stop in spans(text):
        if start > end:
            out += [text[at:start], mark]
        end = max(end, stop)
        at = end
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, secrets in the text column replaced; null texts stay null."""

    def run(batch):
        at = batch.schema.get_field_index(text_col)
        texts = [None if t.as_py() is None else redact(t.as_py(), mark) for t in batch.column(at)]
        return batch.set_column(at, pa.field(text_col, pa.string()), pa.array(texts, pa.string()))

    return map_arrow(docs, run, docs.schema)
