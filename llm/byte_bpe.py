"""Byte-level BPE through a sentencepiece model written from a rank file.

The rank file's byte strings become pieces over an alphabet of 256 printable characters, one per byte, scored by
negative rank, so that sentencepiece merges the pair of least rank first, as the ranks mean.
Normalisation is the identity. Texts are split by the vocabulary's pattern, each match is encoded by itself
(a match that is a token outright is that token), and ids decode by the inverse byte mapping.

Nulls: a null text counts as empty: no ids. Repeated rows each get a row; null ids are carried. An empty table
gives no rows. Only the id and text columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from llm.common import texts_of

_UNKNOWN = "⁇unknown⁇"  # outside of the byte alphabet, so no text holds it
_CACHE = 200_000
_LONG = 64
_BLOCK = 1 << 16
_FLUSH = 1 << 22


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself where printable, else the next from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Byte strings by rank."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """A protocol buffer field: varint, 32-bit float or bytes."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise(tokens: list[bytes]) -> bytes:
    """The sentencepiece model of a vocabulary; piece ids are ranks, one unknown piece follows.

    Fixed field numbers of the public model format: pieces 1 (text 1, score 2, kind 3: 1 normal, 2 unknown), trainer 2 (model
    kind 3: 2 is BPE, vocabulary size 4, ids of unknown, begin, end, pad 40 to 43, unknown piece 45), normaliser 3 (name 1,
    dummy prefix 3, extra white space 4, escaping 5).
    """
    letters = byte_alphabet()
    pieces = [_field(1, "".join(letters[b] for b in t).encode()) + _field(2, float(-rank)) + _field(3, 1) for rank, t in enumerate(tokens)]
    pieces.append(_field(1, _UNKNOWN.encode()) + _field(2, 0.0) + _field(3, 2))
    off = (1 << 64) - 1
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(tokens)) + _field(41, off) + _field(42, off) + _field(43, off) + _field(45, _UNKNOWN.encode())
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encoder and decoder of one model; keeps the ids of short matches, a bounded number of them."""

    def __init__(self, model: bytes, pattern: str):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.find = regex.compile(pattern).finditer
        self.letters = byte_alphabet()
        back = {c: b for b, c in enumerate(self.letters)}
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size() - 1))
        self.tokens = [bytes(back[c] for c in p) for p in pieces]
        self.whole = {t: i for i, t in enumerate(self.tokens)}
        self.known: dict[str, bytes] = {}

    def _encode(self, matches: list[str]) -> list[bytes]:
        """Ids of each match as little-endian 32-bit integers."""
        raw = [m.encode() for m in matches]
        out = [self.whole.get(r) for r in raw]
        rest = [i for i, w in enumerate(out) if w is None]
        shown = ["".join(map(self.letters.__getitem__, raw[i])) for i in rest]
        for i, ids in zip(rest, self.model.encode(shown, num_threads=1) if shown else []):
            out[i] = ids
        return [np.array(ids if isinstance(ids, list) else [ids], "<u4").tobytes() for ids in out]

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids of a text, in blocks of bytes."""
        matches = (m.group() for m in self.find(text))
        while block := list(islice(matches, _BLOCK)):
            known = self.known
            fresh = list({m for m in block if m not in known})
            found = dict(zip(fresh, self._encode(fresh)))
            yield b"".join([known[m] if m in known else found[m] for m in block])
            if len(known) + len(fresh) > _CACHE:
                known.clear()
            known.update((m, ids) for m, ids in islice(found.items(), _CACHE) if len(m) <= _LONG)

    def decode(self, ids: bytes) -> bytes:
        """Bytes of a block of ids."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[bytes, Codec] = {}


def _codec(model: bytes, pattern: str) -> Codec:
    """The worker's codec for a model, made once."""
    key = hashlib.sha256(model + pattern.encode()).digest()
    if key not in _CODECS:
        _CODECS[key] = Codec(model, pattern)
    return _CODECS[key]


def encoded(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ids (little-endian unsigned 32-bit integers), decoded (bytes of the text from the ids)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    model = docs.sparkSession.sparkContext.broadcast(serialise(read_ranks(ranks_path)))

    def run(batches):
        codec = _codec(model.value, pattern)
        for batch in batches:
            ids, size, start = [], 0, 0
            for i, text in enumerate(texts_of(batch)):
                ids.append(b"".join(codec.encode(text)))
                size += len(text)
                if size > _FLUSH or i + 1 == batch.num_rows:
                    columns = [pa.array(ids, pa.binary()), pa.array(map(codec.decode, ids), pa.binary())]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(ids)), *columns], names=["doc_id", "ids", "decoded"])
                    ids, size, start = [], 0, i + 1

    return rows.mapInArrow(run, f"doc_id {kind}, ids binary, decoded binary")
