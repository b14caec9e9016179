"""Packing of token sequences in the order of a space-filling curve.

Each document is tokenised, its hashed bag of tokens is projected to a few dimensions, and the cell of that point gives its key on
a Hilbert curve. Documents are range-sorted by key, laid end to end, and the line is cut every ``length`` tokens. So neighbours on
the curve share sequences and only the last sequence is short.

Nulls: a null text counts as empty, which is the end token alone; null ids are carried. Repeated rows are packed each
by itself. Equal keys are ordered by id, and by token bytes where ids are equal. An empty table gives no rows. Only the id and
text columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import islice
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from llm.common import release_memory, stored, texts_of

_CACHE = 300_000
_CLOSING = ".,!?$%&*#;:"
# Letters and digits that are such in every edition of the character tables; U+0130 lower-cases to a letter and a mark.
_ENDS = frozenset(c for c in map(chr, range(0x250)) if c.isalnum() and c != "\u0130")
_LONG = 64
_BUCKETS = 256
_FLUSH = 1 << 22
SLICE = 4 << 20
_GROUP = 1 << 17


def _is_latin(text: str) -> bool:
    """Whether all characters are below U+0100: then nothing can be composed."""
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


class Words:
    """Ids of texts by a tokenizer that lower-cases, never joins across ASCII white space, and splits letters from marks.

    So each word between white space is encoded by itself, once for many texts, a word's closing ASCII marks apart from the rest, and texts in
    composed form can be lower-cased first. The ids of short words are kept, a bounded number. Words of letters are
    encoded many at a time; the vocabulary's word-end suffix tells where one ends.
    """

    def __init__(self, tokenizer_json: str, suffix: str = "</w>"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.closes = np.zeros(size, bool)
        self.closes[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {"": b""}

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, encoded as one text."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.dtype)
        ends = (np.flatnonzero(self.closes[ids]) + 1) * ids.itemsize
        if len(ends) != len(words):  # some letter lower-cases to more than letters
            return self._raw(words)
        blob, ends = ids.tobytes(), ends.tolist()
        return [blob[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def _fresh(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words that are not kept."""
        letters = [w for w in words if w.isalpha() and len(w) <= _LONG]
        found = {}
        for i in range(0, len(letters), 256):
            found.update(zip(letters[i : i + 256], self._letters(letters[i : i + 256])))
        others = [w for w in words if w not in found]
        found.update(zip(others, self._raw(others) if others else []))
        return found

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of each word."""
        known = self.known
        stems = [s if (s := w.rstrip(_CLOSING)) and s[-1] in _ENDS else w for w in words]
        marks = [w[len(s) :] if s is not w else "" for w, s in zip(words, stems)]
        out = list(map(known.get, stems))
        found = self._fresh({s for s, ids in zip(stems, out) if ids is None} | {m for m in set(marks) if m not in known})
        ends = {m: found[m] if m in found else known[m] for m in set(marks)}
        out = [(found[s] if ids is None else ids) + ends[m] if m else found[s] if ids is None else ids for s, m, ids in zip(stems, marks, out)]
        if len(known) + len(found) > _CACHE:
            known.clear()
            known[""] = b""
        known.update((w, ids) for w, ids in islice(found.items(), _CACHE) if len(w) <= _LONG)
        return out

    def encode(self, texts: list[str], end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, ``end`` after each text's, and where each text's stop."""
        plain = pa.array(texts, pa.large_string())
        lower = pc.ascii_lower(plain)
        fits = ["<" not in t and (_is_latin(t) or (is_normalized("NFC", t) and is_normalized("NFC", lower[i].as_py()))) for i, t in enumerate(texts)]
        words = pc.ascii_split_whitespace(pc.if_else(pa.array(fits, pa.bool_()), lower, plain))
        stops = words.offsets.to_numpy()[1:].astype(np.int64)
        coded = words.flatten().dictionary_encode()
        del plain, lower, words
        ids = [*self._ids(coded.dictionary.to_pylist()), end]
        lengths = np.array([len(x) for x in ids], np.int32) // self.dtype.itemsize
        pool, first = np.frombuffer(b"".join(ids), self.dtype), np.cumsum(lengths, dtype=np.int32) - lengths
        del ids
        codes = np.insert(coded.indices.to_numpy(), stops, len(lengths) - 1)
        counts = lengths[codes]
        ends = np.cumsum(counts, dtype=np.int32)
        taken = np.repeat(first[codes] - (ends - counts), counts)
        taken += np.arange(ends[-1], dtype=np.int32)
        return pool[taken], ends[stops + np.arange(len(stops))].astype(np.int64)


_OF_WORKER: dict[str, Words] = {}


def words_of(tokenizer_json: str) -> Words:
    """The encoder of a worker process, made once; only the last tokenizer's is kept."""
    if tokenizer_json not in _OF_WORKER:
        _OF_WORKER.clear()
        _OF_WORKER[tokenizer_json] = Words(tokenizer_json)
    return _OF_WORKER[tokenizer_json]


def projection(dims: int, seed: int = 0) -> np.ndarray:
    """Projection of each bucket of token ids."""
    rng = np.random.default_rng(seed)
    return rng.standard_normal((_BUCKETS, dims))


def _groups(parts: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Documents in groups of about _GROUP ids."""
    group, size = [], 0
    for part in parts:
        group.append(part)
        size += len(part)
        if size >= _GROUP:
            yield group
            group, size = [], 0
    if group:
        yield group


def cells(parts: list[np.ndarray], project: np.ndarray, bits: int) -> np.ndarray:
    """Cells of documents' points: hashed, signed, unit-length token counts without the end, projected, by (about) normal quantile in each dimension."""
    ids, sizes = np.concatenate(parts), np.array([len(p) for p in parts])
    stops = np.cumsum(sizes)
    mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    sign = 1.0 - 2.0 * ((mixed >> np.uint64(8)) & np.uint64(1)).astype(float)
    sign[stops - 1] = 0
    at = np.repeat(np.arange(len(stops)) * _BUCKETS, sizes) + (mixed % np.uint64(_BUCKETS)).astype(np.int64)
    counts = np.bincount(at, sign, len(stops) * _BUCKETS).reshape(-1, _BUCKETS)
    norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
    points = counts @ project / np.maximum(norms, 1e-300)
    return np.minimum((1 << bits) / (1 + np.exp(-1.702 * points)), (1 << bits) - 1).astype(np.int64)


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Key on the Hilbert curve of each row of cell numbers below 2 ** bits (Skilling's transposed form)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            upper = (x[i] & q) != 0
            swap = np.where(upper, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(upper, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    keys = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            keys = keys << 1 | (x[i] >> b & 1)
    return keys


def tokenised(docs: DataFrame, tokenizer_json: str, end_id: int = 1, dims: int = 4, bits: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, n, ids (with the end id) of each row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches):
        words = words_of(shared.value)
        end = np.array([end_id], words.dtype).tobytes()
        project = projection(dims)
        for batch in batches:
            texts, size, start = [], 0, 0
            for i, text in enumerate(texts_of(batch)):
                texts.append(text)
                size += len(text)
                if size > SLICE or i + 1 == batch.num_rows:
                    ids, stops = words.encode(texts, end)
                    parts = np.split(ids, stops[:-1])
                    keys = hilbert_keys(np.concatenate([cells(p, project, bits) for p in _groups(parts)]), bits)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("doc_id").slice(start, len(texts)),
                            pa.array(keys),
                            pa.array(np.diff(stops, prepend=0)),
                            pa.array([p.tobytes() for p in parts], pa.binary()),
                        ],
                        names=["doc_id", "key", "n", "ids"],
                    )
                    texts, size, start = [], 0, i + 1
                    del ids, parts
                    release_memory()

    return rows.mapInArrow(run, "doc_id long, key long, n long, ids binary")


def pack(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces: doc_id, start, length, ids (little-endian unsigned 32-bit integers), doc_tokens, sequence_id, offset, key.

    The driver holds one number per sorted partition: the tokens before it.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer_json = file.read()
    made = stored(tokenised(docs, tokenizer_json, end_id, id_col=id_col, text_col=text_col), "pack-tokens")
    ordered = made.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id", "ids")

    def place(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            before = at + np.cumsum(n) - n
            at += int(n.sum())
            columns = [*batch.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(before)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "part", "before"])

    placed = stored(ordered.mapInArrow(place, "doc_id long, key long, n long, ids binary, part int, before long"), "pack-order")
    totals = sorted((r["part"], r["n"]) for r in placed.groupBy("part").agg(F.sum("n").alias("n")).collect())
    base, at = {}, 0
    for part, n in totals:
        base[part], at = at, at + n

    def cut(batches):
        for batch in batches:
            rows = [batch.column(c).to_pylist() for c in ("doc_id", "key", "n", "ids", "part", "before")]
            pieces, size = [], 0
            for doc_id, key, n, ids, part, before in zip(*rows):
                first = base[part] + before
                values = np.frombuffer(ids, f"<u{len(ids) // n}")
                start = 0
                while start < n:
                    sequence, offset = divmod(first + start, length)
                    stop = min(n, start + length - offset)
                    pieces.append((doc_id, start, stop - start, values[start:stop].astype("<u4").tobytes(), n, sequence, offset, key))
                    size += stop - start
                    start = stop
                    if size > _FLUSH:
                        yield _pieces(pieces)
                        pieces, size = [], 0
            if pieces:
                yield _pieces(pieces)

    return placed.mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, key long")


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "key"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
