"""Removal of repeated byte strings by blockwise suffix sorting.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller id. Strings are judged on the input.

Every such string (a window) belongs to its anchor: of the grams in the window the one of least hash, the leftmost of equals. So equal windows
have equal anchors, and the windows of one anchor are a fragment, a short run of bytes. Fragments meet by the hash of their anchor:

1. Anchors that only one document has are put aside; numbers of documents are summed by anchor.
2. Of the rest, equal fragments meet by a 64-bit hash. A document that is not the least of its fragment loses it whole. If an anchor has one
   fragment only, that settles it.
3. Anchors with several fragments send the text of each once. These are sorted blockwise: fragments are aligned at their anchors,
   so that equal suffixes stand in the same column; ranks are computed for the columns of a cover sample (every seventh), to a depth that no
   window of the sample exceeds; then one bucket at a time, anchor by anchor and column by column, suffixes are sorted by their next cover rank and the
   few bytes around it, so that no long tie is compared byte by byte. The least document of each class of equal suffixes keeps it.

Memory of a task is bounded: documents are dealt to blocks of text, anchors to buckets whose number grows with the text, equal fragments of a block count once, and an
anchor that over ``hot`` documents have meets window by window instead, each window in a bucket of its own hash. The blocks' text is written once, bucketed by block, and
read where it lies; only hashes, flags and the fragments of step 3 are shuffled.

Nulls: a null text counts as empty; a null id counts as larger than all others, and rows of the same id never remove from each other. Repeated rows each get a row. An
empty table gives no rows. Only the id and text columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from llm.common import bytes_of, new_path, stored

_LAST = np.iinfo(np.int64).max  # stands for a null id
_PIECE = 1 << 20  # bytes hashed at a time
_BLOCK_BYTES = 8 << 20
_BUCKET_BYTES = 16 << 20
_STEP = 7  # distance of the cover's columns
_PAD = 128
# Odd 64-bit multipliers.
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)

# -- numpy: anchors, fragments, sorting -------------------------------------------------------------


def _shape(length: int) -> tuple[int, int]:
    """(grams in a window, bytes of a gram)"""
    grams = min(27, length // 2 + 1)
    return grams, length - grams + 1


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(_MULTIPLIERS[3])
    return h ^ (h >> np.uint64(29))


def _words(text: bytes) -> np.ndarray:
    """The eight bytes from each position on, as a number."""
    return np.ndarray((max(0, len(text) - 7),), "<u8", text, 0, (1,))


def _hashed(words: np.ndarray, at: np.ndarray | slice, size: int, span: int = 0) -> np.ndarray:
    """Hash of the ``size`` bytes (8 at least) from each position on; ``at`` a slice: from ``span`` positions on end."""
    take = (lambda o: words[o : o + span]) if isinstance(at, slice) else (lambda o: words[at + o])
    h = take(0) * np.uint64(_MULTIPLIERS[0])
    for i, o in enumerate([*range(8, size - 8, 8), size - 8] if size > 8 else []):
        h ^= h >> np.uint64(29)
        h += take(o)
        h *= np.uint64(_MULTIPLIERS[1 + i % 2])
    return _mixed(h)


@dataclass
class Fragments:
    """Runs of windows with one anchor: first window, number of windows, the anchor's place, its hash, document."""

    start: np.ndarray
    n: np.ndarray
    anchor: np.ndarray
    key: np.ndarray
    doc: np.ndarray

    def at(self, which) -> Fragments:
        return Fragments(self.start[which], self.n[which], self.anchor[which], self.key[which], self.doc[which])

    @classmethod
    def joined(cls, parts: list[Fragments]) -> Fragments:
        return cls(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("start", "n", "anchor", "key", "doc")))


def _none() -> Fragments:
    whole = np.zeros(0, np.int64)
    return Fragments(whole, whole, whole, np.zeros(0, np.uint64), whole)


def fragments(text: bytes, sizes: np.ndarray, length: int) -> Fragments:
    """All fragments of documents that lie end to end; ``text`` goes on for _PAD bytes."""
    grams, size = _shape(length)
    total = int(sizes.sum())
    count = total - length + 1
    if count <= 0:
        return _none()
    span = total - size + 1
    hashes = _hashed(_words(text), slice(None), size, span)
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(span, dtype=np.uint64)
    step = 1
    while step * 2 <= grams:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < grams:
        least = np.minimum(least[: len(least) - (grams - step)], least[grams - step :])
    doc = np.repeat(np.arange(len(sizes)), sizes)[:count]
    windows = np.flatnonzero(np.arange(length, total + 1) <= np.cumsum(sizes)[doc])
    if not len(windows):
        return _none()
    anchor = (least[windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(windows) != 1)]))
    start, anchor = windows[first], anchor[first]
    return Fragments(start, np.diff(np.append(first, len(windows))), anchor, _mixed(hashes[anchor]), doc[start])


def suffix_masks(tag: np.ndarray, lo: np.ndarray, n: np.ndarray, doc: np.ndarray, rows: np.ndarray, length: int) -> np.ndarray:
    """Per fragment a bit for each column whose suffix, to ``length`` bytes, a smaller document has under the same tag.

    ``rows`` are the fragments' bytes aligned at the anchor; those of windows in columns lo to lo + n - 1.
    """
    grams, _ = _shape(length)
    depth = length - _STEP + 1
    masks = np.zeros(len(tag), np.uint32)
    ranks, ranked = None, -1
    for column in range(grams):
        here = np.flatnonzero((lo <= column) & (column < lo + n))
        if len(here) < 2:
            continue
        cover = -(-column // _STEP) * _STEP
        if cover != ranked:
            with_it = np.flatnonzero((lo <= cover) & (cover + depth <= lo + n + length - 1))
            sample = np.ascontiguousarray(rows[with_it, cover : cover + depth]).view(f"V{depth}").ravel()
            ranks, ranked = np.zeros(len(tag), np.uint64), cover
            ranks[with_it] = np.unique(sample, return_inverse=True)[1].ravel()
        around = np.zeros((len(here), 8), np.uint8)
        before = cover - column
        around[:, :before] = rows[here, column:cover]
        around[:, before : _STEP - 1] = rows[here, cover + depth : column + length]
        suffix, major = around.view("<u8").ravel(), tag[here].astype(np.uint64) << np.uint64(32) | ranks[here]
        order = np.lexsort((doc[here], suffix, major))
        s, m = suffix[order], major[order]
        new = np.concatenate([[True], (s[1:] != s[:-1]) | (m[1:] != m[:-1])])
        own = doc[here][order]
        later = own > own[np.flatnonzero(new)][np.cumsum(new) - 1]
        masks[here[order[later]]] |= np.uint32(1 << column)
    return masks


# -- blocks -----------------------------------------------------------------------------------------


class Block:
    """Documents of a block, by ascending id, and their shared fragments."""

    def __init__(self, ids: list, sizes: list, text: bytes, length: int, buckets: int):
        self.ids = np.array([_LAST if i is None else i for i in ids], np.int64)
        self.sizes, self.length, self.buckets = np.array(sizes, np.int64), length, buckets
        self.text = text + bytes(_PAD)

    def all(self) -> Fragments:
        parts, begin, at = [], 0, 0
        cuts = np.flatnonzero(np.diff(np.cumsum(self.sizes) // _PIECE)) + 1
        for own in np.split(self.sizes, cuts):
            size = int(own.sum())
            found = fragments(self.text[at : at + size + _PAD], own, self.length)
            found.start, found.anchor, found.doc = found.start + at, found.anchor + at, found.doc + begin
            parts.append(found)
            begin, at = begin + len(own), at + size
        return Fragments.joined(parts)

    def place(self, key: np.ndarray) -> np.ndarray:
        """Bucket (upper half) and tag (lower half) of a hash."""
        bucket = ((key >> np.uint64(32)) * np.uint64(self.buckets)) >> np.uint64(32)
        return bucket << np.uint64(32) | (key & np.uint64(0xFFFFFFFF))

    def shared(self, places: np.ndarray, hot: np.ndarray) -> None:
        """Keep the fragments of shared anchors, those of hot ones window by window, and number the different ones."""
        found = self.all()
        place = self.place(found.key)
        at = np.minimum(np.searchsorted(places, place), len(places) - 1)
        some = places[at] == place if len(places) else np.zeros(len(place), bool)
        found, is_hot = found.at(some), hot[at[some]].astype(bool) if len(places) else np.zeros(0, bool)
        words = _words(self.text)
        if is_hot.any():
            each = found.at(is_hot)
            many = each.at(np.repeat(np.arange(len(each.n)), each.n))
            offset = np.arange(len(many.n)) - np.repeat(np.cumsum(each.n) - each.n, each.n)
            many.start, many.n = many.start + offset, np.ones_like(many.n)
            many.key = _mixed(_hashed(words, many.start, self.length))
            found = Fragments.joined([found.at(~is_hot), many])
            found = found.at(np.argsort(found.start, kind="stable"))
        first, last = _hashed(words, found.start, self.length), _hashed(words, found.start + found.n - 1, self.length)
        content = _mixed(first ^ (last >> np.uint64(7)) * np.uint64(_MULTIPLIERS[0]) + (found.n << 8 | found.anchor - found.start).astype(np.uint64) * np.uint64(_MULTIPLIERS[2]))
        content, one, self.kind = np.unique(content, return_index=True, return_inverse=True)
        order = np.lexsort((content, self.place(found.key[one])))
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        self.kind = back[self.kind]
        self.found, self.one, self.content = found, one[order], content[order]
        self.places = self.place(found.key[self.one])
        self.least = self.ids[found.doc[self.one]]  # ids ascend, so the first of a kind is its least

    def by_bucket(self, which: np.ndarray):
        """(bucket, numbers) of different fragments, in order."""
        bucket = (self.places[which] >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        for part in np.split(which, cuts) if len(which) else []:
            yield int(self.places[part[0]] >> np.uint64(32)), part

    def lost(self, status: np.ndarray, masks: np.ndarray) -> np.ndarray:
        """Whether each byte of the block's text goes."""
        found, kind = self.found, self.kind
        whole = (self.ids[found.doc] > self.least[kind]) | (status[kind] == _WHOLE)
        starts, ends = [found.start[whole]], [(found.start + found.n + self.length - 1)[whole]]
        rest = np.flatnonzero(~whole & (masks[kind] != 0))
        grams, _ = _shape(self.length)
        for column in range(grams):
            hit = rest[masks[kind[rest]] >> np.uint32(column) & np.uint32(1) == 1]
            at = found.anchor[hit] - (grams - 1) + column
            starts.append(at)
            ends.append(at + self.length)
        size = len(self.text) - _PAD
        change = np.bincount(np.concatenate(starts), minlength=size + 1) - np.bincount(np.concatenate(ends), minlength=size + 1)
        return np.cumsum(change[:size]) > 0


_WHOLE, _SORT = 1, 2


def _dealt(batches):
    """Blocks of documents, each of an Arrow batch's rows by id."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        texts = list(bytes_of(batch))
        order = sorted(range(len(ids)), key=lambda i: _LAST if ids[i] is None else ids[i])
        held, size = [], 0
        for k, i in enumerate(order):
            held.append(i)
            size += len(texts[i])
            if size >= _BLOCK_BYTES or k + 1 == len(order):
                row = [[number], [[ids[i] for i in held]], [[len(texts[i]) for i in held]], [b"".join(texts[i] for i in held)]]
                kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, kinds)], names=["block", "ids", "sizes", "text"])
                number, held, size = number + 1, [], 0


def _joined(rows: list[dict], field: str, dtype: str) -> np.ndarray:
    """One array of a block's parts, by bucket."""
    parts = [np.frombuffer(r[field], dtype) for r in sorted(rows or [], key=lambda r: r["bucket"])]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def _opened(batch: pa.RecordBatch, i: int, length: int, buckets: int) -> tuple[int, Block]:
    """A block with its shared fragments."""
    block = Block(*(batch.column(c)[i].as_py() for c in ("ids", "sizes", "text")), length, buckets)
    rows = batch.column("shared")[i].as_py()
    tags = [np.frombuffer(r["tags"], "<u4").astype(np.uint64) | np.uint64(r["bucket"] << 32) for r in sorted(rows or [], key=lambda r: r["bucket"])]
    block.shared(np.concatenate(tags) if tags else np.zeros(0, np.uint64), _joined(rows, "hot", "u1"))
    return batch.column("block")[i].as_py(), block


def _row(names_kinds: dict, *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, names_kinds.values())], names=list(names_kinds))


_COUNTED = {"bucket": pa.int32(), "block": pa.int64(), "tags": pa.binary(), "docs": pa.binary()}
_KINDS = {"bucket": pa.int32(), "block": pa.int64(), "tags": pa.binary(), "content": pa.binary(), "docs": pa.binary()}
_TEXTS = {"bucket": pa.int32(), "block": pa.int64(), "tags": pa.binary(), "places": pa.binary(), "docs": pa.binary(), "rows": pa.binary()}


def _counter(length: int, buckets: int):
    def run(batches):
        """Step 1: anchors of each block with the number of its documents that have it."""
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(*(batch.column(c)[i].as_py() for c in ("ids", "sizes", "text")), length, buckets)
                found = block.all()
                place = block.place(found.key)
                order = np.lexsort((found.doc, place))
                p, d = place[order], found.doc[order]
                fresh = np.concatenate([[True], (p[1:] != p[:-1]) | (d[1:] != d[:-1])]) if len(p) else np.zeros(0, bool)
                places, times = np.unique(p[fresh], return_counts=True)
                bucket = (places >> np.uint64(32)).astype(np.int64)
                for part in np.split(np.arange(len(places)), np.flatnonzero(np.diff(bucket)) + 1) if len(places) else []:
                    tags = (places[part] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()
                    yield _row(_COUNTED, int(bucket[part[0]]), batch.column("block")[i].as_py(), tags, times[part].astype("<u4").tobytes())

    return run


def _arrays(table: pa.Table, field: str, dtype: str) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype) for x in table.column(field).to_pylist()]


def _sharer(hot: int):
    def shared(table: pa.Table) -> pa.Table:
        """Step 1, a bucket: per block its anchors that two documents have."""
        tags, docs = _arrays(table, "tags", "<u4"), _arrays(table, "docs", "<u4")
        every = np.concatenate(tags)
        order = np.argsort(every, kind="stable")
        new = np.concatenate([[True], np.diff(every[order]) != 0])
        sums = np.add.reduceat(np.concatenate(docs).astype(np.int64)[order], np.flatnonzero(new))
        total = np.empty(len(every), np.int64)
        total[order] = sums[np.cumsum(new) - 1]
        out, at = [], 0
        for block, own in zip(table.column("block").to_pylist(), tags):
            n = total[at : at + len(own)]
            at += len(own)
            if (n > 1).any():
                out.append((block, own[n > 1].tobytes(), (n[n > 1] > hot).astype("u1").tobytes()))
        bucket = table.column("bucket")[0].as_py()
        return pa.table([pa.array([bucket] * len(out), pa.int32()), *_columns(out, (pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "block", "tags", "hot"])

    return shared


def _columns(rows: list[tuple], kinds) -> list[pa.Array]:
    return [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]


def _kinds(length: int, buckets: int):
    def run(batches):
        """Step 2: the different fragments of each block."""
        for batch in batches:
            for i in range(batch.num_rows):
                number, block = _opened(batch, i, length, buckets)
                for bucket, part in block.by_bucket(np.arange(len(block.one))):
                    tags = (block.places[part] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()
                    yield _row(_KINDS, bucket, number, tags, block.content[part].tobytes(), block.least[part].tobytes())

    return run


def _judged(table: pa.Table) -> pa.Table:
    """Step 2, a bucket: per fragment of a block 0, _WHOLE (a smaller document has it) or _SORT (its anchor has others, too)."""
    tags = _arrays(table, "tags", "<u4")
    tag, content, doc = np.concatenate(tags), np.concatenate(_arrays(table, "content", "<u8")), np.concatenate(_arrays(table, "docs", "<i8"))
    order = np.lexsort((doc, content, tag))
    t, c, d = tag[order], content[order], doc[order]
    new_tag = np.concatenate([[True], t[1:] != t[:-1]])
    new = new_tag | np.concatenate([[True], c[1:] != c[:-1]])
    kinds = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_tag))[np.cumsum(new_tag) - 1]
    found = np.where(d > d[np.flatnonzero(new)][np.cumsum(new) - 1], _WHOLE, np.where(kinds > 1, _SORT, 0)).astype("u1")
    status = np.empty_like(found)
    status[order] = found
    parts = np.split(status, np.cumsum([len(x) for x in tags])[:-1])
    return pa.table(
        [table.column("bucket").cast(pa.int32()), table.column("block"), pa.array([p.tobytes() for p in parts], pa.binary())], names=["bucket", "block", "status"]
    )


def _texts(length: int, buckets: int):
    grams, _ = _shape(length)
    width = length + grams - 1

    def run(batches):
        """Step 3: bytes of the fragments to sort, aligned at the anchor, zero beyond the fragment."""
        for batch in batches:
            for i in range(batch.num_rows):
                number, block = _opened(batch, i, length, buckets)
                status = _joined(batch.column("status")[i].as_py(), "status", "u1")
                text = np.frombuffer(block.text, np.uint8)
                for bucket, part in block.by_bucket(np.flatnonzero(status == _SORT)):
                    own = block.found.at(block.one[part])
                    lo = grams - 1 - (own.anchor - own.start)
                    at = np.arange(width)
                    rows = text[np.clip(own.anchor[:, None] - (grams - 1) + at, 0, len(text) - 1)]
                    rows[(at < lo[:, None]) | (at >= (lo + own.n + length - 1)[:, None])] = 0
                    places = np.stack([lo, own.n], axis=1).astype("u1")
                    tags = (block.places[part] & np.uint64(0xFFFFFFFF)).astype("<u4")
                    yield _row(_TEXTS, bucket, number, tags.tobytes(), places.tobytes(), block.least[part].tobytes(), rows.tobytes())

    return run


def _sorter(length: int):
    grams, _ = _shape(length)

    def sort(table: pa.Table) -> pa.Table:
        """Step 3, a bucket."""
        tags = _arrays(table, "tags", "<u4")
        places = np.concatenate(_arrays(table, "places", "u1")).reshape(-1, 2).astype(np.int64)
        rows = np.concatenate(_arrays(table, "rows", "u1")).reshape(len(places), length + grams - 1)
        masks = suffix_masks(np.concatenate(tags), places[:, 0], places[:, 1], np.concatenate(_arrays(table, "docs", "<i8")), rows, length)
        parts = np.split(masks.astype("<u4"), np.cumsum([len(x) for x in tags])[:-1])
        return pa.table(
            [table.column("bucket").cast(pa.int32()), table.column("block"), pa.array([p.tobytes() for p in parts], pa.binary())], names=["bucket", "block", "masks"]
        )

    return sort


def _remover(length: int, buckets: int):
    def run(batches):
        """Rows of documents from what was found."""
        for batch in batches:
            for i in range(batch.num_rows):
                _, block = _opened(batch, i, length, buckets)
                status = _joined(batch.column("status")[i].as_py(), "status", "u1")
                masks = np.zeros(len(status), "<u4")
                masks[status == _SORT] = _joined(batch.column("masks")[i].as_py(), "masks", "<u4")
                lost = block.lost(status, masks)
                ids, stops = batch.column("ids")[i].as_py(), np.cumsum(block.sizes)
                spans, kept = [], []
                for stop, size in zip(stops.tolist(), block.sizes.tolist()):
                    own = lost[stop - size : stop]
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
                    spans.append([{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()])
                    text = block.text[stop - size : stop]
                    kept.append(np.frombuffer(text, np.uint8)[~own].tobytes() if len(edges) else text)
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                columns = [pa.array(ids, pa.int64()), pa.array(block.sizes), pa.array(spans, kind), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "spans", "kept"])

    return run


# -- the operator -----------------------------------------------------------------------------------


def _by_block(found: DataFrame, name: str, *fields: str) -> DataFrame:
    """One row per block; what it holds is bounded by the block's text."""
    return found.groupBy("block").agg(F.collect_list(F.struct("bucket", *fields)).alias(name))


def dedup_repeats(docs: DataFrame, length: int = 50, hot: int = 100_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, spans (start, end of the maximal removed runs), kept (the other bytes)."""
    if length < 16:
        raise ValueError("length must be 16 at least")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    name = f"text_blocks_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = rows.mapInArrow(_dealt, "block long, ids array<long>, sizes array<long>, text binary")
    made.write.bucketBy(parts, "block").option("compression", "zstd").option("path", new_path(spark, name)).saveAsTable(name)
    blocks = spark.table(name)
    total = blocks.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n")).first()["n"] or 0
    buckets = max(1, -(-total // _BUCKET_BYTES))

    counted = blocks.mapInArrow(_counter(length, buckets), "bucket int, block long, tags binary, docs binary")
    shared = counted.groupBy("bucket").applyInArrow(_sharer(hot), "bucket int, block long, tags binary, hot binary")
    first = stored(_by_block(shared, "shared", "tags", "hot"), "repeat-shared")
    opened = blocks.join(first.hint("merge"), "block", "left")
    kinds = opened.mapInArrow(_kinds(length, buckets), "bucket int, block long, tags binary, content binary, docs binary")
    judged = kinds.groupBy("bucket").applyInArrow(_judged, "bucket int, block long, status binary")
    second = stored(first.join(_by_block(judged, "status", "status"), "block", "left"), "repeat-status")
    opened = blocks.join(second.hint("merge"), "block", "left")
    texts = opened.mapInArrow(_texts(length, buckets), "bucket int, block long, tags binary, places binary, docs binary, rows binary")
    masks = texts.groupBy("bucket").applyInArrow(_sorter(length), "bucket int, block long, masks binary")
    third = stored(second.join(_by_block(masks, "masks", "masks"), "block", "left"), "repeat-masks")
    opened = blocks.join(third.hint("merge"), "block", "left")
    return opened.mapInArrow(_remover(length, buckets), "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
