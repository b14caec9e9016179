"""Best-fit packing of documents into sequences of a bounded number of tokens, in bounded space.

Every task packs the documents it tokenises as they come. A fixed number of sequences (bins) is open; a bitset has one bit for each amount of free space that an open bin has, so the bin with the least
room that is enough is found by a shift and the lowest bit. If none has room a new bin opens, and where that would be one too many the fullest closes first. Pieces wait in a
window of bounded size and enter the longest first, which leaves short ones to fill gaps. Only documents longer than a sequence are cut.

A bin's pieces are written when it closes. What is left open and rather empty at the end of a task is written without a sequence; those pieces, a bounded number of bins per task, are dealt to few
tasks, in proportion to their tokens, and packed once more. So no tokens are shuffled but these, and a lost task is run again by itself. The first pass is written to the shared
folder, since both kinds of rows are read from it.

Nulls: a null text counts as empty, which is the end token alone; null ids are carried. Repeated rows are packed each by itself. Equal lengths keep the order of rows.
An empty table gives no rows. Only the id and text columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from llm.common import release_memory, stored, texts_of
from llm.packing import SLICE, words_of

_FLUSH = 1 << 22
_FIELDS = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids": pa.binary(), "ids_crc32": pa.int64()}
_PLACE = {"sequence_id": pa.int64(), "offset": pa.int64()}
_SQL = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
SCHEMA = ", ".join(f"{name} {_SQL[kind]}" for name, kind in {**_FIELDS, **_PLACE}.items())


class OpenBins:
    """At most ``limit`` open bins of ``length``, found by their free space."""

    def __init__(self, length: int, limit: int):
        self.length, self.limit = length, limit
        self.free = 0  # bit f: some open bin has f free
        self.bins: dict[int, list[list]] = {}
        self.open = 0

    def _take(self, free: int) -> list:
        held = self.bins[free]
        found = held.pop()
        if not held:
            self.free &= ~(1 << free)
        self.open -= 1
        return found

    def put(self, size: int, item) -> Iterator[list]:
        """Place an item; gives the bins that this closes, as lists of (offset, item)."""
        fits = self.free >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.open == self.limit and size < self.length:
                yield self._take((self.free & -self.free).bit_length() - 1)
            free, bin_ = self.length, []
        bin_.append((self.length - free, item))
        free -= size
        if not free:
            yield bin_
        else:
            self.bins.setdefault(free, []).append(bin_)
            self.free |= 1 << free
            self.open += 1

    def rest(self) -> Iterator[tuple[int, list]]:
        """(free space, bin) of the open bins, the fullest first."""
        for free in sorted(self.bins):
            for bin_ in self.bins[free]:
                yield free, bin_


def packed(pieces: Iterator[tuple], length: int, open_bins: int, window: int, settled: int) -> Iterator[tuple[int | None, int | None, tuple]]:
    """(sequence, offset, piece) of pieces, rows of _FIELDS; both are null where a bin is left with over ``settled`` free."""
    bins, sequence = OpenBins(length, open_bins), 0

    def windows():
        held = []
        for piece in pieces:
            held.append(piece)
            if len(held) == window:
                yield sorted(held, key=lambda p: -p[3])
                held = []
        yield sorted(held, key=lambda p: -p[3])

    for held in windows():
        for piece in held:
            for closed in bins.put(piece[3], piece):
                for offset, item in closed:
                    yield sequence, offset, item
                sequence += 1
    for free, left in bins.rest():
        for offset, item in left:
            yield (sequence, offset, item) if free <= settled else (None, None, item)
        sequence += 1


def _batches(rows: Iterator[tuple[int | None, int | None, tuple]], level: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches of placed pieces; a sequence's number holds the level, the task and its number there."""
    first = (TaskContext.get().partitionId() * 2 + level) << 32
    kinds = [*_FIELDS.values(), *_PLACE.values()]

    def made(held):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=[*_FIELDS, *_PLACE])

    held, size = [], 0
    for sequence, offset, piece in rows:
        held.append((*piece, None if sequence is None else first + sequence, offset))
        size += len(piece[4]) + 64
        if size > _FLUSH:
            yield made(held)
            held, size = [], 0
    if held:
        yield made(held)


def _cut(doc_id: int | None, ids: np.ndarray, length: int) -> Iterator[tuple]:
    for piece, start in enumerate(range(0, len(ids), length)):
        own = ids[start : start + length]
        yield doc_id, piece, start, len(own), own.tobytes(), zlib.crc32(own.astype("<u4").tobytes())


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    length: int = 2048,
    end_id: int = 0,
    open_bins: int = 2048,
    window: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces: doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset.

    ``ids`` are little-endian unsigned integers of 2 bytes, or 4 where the vocabulary needs them; ``ids_crc32`` is taken of the form of 4 bytes. Sequence numbers are distinct but have gaps.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    settled = length // 32
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def pieces(batches):
        words = words_of(shared.value)
        end = np.array([end_id], words.dtype).tobytes()
        for batch in batches:
            texts, size, start = [], 0, 0
            for i, text in enumerate(texts_of(batch)):
                texts.append(text)
                size += len(text)
                if size > SLICE or i + 1 == batch.num_rows:
                    ids, stops = words.encode(texts, end)
                    for doc_id, own in zip(batch.column("doc_id").slice(start, len(texts)).to_pylist(), np.split(ids, stops[:-1])):
                        yield from _cut(doc_id, own, length)
                    texts, size, start = [], 0, i + 1
                    del ids
                    release_memory()

    def first(batches):
        yield from _batches(packed(pieces(batches), length, open_bins, window, settled), 0)

    def again(batches):
        found = (row for batch in batches for row in zip(*(batch.column(name).to_pylist() for name in _FIELDS)))
        yield from _batches(packed(found, length, open_bins, window, length), 1)

    placed = stored(rows.mapInArrow(first, SCHEMA), "best-fit")
    left = placed.where("sequence_id IS NULL").select(*_FIELDS)
    tokens = left.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = 1 + tokens // (length * open_bins)
    ordered = left.repartition(tasks).sortWithinPartitions(F.xxhash64("doc_id", "piece"), "doc_id", "piece", "ids")
    return placed.where("sequence_id IS NOT NULL").unionByName(stored(ordered.mapInArrow(again, SCHEMA), "best-fit-left"))
