"""Grouping of spelling variants: words one edit apart, found on a relational trie.

The trie is a distributed edge table. A search state is (word, position, node, edits, path): the word's first ``position`` characters, with so many edits,
lead to ``node``; ``path`` names the edges that its other characters still need. States without an edit stand on the word's own path, so they are known
from the start. An edit turns them into one-edit states: a changed character by a join with the node's other edges, a deleted one by staying at
the node. Each round joins the one-edit states with the edges of their next level; a state whose path is used up at a word's end has found a neighbour.

* An edit lies in the later half of a word or, read backwards, of the reversed word. So there is one trie of each direction, edits happen only at nodes of half a word's depth, where few words
  share a node, and no state ever fans out at the root. A pair of one length is sought from its smaller word, other pairs from the longer one, so each is found once.
* Below an edit all must match, so the levels there are walked by edges of 1, 2, 4, ... characters: a rest of R characters takes one edge for each bit of R, the largest first. Edges
  and states with the same number of bits meet in one round; rounds grow with the logarithm of the length of words, and each edge is shuffled in one round only.
* A node is the polynomial hash of its prefix modulo 2 ** 64. Found pairs are checked on the words themselves; equal hashes cannot lose a pair, since they merge nodes, never part them.

A word has at most (letters of the alphabet) x (2 x length + 1) neighbours, so no group of words is unbounded; joins are plain shuffled ones, which adaptive execution splits at hot nodes.

Nulls: a null text has no words, a null id counts as empty text in the hash that chooses deletions. Repeated rows count each. Texts of any length are read whole, in pieces that
end between runs. Ties between forms: the smallest word in code-point order. An empty table, or one without words of ``least_count`` occurrences, gives no rows. Only
the id and text columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from llm.common import discard, stored, texts_of

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_PIECE = 1 << 20
_KEPT = 200_000
_FLUSH = 50_000
_CELLS = 1 << 20
_LIST = pa.list_(pa.int64())
_BASE = 0x9B4C_93D1_57E6_2A8D
_STARTS = (0x1234_5678_9ABC_DEF1, 0x0FED_CBA9_8765_4321)  # roots of the forward and the backward trie


def runs(text: str) -> Iterator[Counter]:
    """Occurrences of each run of letters, A-Z lower-cased, of a text's pieces."""
    text = text.encode().lower().decode()  # bytes: only A-Z change
    start = 0
    while start < len(text):
        stop = min(start + _PIECE, len(text))
        cut = _RUN.match(text, stop)
        stop = cut.end() if cut else stop
        yield Counter(_RUN.findall(text, start, stop))
        start = stop


def word_counts(docs: DataFrame, least_length: int = 5, least_count: int = 3, misspell: int = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words with enough code points and occurrences.

    Where ``misspell`` divides the crc32 of "<id>:<run>", the run has lost one code point in that document, as a slip of the pen would.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        counts: dict[str, int] = {}
        for batch in batches:
            for key, text in zip(batch.column("id").to_pylist(), texts_of(batch)):
                seed = zlib.crc32(f"{'' if key is None else key}:".encode())
                for found in runs(text):
                    for word, n in found.items():
                        if len(word) >= least_length:
                            h = zlib.crc32(word.encode(), seed)
                            if h % misspell == 0:
                                word = word[: h % len(word)] + word[h % len(word) + 1 :]
                                if len(word) < least_length:
                                    continue
                            counts[word] = counts.get(word, 0) + n
                    if len(counts) > _KEPT:
                        yield _batch(("word", "n"), (pa.string(), pa.int64()), counts.items())
                        counts.clear()
        if counts:
            yield _batch(("word", "n"), (pa.string(), pa.int64()), counts.items())

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _batch(names: tuple[str, ...], kinds: tuple[pa.DataType, ...], rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=list(names))


def _wide(value: int) -> np.uint64:
    return np.uint64(value & (1 << 64) - 1)


class Paths:
    """Nodes and edges of words of one length in one trie; ``first`` is the depth from which edits may happen."""

    def __init__(self, codes: np.ndarray, backward: bool):
        self.codes = codes[:, ::-1] if backward else codes
        self.length = codes.shape[1]
        self.first = self.length - self.length // 2 if backward else self.length // 2
        self.backward = backward
        self.nodes = np.empty((len(codes), self.length + 1), np.uint64)
        self.nodes[:, 0] = _wide(_STARTS[backward])
        for depth in range(self.length):
            self.nodes[:, depth + 1] = self.nodes[:, depth] * _wide(_BASE) + self.codes[:, depth]

    def edge(self, depth: int) -> tuple[np.ndarray, int]:
        """Steps and length of the edges that the rests of the words from a depth take next."""
        level = (self.length - depth).bit_length() - 1
        own = self.nodes[:, depth + (1 << level)] - self.nodes[:, depth] * _wide(pow(_BASE, 1 << level, 1 << 64))
        return own * np.uint64(67) + np.uint64(level), 1 << level

    def path(self, depth: int) -> np.ndarray:
        """Steps of the rests of the words from a depth, a column for each."""
        columns = []
        while depth < self.length:
            step, length = self.edge(depth)
            columns.append(step)
            depth += length
        return np.stack(columns, axis=1) if columns else np.empty((len(self.codes), 0), np.uint64)

    def is_last_of_equals(self, depth: int) -> np.ndarray:
        """Whether the character is, in reading order, the last of a row of equal ones: deleting any of these gives the same word."""
        other = depth - 1 if self.backward else depth + 1
        return self.codes[:, other] != self.codes[:, depth] if 0 <= other < self.length else np.ones(len(self.codes), bool)


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, code points by row) of the words of each length, a bounded number of characters at a time."""
    lengths = np.array([len(w) for w in words])
    for length in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == length)
        some = max(1, _CELLS // length)
        for start in range(0, len(rows), some):
            part = rows[start : start + some]
            text = "".join([words[i] for i in part]).encode("utf-32-le")
            yield part, np.frombuffer(text, "<u4").reshape(-1, length).astype(np.uint64)


def _column(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    whole = np.concatenate(parts)
    if whole.dtype == np.uint64:
        whole = whole.view(np.int64)
    if whole.ndim == 2:
        offsets = np.arange(len(whole) + 1, dtype=np.int32) * whole.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(whole.ravel()))
    return pa.array(whole).cast(kind)


def _paths(words: DataFrame, rows_of: Callable[[np.ndarray, Paths], Iterator[tuple]], schema: dict[str, pa.DataType]) -> DataFrame:
    """Rows made from the words' ids and forward and backward paths; ``rows_of`` gives arrays of equal length."""

    def run(batches):
        parts, n = [], 0
        for batch in batches:
            for _, codes in by_length(batch.column("word").to_pylist()):
                forward = Paths(codes, False)
                for path in (forward, Paths(codes, True)):
                    for arrays in rows_of(forward.nodes[:, -1], path):
                        parts.append(arrays)
                        n += len(arrays[0])
                        if n >= _FLUSH:
                            yield made(parts)
                            parts, n = [], 0
        if n:
            yield made(parts)

    def made(parts):
        return pa.RecordBatch.from_arrays([_column(c, k) for c, k in zip(zip(*parts), schema.values())], names=list(schema))

    sql = {pa.int64(): "long", pa.int32(): "int", _LIST: "array<long>"}
    return words.select("word").mapInArrow(run, ", ".join(f"{name} {sql[kind]}" for name, kind in schema.items()))


def edges(words: DataFrame, bits: int) -> DataFrame:
    """(node, step, child), each once: the edges that rests of words take when their length has so many bits."""

    def rows_of(_, path):
        for depth in range(path.first, path.length):
            if (path.length - depth).bit_count() == bits:
                step, length = path.edge(depth)
                yield path.nodes[:, depth], step, path.nodes[:, depth + length]

    made = _paths(words, rows_of, {"node": pa.int64(), "step": pa.int64(), "child": pa.int64()})
    return made.groupBy("node", "step").agg(F.min("child").alias("child"))  # the child follows from node and step


def forks(words: DataFrame) -> DataFrame:
    """(node, code, child), each once: the edges of one character at which a word may change."""

    def rows_of(_, path):
        for depth in range(path.first, path.length):
            yield path.nodes[:, depth], path.codes[:, depth], path.nodes[:, depth + 1]

    return _paths(words, rows_of, {"node": pa.int64(), "code": pa.int32(), "child": pa.int64()}).distinct()


def _starts(words: DataFrame, bits: int, deleted: bool) -> DataFrame:
    """(word, position, node, code, path): states about to be edited whose rest, without the character at ``position``, has so many bits in its length."""

    def rows_of(word, path):
        for depth in range(path.first, path.length):
            if (path.length - depth - 1).bit_count() == bits:
                has = path.is_last_of_equals(depth) if deleted else slice(None)
                node = path.nodes[has, depth]
                yield word[has], np.full(len(node), depth, np.int32), node, path.codes[has, depth], path.path(depth + 1)[has]

    return _paths(words, rows_of, {"word": pa.int64(), "position": pa.int32(), "node": pa.int64(), "code": pa.int32(), "path": _LIST})


def edited(words: DataFrame, bits: int, changes: DataFrame) -> DataFrame:
    """(word, node, path): the one-edit states whose rest has so many bits in its length."""
    gone = _starts(words, bits, True).select("word", "node", "path")
    changed = _starts(words, bits, False).select("word", "code", "path", F.col("node").alias("_node"))
    other = changes.select(F.col("node").alias("_at"), F.col("code").alias("_code"), F.col("child").alias("node"))
    changed = changed.join(other.hint("merge"), (F.col("_node") == F.col("_at")) & (F.col("_code") > F.col("code")))
    return gone.unionByName(changed.select("word", "node", "path"))


def neighbours(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): each pair of words (of a table word, n, one row per word) that differ by one edit, once."""
    longest = words.agg(F.max(F.length("word"))).first()[0]
    if longest is None:
        return words.sparkSession.createDataFrame([], "a string, a_n long, b string, b_n long")
    changes = forks(words)
    states = None
    for bits in range((longest // 2 + 1).bit_length(), 0, -1):
        entering = edited(words, bits, changes)
        frontier = entering if states is None else states.unionByName(entering)
        level = edges(words, bits).select(F.col("node").alias("_at"), F.col("step").alias("_step"), "child")
        met = frontier.join(level.hint("merge"), (F.col("node") == F.col("_at")) & (F.col("path")[0] == F.col("_step")))
        states = met.select("word", F.col("child").alias("node"), F.expr("slice(path, 2, size(path))").alias("path"))
    ended = edited(words, 0, changes).select("word", "node")
    ended = ended if states is None else ended.unionByName(states.select("word", "node"))

    def ends_of(word, path):
        yield word, path.nodes[:, -1]

    ends = _paths(words, ends_of, {"other": pa.int64(), "end": pa.int64()})
    pairs = ended.join(ends.hint("merge"), F.col("node") == F.col("end")).select("word", "other").distinct()
    named = _named(words)
    left = named.select(F.col("id").alias("word"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    right = named.select(F.col("id").alias("other"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    found = pairs.join(left.hint("merge"), "word").join(right.hint("merge"), "other")
    return found.where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n")


def _named(words: DataFrame) -> DataFrame:
    """(id, word, n)"""

    def run(batches):
        for batch in batches:
            for rows, codes in by_length(batch.column("word").to_pylist()):
                ids = pa.array(Paths(codes, False).nodes[:, -1].copy().view(np.int64))
                some = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([ids, some.column("word"), some.column("n")], names=["id", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "id long, word string, n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form) rows without a cycle: each round doubles the forms followed."""
    now = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = now.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        joined = now.join(further.hint("merge"), F.col("root") == F.col("_word"), "left")
        then = stored(joined.select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), "spelling-roots")
        discard(now)
        now = then.select("word", "root")
        if not then.where("moved").take(1):
            return now


def variants(docs: DataFrame, least_length: int = 5, least_count: int = 3, ratio: int = 2, misspell: int = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n, n_near, form, form_n, root: one row per word.

    ``form`` is the most frequent neighbour if it occurs at least ``ratio`` (2 or more) times as often as the word; ``root`` is the last word reached over forms.
    """
    words = stored(word_counts(docs, least_length, least_count, misspell, id_col, text_col), "spelling-words")
    pairs = stored(neighbours(words), "spelling-pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    best = both.groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("form"))).alias("best"))
    near = best.select(F.col("a").alias("word"), "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))
    found = words.join(near.hint("merge"), "word", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long")))
    has = F.col("form_n") >= ratio * F.col("n")
    found = stored(found.withColumn("form", F.when(has, F.col("form"))).withColumn("form_n", F.when(has, F.col("form_n"))), "spelling-forms")
    ends = roots(found.where("form IS NOT NULL"))
    return found.join(ends.hint("merge"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
