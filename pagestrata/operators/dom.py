"""Pages to nodes, and selectors as expressions over a page's node array.

``with_nodes`` adds three columns to a page table: ``nodes`` (array of structs
in document order), ``canon_html`` and ``page_text``, both as UTF-8 bytes.  ``nodes[i].node_id`` is
``i``, and the descendants of a node are the slice right behind it, so tree
questions are slices and comparisons inside one row: selecting and extracting
from pages never shuffles, however large one site is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

import pagestrata
from pagestrata.functions.markup import Reader
from pagestrata.functions.text import quoted, sql_trim
from pagestrata.rules import Sel

# The reader travels inside the task, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(pagestrata)

_OFFSETS = ("html_start", "inner_start", "inner_end", "html_end", "text_start", "text_end")
_INTS = ("node_id", "parent_id", "last_desc_id", "depth")

NODE_TYPE = T.StructType(
    [T.StructField(n, T.IntegerType()) for n in _INTS]
    + [
        T.StructField("tag", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("classes", T.ArrayType(T.StringType())),
    ]
    + [T.StructField(n, T.IntegerType()) for n in _OFFSETS]
    + [T.StructField("digest", T.BinaryType())]
)
# Pages are read and handed on in pieces of about this many bytes, so that a task holds the nodes of one piece, whatever a batch has.
_PIECE_BYTES = 500_000


def _list_array(lengths: Sequence[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(list(accumulate(lengths, initial=0)), pa.int32()), values)


def _byte_places(text: str) -> np.ndarray | None:
    """Byte offset of each character offset; None where they are equal."""
    if text.isascii():
        return None
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return np.concatenate([[0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))])


def _offsets(pages: list[list], readers: list[Reader], name: str) -> pa.Array:
    """Byte offsets of all nodes into the page's markup or text, so that a cut copies only what it returns."""
    parts = []
    for nodes, reader in zip(pages, readers):
        places = _byte_places(reader.text if name.startswith("text") else reader.canon)
        own = np.array([getattr(n, name) for n in nodes], np.int32)
        parts.append(own if places is None or not len(own) else places[own].astype(np.int32))
    return pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32))


def _node_arrays(pages: list[list], readers: list[Reader]) -> pa.Array:
    flat = [node for page in pages for node in page]
    attrs = [n.attrs or {} for n in flat]
    classes = [a["class"].split() if "class" in a else [] for a in attrs]
    map_offsets = pa.array(list(accumulate(map(len, attrs), initial=0)), pa.int32())
    keys = pa.array([k for a in attrs for k in a], pa.string())
    values = pa.array([v for a in attrs for v in a.values()], pa.string())
    columns = [pa.array([getattr(n, name) for n in flat], pa.int32()) for name in _INTS]
    columns += [
        pa.array([n.tag for n in flat], pa.string()),
        pa.MapArray.from_arrays(map_offsets, keys, values),
        _list_array(list(map(len, classes)), pa.array([c for cs in classes for c in cs], pa.string())),
    ]
    columns += [_offsets(pages, readers, name) for name in _OFFSETS]
    columns += [pa.array([n.digest for n in flat], pa.binary())]
    structs = pa.StructArray.from_arrays(columns, names=NODE_TYPE.fieldNames())
    return _list_array(list(map(len, pages)), structs)


def _pieces(sources: pa.Array) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, length in enumerate(pc.binary_length(sources.cast(pa.large_binary())).to_pylist()):
        size += length or 0
        if size >= _PIECE_BYTES:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(sources):
        yield start, len(sources)


def with_nodes(
    df: DataFrame,
    html: str = "html",
    only_if: str | None = None,
    tags: Sequence[str] | None = None,
    texts: bool = True,
) -> DataFrame:
    """Read the markup of every page once.

    ``only_if`` names a boolean column; pages where it is not true get no
    nodes.  ``tags`` keeps nodes of these tags only (then ids are no positions).
    ``texts=False`` leaves out ``canon_html`` and ``page_text``.
    """
    kept = frozenset(tags) if tags else None
    schema = T.StructType(
        df.schema.fields
        + [T.StructField("nodes", T.ArrayType(NODE_TYPE))]
        + ([T.StructField("canon_html", T.BinaryType()), T.StructField("page_text", T.BinaryType())] if texts else [])
    )

    def read_piece(piece: pa.RecordBatch) -> pa.RecordBatch:
        sources = piece.column(html).to_pylist()
        if only_if is not None:
            sources = [s if w else None for s, w in zip(sources, piece.column(only_if).to_pylist())]
        readers = [Reader().read(s or "") for s in sources]
        nodes = [[n for n in r.nodes if kept is None or n.tag in kept] for r in readers]
        arrays = [*piece.columns, _node_arrays(nodes, readers)]
        names = [*piece.schema.names, "nodes"]
        if texts:
            arrays += [pa.array([r.canon.encode() for r in readers], pa.binary())]
            arrays += [pa.array([r.text.encode() for r in readers], pa.binary())]
            names += ["canon_html", "page_text"]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in _pieces(batch.column(html)):
                yield read_piece(batch.slice(start, stop - start))
            del batch
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(read, schema)


def node_table(df: DataFrame, *keys: str) -> DataFrame:
    """One row per node of a page table that has ``nodes``."""
    return df.select(*keys, F.inline("nodes"))


# -- selectors --------------------------------------------------------------


def _attribute_test(n: str, attribute: str, operator: str, value: str | None) -> str:
    if operator == "~=":
        return f"array_contains({n}.classes, {quoted(value)})"
    got = f"{n}.attrs[{quoted(attribute)}]"
    if operator == "has":
        return f"{got} IS NOT NULL"
    if operator == "=":
        return f"{got} <=> {quoted(value)}"
    name = {"^=": "startswith", "*=": "contains"}[operator]
    return f"coalesce({name}({got}, {quoted(value)}), false)"


def sql_matches(sel: Sel, n: str, nodes: str = "nodes", text: str = "page_text") -> str:
    """SQL predicate: node ``n`` of ``nodes`` matches the selector."""
    terms = [f"{n}.tag = {quoted(sel.tag)}"] if sel.tag else []
    terms += [_attribute_test(n, *test) for test in sel.tests]
    if sel.child_of:
        terms.append(f"coalesce({sql_matches(sel.child_of, f'get({nodes}, {n}.parent_id)', nodes, text)}, false)")
    if sel.under:
        up = re.sub(r"\W+", "_", n) + "_up"
        inside = f"{up}.node_id < {n}.node_id AND {up}.last_desc_id >= {n}.node_id"
        terms.append(f"exists({nodes}, {up} -> {inside} AND {sql_matches(sel.under, up, nodes, text)})")
    if sel.holding:
        low = re.sub(r"\W+", "_", n) + "_low"
        below = f"slice({nodes}, {n}.node_id + 2, {n}.last_desc_id - {n}.node_id)"
        terms.append(f"exists({below}, {low} -> {sql_matches(sel.holding, low, nodes, text)})")
    if sel.text:
        terms.append(f"contains(lower({sql_raw_text(n, text)}), {quoted(sel.text.lower())})")
    return "(" + " AND ".join(terms) + ")"


def sql_matches_any(sels: Sequence[Sel], n: str, nodes: str = "nodes", text: str = "page_text") -> str:
    return "(" + " OR ".join(sql_matches(s, n, nodes, text) for s in sels) + ")"


def sql_select(sels: Sequence[Sel], among: str = "nodes", nodes: str = "nodes", n: str = "n") -> str:
    """Array of the nodes in ``among`` that match any selector, in document order."""
    return f"filter({among}, {n} -> {sql_matches_any(sels, n, nodes)})"


def sql_ordered_first(sels: Sequence[Sel], among: str = "nodes", nodes: str = "nodes") -> str:
    """First node of the first selector with any hit; ``{rank, node_id}`` or null."""
    ranks = " ".join(f"WHEN {sql_matches(s, 'n', nodes)} THEN {i}" for i, s in enumerate(sels))
    hits = f"filter(transform({among}, n -> struct(CASE {ranks} END AS rank, n.node_id AS node_id)), h -> h.rank IS NOT NULL)"
    return f"array_min({hits})"


def sql_let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is then computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def sql_below(node: str, nodes: str = "nodes") -> str:
    """Descendants of a node."""
    return f"slice({nodes}, {node}.node_id + 2, {node}.last_desc_id - {node}.node_id)"


def sql_inside(n: str, outer: str) -> str:
    """Node ``n`` lies strictly below ``outer``; null if there is no outer node."""
    return f"({n}.node_id > {outer}.node_id AND {n}.node_id <= {outer}.last_desc_id)"


def sql_inner_html(n: str) -> str:
    return f"CAST(substring(canon_html, {n}.inner_start + 1, {n}.inner_end - {n}.inner_start) AS STRING)"


def sql_text_bytes(n: str, text: str = "page_text") -> str:
    return f"substring({text}, {n}.text_start + 1, {n}.text_end - {n}.text_start)"


def sql_raw_text(n: str, text: str = "page_text") -> str:
    return f"CAST({sql_text_bytes(n, text)} AS STRING)"


def sql_text(n: str, text: str = "page_text") -> str:
    """Trimmed text of a node."""
    return sql_trim(sql_raw_text(n, text))
