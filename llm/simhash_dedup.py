"""SimHash near-dedup by deletion-variant signatures.

A 64-bit fingerprint is cut into floor(d / 2) + 1 segments, so few that of two fingerprints at most d
bits apart one segment differs by one bit at most. Each segment is indexed once per bit position
with that bit blanked; an equality join of these variants gives every pair, and the pairs are verified.
For even d the last segment is indexed whole: if all others differ by two bits, none are left for it.

Equal fingerprints are one row from the start. Where more than ``pair_limit`` different fingerprints
share a variant their pairs are not listed: fingerprints at most two bits apart have a common value
at most one bit from both, and any two within one bit of a value are linked, so each is hung on the
least that shares such a value. That gives the same components without pairs.

Nulls: a null text counts as empty; fingerprint zero, linked like any other. Null ids are carried
and never name a component unless all its ids are null. Repeated rows are copies. Empty table: no rows.
Only the id and text columns are read, so further columns cannot clash.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from llm.common import bytes_of, map_arrow, stored, with_hot
from llm.components import components

SEED = 42
BITS = 64
_CHUNK = 1 << 15


def simhash(text: bytes, shingle: int = 3) -> int:
    """Fingerprint of a text: a bit is 1 if set in over half the hashes of its word shingles."""
    words = text.lower().split()  # bytes: only A-Z change, only ASCII white space separates
    if not words:
        return 0
    width = min(shingle, len(words))
    n = len(words) - width + 1
    ones = np.zeros(BITS, np.int64)
    for start in range(0, n, _CHUNK):
        stop = min(n, start + _CHUNK)
        parts = zip(*(words[start + k : stop + k] for k in range(width)))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, parts), repeat(SEED)), "<u8", stop - start)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (ones * 2 > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of each row; fp is the fingerprint's bits as a signed long."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batch):
        found = pa.array((simhash(t, shingle) for t in bytes_of(batch)), pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), found], names=["doc_id", "fp"])

    return map_arrow(rows, run, "doc_id long, fp long")


def variants(fps: DataFrame, max_distance: int = 2) -> DataFrame:
    """(tag, value, fp): the index entries of each fingerprint."""
    count = max_distance // 2 + 1
    width = BITS // count
    entries = []
    for s in range(count):
        value = F.col("fp") if count == 1 else F.shiftrightunsigned("fp", s * width).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        last_whole = max_distance % 2 == 0 and s == count - 1
        for bit in range(1 if last_whole else width):
            blank = value if last_whole else value.bitwiseAND(F.lit(~(1 << bit) if bit < 63 else (1 << 63) - 1).cast("long"))
            entries.append(F.struct(F.lit(s * width + bit).cast("short").alias("tag"), blank.alias("value")))
    return fps.select("fp", F.explode(F.array(*entries)).alias("e")).select("e.tag", "e.value", "fp")


def _ends(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that at least two fingerprints share: their number, the least and the largest."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")


def _near(max_distance: int):
    return (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance) & (F.col("a") != F.col("b"))


def links(fps: DataFrame, max_distance: int = 2, pair_limit: int = 32) -> DataFrame:
    """(a, b) links whose components are those of all pairs at most ``max_distance`` (0 to 2) bits apart.

    ``fps`` holds each fingerprint once. Every returned link is verified; pairs are left out only in
    groups of over ``pair_limit``, where the links above stand for them.
    """
    if max_distance not in (0, 1, 2):
        raise ValueError("max_distance must be 0, 1 or 2")
    index = variants(fps, max_distance)
    shared = stored(_ends(index, "tag", "value"), "simhash-shared")
    pairs = shared.where("n = 2").select("a", "b").where(_near(max_distance))
    members = stored(index.join(shared.where("n > 2").select("tag", "value", "n"), ["tag", "value"]), "simhash-members")
    few = members.where(F.col("n") <= pair_limit).select("tag", "value", "fp")
    listed = few.select("tag", "value", F.col("fp").alias("a")).join(few.select("tag", "value", F.col("fp").alias("b")), ["tag", "value"])
    listed = listed.where("a < b").select("a", "b").where(_near(max_distance))
    many = members.where(F.col("n") > pair_limit).select("fp").distinct()
    return pairs.unionByName(listed).unionByName(_hung(many)).distinct()


def _hung(fps: DataFrame) -> DataFrame:
    """(a, b): each fingerprint with the least that lies within one bit of a common value."""
    around = [F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << bit if bit < 63 else -(1 << 63)).cast("long")) for bit in range(BITS))]
    values = fps.select("fp", F.explode(F.array(*around)).alias("value"))
    shared = _ends(values, "value")
    return values.join(shared.select("value", "a"), "value").where("fp <> a").select("a", F.col("fp").alias("b"))


def near_duplicates(
    docs: DataFrame, max_distance: int = 2, shingle: int = 3, pair_limit: int = 32, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the least id reachable by links)."""
    rows = stored(fingerprints(docs, shingle, id_col, text_col), "simhash")
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "simhash-distinct")
    total = rows.count()
    found = components(links(fps.select("fp"), max_distance, pair_limit))
    placed = fps.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = placed.select("fp", "root", "n").join(named, "root").select("fp", "component_id", "n")
    return with_hot(rows, classes, "fp", "n", total)
