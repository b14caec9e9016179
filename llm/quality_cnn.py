"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover the whole of it. Each chunk's bytes are
embedded, filters slide over them, each filter's largest response in the chunk is kept, and a chunk's score is linear in these;
the mean of the chunk scores through a logistic function is the probability of label 1.

Training is on the driver, on whole documents: of each label at most ``max_per_class`` labelled ones and ``max_bytes``, a bounded sample in the order
of a hash of the id. The classes' true ratio among the rows open to learning is restored
by the bias. Scoring is one Arrow pass over all rows.

Nulls: a null text counts as empty, one chunk of padding, and gets a score; null ids are carried; labels other than 0 and 1 teach nothing.
Repeated rows each get a row and, if labelled, teach once. With one class or none to learn from, the
score is that class's rate (one half if none). An empty table gives no rows. Only the named columns are read, so further columns
cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from llm.common import bytes_of, crc_mod, release_memory

CHUNK = 512
STRIDE = 384
PAD = 256
_BLOCK = 32


@dataclass
class Network:
    """Parameters; ``prior`` is added to the logit."""

    embed: np.ndarray  # (257, d)
    filters: np.ndarray  # (width * d, n)
    shift: np.ndarray  # (n,)
    weight: np.ndarray  # (n,)
    bias: np.ndarray  # (1,)
    prior: float = 0.0

    @classmethod
    def fresh(cls, seed: int, d: int = 4, width: int = 8, n: int = 32) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        return cls(draw(PAD + 1, d, scale=1.0), draw(width * d, n, scale=(width * d) ** -0.5), np.zeros(n, np.float32), draw(n, scale=n**-0.5), np.zeros(1, np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.shift, self.weight, self.bias]

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        """(chunk, position, width * d) embedded bytes under each filter position, as a view."""
        d = self.embed.shape[1]
        flat = self.embed[chunks].reshape(len(chunks), -1)
        return np.lib.stride_tricks.sliding_window_view(flat, len(self.filters), axis=1)[:, ::d]

    def responses(self, chunks: np.ndarray) -> np.ndarray:
        """(chunk, position, filter)"""
        under = self.windows(chunks)
        return (np.ascontiguousarray(under).reshape(-1, under.shape[2]) @ self.filters).reshape(*under.shape[:2], -1)

    def chunk_scores(self, chunks: np.ndarray) -> np.ndarray:
        out = np.empty(len(chunks))
        for i in range(0, len(chunks), _BLOCK):
            pooled = np.maximum(self.responses(chunks[i : i + _BLOCK]).max(axis=1) + self.shift, 0)
            out[i : i + _BLOCK] = pooled @ self.weight + self.bias
        return out


def chunks_of(text: bytes, at: np.ndarray | None = None) -> np.ndarray:
    """Chunks as rows of byte values, padded at the end; all of them, or those numbered ``at``."""
    count = n_chunks(len(text))
    padded = np.full((count - 1) * STRIDE + CHUNK, PAD, np.int16)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    found = np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STRIDE]
    return found if at is None else found[at]


def n_chunks(length: int) -> int:
    return 1 + max(0, -(-(length - CHUNK) // STRIDE))


def _step(net: Network, chunks: np.ndarray, doc: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean log loss; ``doc`` numbers the document of each chunk. Chunks are taken in blocks, so a long document needs little memory."""
    blocks = [slice(i, i + _BLOCK) for i in range(0, len(chunks), _BLOCK)]
    seen = []
    for block in blocks:
        response = net.responses(chunks[block])
        best = response.argmax(axis=1)  # (chunk, filter)
        seen.append((best, np.take_along_axis(response, best[:, None, :], axis=1)[:, 0] + net.shift))
    scores = np.concatenate([np.maximum(top, 0) @ net.weight + net.bias for _, top in seen])
    per = np.bincount(doc, minlength=len(y))
    logit = np.bincount(doc, scores, len(y)) / per
    err = ((1 / (1 + np.exp(-logit)) - y) / (per * len(y)))[doc].astype(np.float32)
    total = [np.zeros(p.shape) for p in net.parts()]
    for block, (best, top) in zip(blocks, seen):
        for sums, part in zip(total, _gradients(net, chunks[block], best, top, err[block])):
            sums += part
    return total


def _gradients(net: Network, chunks: np.ndarray, best: np.ndarray, top: np.ndarray, err: np.ndarray) -> list[np.ndarray]:
    d_top = err[:, None] * net.weight * (top > 0)
    under = net.windows(chunks)[np.arange(len(chunks))[:, None], best]  # (chunk, filter, width * d)
    d_filters = np.einsum("cf,cfw->wf", d_top, under)
    d = net.embed.shape[1]
    width = len(net.filters) // d
    at = chunks[np.arange(len(chunks))[:, None, None], best[:, :, None] + np.arange(width)]  # bytes under the best positions
    back = d_top[:, :, None] * net.filters.T  # (chunk, filter, width * d)
    d_embed = np.stack([np.bincount(at.ravel(), back[:, :, k::d].ravel(), PAD + 1) for k in range(d)], axis=1)
    return [d_embed, d_filters, d_top.sum(axis=0), err @ np.maximum(top, 0), np.array([err.sum()])]


def train(sample: list[tuple[int, bytes]], seed: int = 0, passes: int = 6, rate: float = 0.01, batch: int = 32, least_steps: int = 900) -> Network:
    """Fit by Adam to (label, text) of documents, all chunks of each, the classes weighed alike."""
    net = Network.fresh(seed)
    rng = np.random.default_rng(seed)
    moments = [[np.zeros(p.shape), np.zeros(p.shape)] for p in net.parts()]
    of = [[i for i, (label, _) in enumerate(sample) if label == c] for c in (0, 1)]
    size = max(map(len, of))
    per_pass = max(1, -(-2 * size // batch))
    passes = max(passes, -(-least_steps // per_pass))
    t, steps = 0, passes * per_pass
    for _ in range(passes):
        order = rng.permutation(np.concatenate([np.resize(rng.permutation(c), size) for c in of]))
        for i in range(0, len(order), batch):
            picked = [(sample[j][0], chunks_of(sample[j][1])) for j in order[i : i + batch]]
            doc = np.repeat(np.arange(len(picked)), [len(c) for _, c in picked])
            grads = _step(net, np.concatenate([c for _, c in picked]), doc, np.array([y for y, _ in picked], float))
            t += 1
            for p, g, (m, v) in zip(net.parts(), grads, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def learnable(id_col: str = "doc_id", parts: int = 4, held: int = 2) -> Column:
    """Whether a row may be learnt from; the others are held out."""
    return crc_mod(id_col, parts) != held


def fit(docs: DataFrame, labels: DataFrame, max_per_class: int = 3000, max_bytes: int = 32 << 20, seed: int = 0) -> Network:
    """Train on labelled documents (labels: doc_id, quality) that are open to learning.

    The sample is bounded in rows and bytes of each class: labelled rows in the order of a hash of their ids, as long as both bounds hold. Sampled documents are learnt from whole.
    """
    marked = labels.select("doc_id", F.col("quality").cast("int").alias("y")).where(learnable() & F.col("y").isin(0, 1))
    counts = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = [marked.where(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_class) for c in (0, 1)]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")
    sizes = rows.select("doc_id", "y", F.octet_length("text").alias("bytes"), F.md5("text").alias("md5"))
    chosen = []
    for c in (0, 1):
        first = sizes.where(F.col("y") == c).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "md5").limit(max_per_class).collect()
        chosen += [r for r, total in zip(first, accumulate(r["bytes"] for r in first)) if total <= max_bytes]
    wanted = docs.sparkSession.createDataFrame([(r["doc_id"], r["y"], r["md5"]) for r in chosen], "doc_id long, y int, md5 string")
    whole = rows.withColumn("md5", F.md5("text")).join(F.broadcast(wanted), ["doc_id", "y", "md5"], "left_semi").distinct()
    found = sorted((r["doc_id"], r["y"], r["text"].encode()) for r in whole.collect())
    sample = [(y, t) for _, y, t in found]
    if {y for y, _ in sample} != {0, 1}:
        only = Network.fresh(seed)
        only.weight[:] = 0
        only.prior = {(0,): -20.0, (1,): 20.0}.get(tuple({y for y, _ in sample}), 0.0)
        return only
    net = train(sample, seed)
    net.prior = float(np.log(counts[1] / counts[0]))
    return net


def score(docs: DataFrame, net: Network, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of each row and its score between 0 and 1."""
    rows = docs.select(*dict.fromkeys((*keep, text_col)))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, counts = np.zeros(batch.num_rows), np.ones(batch.num_rows)
            held, owners, size = [], [], 0

            def flush():
                nonlocal held, owners, size
                if held:
                    np.add.at(totals, np.concatenate(owners), net.chunk_scores(np.concatenate(held)))
                held, owners, size = [], [], 0

            for i, text in enumerate(bytes_of(batch, text_col)):
                found = chunks_of(text)
                counts[i] = len(found)
                for j in range(0, len(found), 512):
                    held.append(found[j : j + 512])
                    owners.append(np.full(len(held[-1]), i))
                    size += len(held[-1])
                    if size >= 512:
                        flush()
            flush()
            logit = np.clip(totals / counts + net.prior, -500, 500)
            columns = [batch.column(k) for k in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(1 / (1 + np.exp(-logit)))], names=[*keep, "score"])
            del columns, batch
            release_memory()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return rows.mapInArrow(run, f"{fields}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= threshold) of each row."""
    found = score(docs, fit(docs, labels, **options))
    return found.select("doc_id", (~learnable()).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
