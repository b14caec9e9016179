"""Log-bilinear neural language model trained in numpy with noise-contrastive estimation.

Tokens are words of a text, lower-cased A-Z and split at ASCII white space, then one end token. Counts of all
training tokens come from one distributed aggregation. The network predicts units: the most frequent words, and classes of all other words
by their last letters. Within a class a word has its smoothed share of the class, with half a count for words never
seen, so the probabilities of all tokens sum to one.

A unit's score is the product of its output vector with the sum of the context's vectors, each scaled by its position, plus a bias.
Training compares each token with noise from the unit frequencies: every partition runs through all its training tokens from the same
start, and the parameters are averaged by tokens seen. Scoring takes the logarithm of the softmax over all units, in blocks of matrix products.

The driver holds at most ``head`` words, the most frequent, and the parameters, both of a fixed size. Words beyond the head meet their counts in a join.

Nulls: a null text counts as empty, one end token; null ids are carried and hashed as empty text. Repeated rows each count and get a row.
Without training tokens every score is 0, as the base's is. An empty table gives no rows. Only the id and text
columns are read, so further columns cannot clash.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from llm.common import crc_mod, stored

END = ""  # no word is empty
_FLUSH = 300_000
_SLICE = 4 << 20
_BATCH = 1024
_BLOCK = 512
_SUFFIX = 3


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts end to end, and where each text's stop; a null text has none."""
    whole = texts.take(pa.array(np.arange(len(texts))))  # a copy from offset 0: ascii_lower misreads sliced arrays
    lists = pc.ascii_split_whitespace(pc.ascii_lower(whole.cast(pa.large_string()).fill_null("")))
    stops, flat = lists.offsets.to_numpy()[1:].astype(np.int64), lists.flatten()
    real = pc.not_equal(flat, "")
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return flat.filter(real), before[stops]


def slices(batch: pa.RecordBatch, size: int = _SLICE):
    """Parts of a batch with about ``size`` bytes of text each, one row at least."""
    lengths = pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // size)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        if b > a:
            yield batch.slice(a, b - a)


def learnable(id_col: str = "doc_id", parts: int = 5, held: int = 1) -> Column:
    """Whether a row may be learnt from; the others are held out."""
    return crc_mod(id_col, parts) != held


def token_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, c) of all tokens, summed in each task before the shuffle."""

    def run(batches):
        texts = 0
        for batch in batches:
            texts += batch.num_rows
            for part in slices(batch):
                found = pc.value_counts(split_words(part.column("text"))[0])
                yield pa.RecordBatch.from_arrays([found.field("values").cast(pa.string()), found.field("counts")], names=["word", "c"])
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([texts], pa.int64())], names=["word", "c"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Units:
    """The network's outputs: the first ``len(words)`` are words, then classes by last letters, the last one for all else."""

    words: dict[str, int]
    classes: dict[str, int]
    size: int
    totals: np.ndarray = field(default_factory=lambda: np.zeros(0))  # count of a word unit, smoothed count of a class

    @classmethod
    def choose(cls, head: list[tuple[str, int]], n_words: int, n_classes: int) -> Units:
        words = {w: i for i, (w, _) in enumerate(head[:n_words])}
        ends = Counter()
        for w, c in head[n_words:]:
            ends[w[-_SUFFIX:]] += c
        ranked = sorted(ends, key=lambda e: (-ends[e], e))[: n_classes - 1]
        return cls(words, {e: len(words) + i for i, e in enumerate(ranked)}, len(words) + len(ranked) + 1)

    def of(self, word: str) -> int:
        found = self.words.get(word)
        return self.classes.get(word[-_SUFFIX:], self.size - 1) if found is None else found


def unit_totals(counts: DataFrame, units: Units) -> np.ndarray:
    """Smoothed counts by unit over the whole vocabulary; classes have half a count more, for words never seen."""

    def run(batches):
        for batch in batches:
            at = [units.of(w) for w in batch.column("word").to_pylist()]
            sums = np.bincount(at, batch.column("c").to_numpy() + 0.5, units.size)
            some = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some])], names=["unit", "total"])

    totals = np.zeros(units.size)
    totals[len(units.words) :] = 0.5
    for r in counts.mapInArrow(run, "unit int, total double").groupBy("unit").agg(F.sum("total").alias("t")).collect():
        totals[r["unit"]] += r["t"]
    return totals


@dataclass
class Encoded:
    """Tokens of texts: words, and of each token its word, its number in the head (-1: none) and its unit; where each text's stop."""

    words: list[str]
    codes: np.ndarray
    number: np.ndarray
    unit: np.ndarray
    stops: np.ndarray


@dataclass
class Model:
    """Vocabulary head, units and parameters; arrays ``base`` and ``inside`` hold log10 terms by head word."""

    head: dict[str, int]
    counts: np.ndarray
    units: Units
    tokens: int
    types: int
    context: np.ndarray  # (units + 1, d): the last row stands before the beginning
    scale: np.ndarray  # (positions, d)
    output: np.ndarray  # (units, d)
    bias: np.ndarray  # (units,)

    def __post_init__(self):
        self.unit_of_head = np.array([self.units.of(w) for w in self.head], np.int32)
        self.denominator = self.tokens + 0.5 * (self.types + 1)
        self.log_totals = np.log10(np.maximum(self.units.totals, 0.5))
        named = self.unit_of_head < len(self.units.words)
        logs = np.log10(self.counts + 0.5) if len(self.counts) else np.zeros(0)
        self.inside = np.where(named, 0.0, logs - self.log_totals[self.unit_of_head]) if len(logs) else logs
        self.base = logs - np.log10(self.denominator)

    def parameters(self) -> list[np.ndarray]:
        return [self.context, self.scale, self.output, self.bias]

    def noise(self) -> np.ndarray:
        return self.units.totals / self.units.totals.sum()

    def encode(self, texts: pa.Array) -> Encoded:
        """Tokens of many texts."""
        words, stops = split_words(texts)
        coded = words.dictionary_encode()
        distinct = [*coded.dictionary.to_pylist(), END]
        number = np.fromiter(map(self.head.get, distinct, repeat(-1)), np.int32, len(distinct))
        unit = self.unit_of_head[number] if len(self.head) else np.zeros(len(distinct), np.int32)
        for i in np.flatnonzero(number < 0):
            unit[i] = self.units.of(distinct[i])
        codes = np.insert(coded.indices.to_numpy(), stops, len(distinct) - 1)
        return Encoded(distinct, codes, number[codes], unit[codes], stops + np.arange(1, len(stops) + 1))

    def contexts(self, found: Encoded) -> np.ndarray:
        """(token, position) units before each token in its text, nearest first."""
        sizes = np.diff(found.stops, prepend=0)
        within = np.arange(len(found.unit)) - np.repeat(found.stops - sizes, sizes)
        out = np.full((len(found.unit), len(self.scale)), self.units.size, np.int32)
        for j in range(1, len(self.scale) + 1):
            out[j:, j - 1] = np.where(within[j:] >= j, found.unit[:-j], self.units.size)
        return out

    def predicted(self, context: np.ndarray) -> np.ndarray:
        out = self.context[context[:, 0]] * self.scale[0]
        for j in range(1, len(self.scale)):
            out += self.context[context[:, j]] * self.scale[j]
        return out

    def unit_log10(self, found: Encoded) -> np.ndarray:
        """log10 probability of each token's unit."""
        contexts, out = self.contexts(found), np.empty(len(found.unit))
        weights = np.concatenate([self.output.T, self.bias[None]])
        ones = np.ones(len(self.bias), np.float32)
        reach = np.sqrt((self.output**2).sum(axis=1).max())
        for i in range(0, len(out), _BLOCK):
            target = found.unit[i : i + _BLOCK]
            r = self.predicted(contexts[i : i + _BLOCK])
            scores = np.concatenate([r, np.ones((len(r), 1), np.float32)], axis=1) @ weights
            if np.sqrt((r * r).sum(axis=1).max()) * reach + np.abs(self.bias).max() > 60:  # else no exponential can overflow
                scores -= scores.max(axis=1, keepdims=True)
            picked = scores[np.arange(len(target)), target]
            out[i : i + _BLOCK] = picked - np.log(np.exp(scores, out=scores) @ ones)
        return out / np.log(10)


class Trainer:
    """Noise-contrastive estimation by Adagrad; one set of noise draws serves a batch."""

    def __init__(self, model: Model, seed: int, draws: int, rate: float):
        self.model, self.draws, self.rate = model, draws, rate
        self.rng = np.random.default_rng(seed)
        noise = model.noise()
        self.ladder = np.cumsum(noise)
        self.log_noise = np.log(np.maximum(noise, 1e-30) * draws).astype(np.float32)
        self.squares = [np.full(p.shape, 1e-3, np.float32) for p in model.parameters()]
        self.contexts, self.targets, self.waiting, self.seen = [], [], 0, 0

    def add(self, found: Encoded) -> None:
        self.contexts.append(self.model.contexts(found))
        self.targets.append(found.unit)
        self.waiting += len(found.unit)
        if self.waiting >= 8 * _BATCH:
            self.flush()

    def flush(self) -> None:
        if self.waiting:
            contexts, targets = np.concatenate(self.contexts), np.concatenate(self.targets)
            for i in range(0, len(targets), _BATCH):
                self.step(contexts[i : i + _BATCH], targets[i : i + _BATCH])
            self.seen += len(targets)
        self.contexts, self.targets, self.waiting = [], [], 0

    def gradients(self, context: np.ndarray, target: np.ndarray, drawn: np.ndarray) -> list[np.ndarray]:
        """Of the mean log-likelihood of telling tokens from noise."""
        m = self.model
        r = m.predicted(context)
        out, others = m.output[target], m.output[drawn]
        true = np.einsum("bd,bd->b", r, out) + m.bias[target] - self.log_noise[target]
        false = r @ others.T + (m.bias[drawn] - self.log_noise[drawn])
        up = 1 / (1 + np.exp(true))
        down = -1 / (1 + np.exp(-false))
        d_r = up[:, None] * out + down @ others
        size, d = m.output.shape
        d_out = _scattered(target, up[:, None] * r, size) + _scattered(drawn, down.T @ r, size)
        d_bias = np.bincount(target, up, size) + np.bincount(drawn, down.sum(axis=0), size)
        d_scale = np.stack([(d_r * m.context[context[:, j]]).sum(axis=0) for j in range(len(m.scale))])
        d_context = _scattered(context.T.ravel(), (d_r * m.scale[:, None, :]).reshape(-1, d), size + 1)
        return [g / len(target) for g in (d_context, d_scale, d_out, d_bias)]

    def step(self, context: np.ndarray, target: np.ndarray) -> None:
        drawn = np.minimum(np.searchsorted(self.ladder, self.rng.random(self.draws)), len(self.ladder) - 1)
        for p, s, g in zip(self.model.parameters(), self.squares, self.gradients(context, target, drawn)):
            g = g.astype(np.float32)
            s += g * g
            p += self.rate * g / np.sqrt(s)


def _scattered(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of rows by their index."""
    d = rows.shape[1]
    return np.bincount((at[:, None] * d + np.arange(d)).ravel(), rows.ravel(), size * d).reshape(size, d)


def _summed(batches):
    """One row per task: the sum of the parameters, each times its tokens."""
    total, weight = None, 0
    for batch in batches:
        for seen, blob in zip(batch.column("seen").to_pylist(), batch.column("blob").to_pylist()):
            values = np.frombuffer(blob, np.float64)
            total, weight = values if total is None else total + values, weight + seen
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([weight], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["seen", "blob"])


def train(
    docs: DataFrame, model: Model, seed: int = 0, draws: int = 24, rate: float = 0.3, passes: int = 1, text_col: str = "text"
) -> Model:
    """Run through all texts ``passes`` times, the same number for every corpus.

    After each pass the partitions' parameters are averaged by tokens seen.
    """
    spark = docs.sparkSession
    for number in range(passes):
        start = spark.sparkContext.broadcast(model)

        def run(batches, number=number, start=start):
            own = start.value
            own = Model(own.head, own.counts, own.units, own.tokens, own.types, *(p.copy() for p in own.parameters()))
            trainer = Trainer(own, seed + 7919 * number + TaskContext.get().partitionId(), draws, rate)
            for batch in batches:
                for part in slices(batch):
                    trainer.add(own.encode(part.column("text")))
            trainer.flush()
            if trainer.seen:
                flat = np.concatenate([p.ravel() for p in own.parameters()]).astype(np.float64) * trainer.seen
                yield pa.RecordBatch.from_arrays([pa.array([trainer.seen], pa.int64()), pa.array([flat.tobytes()], pa.binary())], names=["seen", "blob"])

        schema = "seen long, blob binary"
        sums = docs.select(F.col(text_col).alias("text")).mapInArrow(run, schema).repartition(16).mapInArrow(_summed, schema).collect()
        seen = sum(r["seen"] for r in sums)
        if not seen:
            return model
        flat = sum(np.frombuffer(r["blob"], np.float64) for r in sums) / seen
        parameters, at = [], 0
        for p in model.parameters():
            parameters.append(flat[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        model = Model(model.head, model.counts, model.units, model.tokens, model.types, *parameters)
    return model


def most_frequent(counts: DataFrame, most: int) -> list[tuple[str, int]]:
    """The most frequent words, at most ``most``, in order; words of about equal count are all in or all out.

    Counts are first summed up on a scale of sixteenths of powers of two, so that no more than ``most`` words reach the driver.
    """
    step = F.floor(F.log2("c") * 16).cast("int")
    number, least = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["step"]):
        number += r["n"]
        if number > most:
            break
        least = r["step"]
    found = counts.where(step >= least).collect() if least is not None else []
    return sorted(((r["word"], r["c"]) for r in found), key=lambda w: (-w[1], w[0]))


def fit(
    docs: DataFrame, counts: DataFrame, head: int = 100_000, n_words: int = 96, n_classes: int = 160, d: int = 16, positions: int = 3, seed: int = 0, **options
) -> Model:
    """Train on all of ``docs``, whose token counts are ``counts``."""
    size = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("tokens"), F.count("*").alias("types")).first()
    top = most_frequent(counts, head)
    units = Units.choose(top, n_words, n_classes)
    units.totals = unit_totals(counts, units)
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    share = units.totals / units.totals.sum()
    start = [draw(units.size + 1, d), np.full((positions, d), positions**-0.5, np.float32), draw(units.size, d), np.log(np.maximum(share, 1e-30)).astype(np.float32)]
    words = {w: i for i, (w, _) in enumerate(top)}
    model = Model(words, np.array([c for _, c in top], float), units, size["tokens"], size["types"], *start)
    return train(docs, model, seed, **options)


def score(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of each row: log10 of the unigram's and the model's probability of the text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m, part, number = shared.value, TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            for rows in slices(batch):
                found = m.encode(rows.column("text"))
                known, sizes = found.number >= 0, np.diff(found.stops, prepend=0)
                first = found.stops - sizes
                head = np.where(known, found.number, 0)
                inside = np.where(known, m.inside[head], -m.log_totals[found.unit]) if len(m.head) else -m.log_totals[found.unit]
                base = np.where(known, m.base[head], -np.log10(m.denominator)) if len(m.head) else np.full(len(known), -np.log10(m.denominator))
                keys = part + number + np.arange(len(sizes))
                number += len(sizes)
                sums = [np.add.reduceat(x, first) for x in (known.astype(np.int64), base, m.unit_log10(found) + inside)]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *map(pa.array, (keys, sizes, *sums)), pa.nulls(len(keys), pa.string()), pa.nulls(len(keys), pa.int64())], names=names)
                doc = np.repeat(np.arange(len(sizes)), sizes)[~known]
                pairs, times = np.unique(doc * len(found.words) + found.codes[~known].astype(np.int64), return_counts=True)
                words = pa.array(found.words).take(pa.array(pairs % len(found.words)))
                absent = [pa.nulls(len(pairs), rows.column("doc_id").type), pa.array(keys[pairs // len(found.words)])]
                absent += [pa.nulls(len(pairs), t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([*absent, words, pa.array(times)], names=names)

    names = ["doc_id", "key", "n_tokens", "n_known", "base_score", "score", "word", "n"]
    schema = f"doc_id {kind}, key long, n_tokens long, n_known long, base_score double, score double, word string, n long"
    both = stored(rows.mapInArrow(run, schema), "lm-scores")
    tail = both.where("word IS NOT NULL").select("key", "word", "n").join(counts, "word", "left")
    logs = tail.groupBy("key").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("logs"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known")
    )
    rest = both.where("word IS NULL").drop("word", "n").join(logs, "key", "left")
    return rest.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        (F.col("base_score") + F.coalesce("logs", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("logs", F.lit(0.0))).alias("score"),
    )


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Learn from the rows open to learning and score all: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    open_rows = docs.where(learnable(id_col)).select(F.col(text_col).alias("text"))
    counts = stored(token_counts(open_rows), "lm-counts")
    model = fit(open_rows, counts, **options)
    found = score(docs, model, counts, id_col, text_col)
    return found.select(
        "doc_id", (~learnable()).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
