import random
import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from llm import neural_lm as L

rng = random.Random(5)
TONGUES = [["".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) for _ in range(80)] for letters in ("abcd", "wxyz")]


def text():
    words = rng.choice(TONGUES)
    return " ".join(words[min(int(rng.expovariate(0.1)), 79)] for _ in range(rng.randrange(5, 60)))


def words_of(t):
    return [*(w.decode() for w in (t or "").encode().lower().split()), L.END]


@settings(deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(), st.sampled_from([" a\tB\x0bc\x0cd\x1ce\xa0f ", "\r\n", "É\x85É"]))))
def test_words(texts):
    want = [words_of(t)[:-1] for t in texts]
    for column in (pa.array(texts, pa.string()), pa.array(["Some É words", *texts, "x"], pa.string()).slice(1, len(texts))):
        words, stops = L.split_words(column)
        assert words.to_pylist() == sum(want, []) and stops.tolist() == np.cumsum([len(w) for w in want]).tolist()


def test_gradients():
    units = L.Units({"a": 0, "b": 1}, {"x": 2}, 4, np.array([5.0, 3.0, 2.0, 1.0]))
    g = np.random.default_rng(0)
    model = L.Model({}, np.zeros(0), units, 9, 3, g.standard_normal((5, 3)), g.standard_normal((2, 3)), g.standard_normal((4, 3)), g.standard_normal(4))
    trainer = L.Trainer(model, 0, 4, 0.1)
    context, target, drawn = np.array([[0, 4], [1, 0], [3, 2]]), np.array([1, 2, 0]), np.array([0, 1, 1, 3])

    def gain():
        r = model.predicted(context)
        true = (r * model.output[target]).sum(axis=1) + model.bias[target] - trainer.log_noise[target]
        false = r @ model.output[drawn].T + model.bias[drawn] - trainer.log_noise[drawn]
        return (-np.log1p(np.exp(-true)).sum() - np.log1p(np.exp(false)).sum()) / len(target)

    for p, grad in zip(model.parameters(), trainer.gradients(context, target, drawn)):
        for at in np.ndindex(p.shape):
            old = p[at]
            p[at] = old + 1e-6
            up = gain()
            p[at] = old - 1e-6
            down = gain()
            p[at] = old
            assert abs((up - down) / 2e-6 - grad[at]) < 1e-4


def test_scores_against_brute_force(spark):
    texts = [(i, text()) for i in range(600)] + [(900, None), (901, ""), (None, "never seen"), (1, "abc"), (902, "The É the")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS c", "3 AS score").repartition(3)
    got = L.scored(docs, head=40, n_words=20, n_classes=6, passes=8).collect()
    assert len(got) == len(texts)
    learnt = [t for i, t in texts if zlib.crc32(str("" if i is None else i).encode()) % 5 != 1]
    counts = Counter(w for t in learnt for w in words_of(t))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t in texts:
        words = words_of(t)
        base = sum(log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        want[i, len(words), sum(counts[w] > 0 for w in words), n, round(base, 6)] += 1
    assert want == Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held) + 0.05 * sum(r.n_tokens for r in held)


def test_probabilities_sum_to_one_and_documents_add_up(spark):
    docs = spark.createDataFrame([(i, text()) for i in range(200)], "doc_id long, text string")
    counts = L.stored(L.token_counts(docs), "counts")
    model = L.fit(docs, counts, head=30, n_words=15, n_classes=5)
    known = {r.word: r.c for r in counts.collect()}
    totals = np.zeros(model.units.size)
    for w, c in known.items():
        totals[model.units.of(w)] += c + 0.5

    def units_after(before):
        context = ([model.units.size] * 3 + [model.units.of(w) for w in before])[-3:][::-1]
        z = sum(model.context[c] * model.scale[j] for j, c in enumerate(context)) @ model.output.T + model.bias
        p = np.exp(z - z.max())
        return p / p.sum()

    def probability(word, before):
        unit, p = model.units.of(word), units_after(before)
        return p[unit] if unit < len(model.units.words) else p[unit] * (known.get(word, 0) + 0.5) / (totals[unit] + 0.5)

    before = ["one", next(iter(known))]
    first = len(model.units.words)
    unseen = (units_after(before)[first:] * 0.5 / (totals[first:] + 0.5)).sum()
    assert abs(sum(probability(w, before) for w in known) + unseen - 1) < 1e-5
    text_ = docs.first().text + " " + "unheard"
    words = words_of(text_)
    want = sum(log10(probability(w, words[:i])) for i, w in enumerate(words))
    got = L.score(spark.createDataFrame([(1, text_)], "doc_id long, text string"), model, counts).first()
    assert abs(got.score - want) < 1e-3


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert L.scored(none).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    got = L.scored(spark.createDataFrame([(held, "a b")], none.schema)).first()
    assert (got.held_out, got.n_tokens, got.n_known, got.train_tokens, got.base_score, round(got.score, 6)) == (True, 3, 0, 0, 0.0, 0.0)
