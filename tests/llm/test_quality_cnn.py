import random

import numpy as np
import zlib

from llm import quality_cnn as Q

rng = random.Random(3)
WORDS = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(400)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def junk(n):
    return " ".join(rng.choice(WORDS) + rng.choice(["!!", "$$$", "###"]) for _ in range(n))


def test_chunks_cover_the_whole_text():
    for n in (0, 1, 511, 512, 513, 896, 897, 5000):
        text = bytes(rng.randrange(256) for _ in range(n))
        chunks = Q.chunks_of(text)
        assert len(chunks) == Q.n_chunks(n)
        whole = np.full((len(chunks) - 1) * Q.STRIDE + Q.CHUNK, -1)
        for i, c in enumerate(chunks):
            whole[i * Q.STRIDE : i * Q.STRIDE + Q.CHUNK] = c
        assert whole[:n].tolist() == list(text) and (whole[n:] == Q.PAD).all()


def test_gradients():
    net = Q.Network.fresh(1, n=4)
    for p in net.parts():
        p += 0.05
    for name in ("embed", "filters", "shift", "weight", "bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    chunks = np.random.default_rng(0).integers(0, 256, (3, Q.CHUNK)).astype(np.int16)
    doc, y = np.array([0, 0, 1]), np.array([1.0, 0.0])

    def loss():
        per = np.bincount(doc)
        z = np.bincount(doc, net.chunk_scores(chunks)) / per
        return float(np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y)))

    for p, g in zip(net.parts(), Q._step(net, chunks, doc, y)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[at]
        p[at] = old + 1e-5
        up = loss()
        p[at] = old - 1e-5
        down = loss()
        p[at] = old
        assert abs((up - down) / 2e-5 - g[at]) < 1e-3 * max(1, abs(g[at]))


def test_held_out_accuracy_and_edge_rows(spark):
    texts = [(i, junk(rng.randrange(20, 400)) if i % 5 == 0 else prose(rng.randrange(20, 400))) for i in range(400)]
    extra = [(1000, None), (1001, ""), (None, "some text"), (1002, prose(20000)), (1, texts[1][1])]
    docs = spark.createDataFrame(texts + extra, "doc_id long, text string").selectExpr("*", "1 AS score", "1 AS y", "0 AS quality")
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(400)] + [(None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    got = Q.classify(docs, labels).collect()
    assert len(got) == len(texts) + len(extra)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 400 and r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert sum(r.predicted == (r.doc_id % 5 > 0) for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert Q.classify(docs.limit(0), labels).count() == 0
    assert {r.score for r in Q.classify(docs.limit(3), labels.limit(0)).collect()} == {0.5}


def test_forward_pass_against_plain_loops():
    """The score of a text from its definition: each filter's best place in each chunk, the mean over chunks."""
    net = Q.Network.fresh(2, d=3, width=4, n=5)
    net.shift[:] = [0.1, -0.2, 0.3, 0.0, -0.1]
    net.prior = 0.25
    for text in (b"", "Ünder the bridge".encode() * 70):
        scores = []
        for start in range(0, max(1, len(text)), Q.STRIDE):
            codes = list(text[start : start + Q.CHUNK])
            codes += [Q.PAD] * (Q.CHUNK - len(codes))
            score = float(net.bias[0])
            for f in range(5):
                best = max(
                    sum(float(net.embed[codes[p + w], k]) * float(net.filters[w * 3 + k, f]) for w in range(4) for k in range(3)) for p in range(Q.CHUNK - 3)
                )
                score += max(best + float(net.shift[f]), 0) * float(net.weight[f])
            scores.append(score)
            if start + Q.CHUNK >= len(text):
                break
        assert np.allclose(net.chunk_scores(Q.chunks_of(text)), scores, atol=1e-4)


def test_long_documents_are_learnt_from_whole_and_held_out_ones_are_told_apart(spark):
    """Junk only in the middle of long documents, where a few chunks of each would not show it."""
    local = random.Random(8)

    def long_text(bad):
        parts = [prose(80) for _ in range(9)]
        for k in local.sample(range(1, 8), 3) if bad else []:
            parts[k] = junk(80)
        return " ".join(parts)

    rows = [(i, long_text(i % 2 == 0)) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    held = [r for r in Q.classify(docs, labels, threshold=0.5).collect() if r.held_out]
    assert len(held) > 10 and sum(r.predicted == r.doc_id % 2 for r in held) >= 0.9 * len(held)
    assert not Q.fit(docs, labels, max_bytes=1000).weight.any()  # no whole document fits
