import random

import pytest

from llm import repeat_dedup as R

SCHEMA = "doc_id long, text string"


def brute(rows, length):
    """Each window against the least id that has it."""
    least = {}
    order = lambda i: float("inf") if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            least[w] = min(least.get(w, float("inf")), order(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        lost = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if least[b[k : k + length]] < order(i):
                lost[k : k + length] = b"\1" * length
        spans, at = [], 0
        for k in range(len(b) + 1):
            if (k == len(b) or not lost[k]) and k > at:
                spans.append((at, k))
            if k == len(b) or not lost[k]:
                at = k + 1
        out.append((i, len(b), tuple(spans), bytes(x for x, gone in zip(b, lost) if not gone)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcé ü") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [prose(rng.randrange(8, 40)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            s = rng.choice(shared)
            a = rng.randrange(len(s) // 2)
            parts.append(rng.choice([s, s[a:], s[:-a] if a else s, prose(rng.randrange(2, 30)), s[:a] + "X" + s[a:]]))
        rows.append((rng.randrange(1000), "".join(parts)))
    return rows


def have(spark, rows, **options):
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS block", "2 AS bucket", "3 AS ids").repartition(4)
    got = R.dedup_repeats(frame, **options).collect()
    return sorted(((r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in got), key=repr)


@pytest.mark.parametrize(("length", "hot"), [(50, 100_000), (50, 3), (20, 2)])
def test_matches_brute_force(spark, length, hot):
    rows = corpus(length + hot) + [(5, "a" * 300), (6, "a" * 120), (7, "ab" * 100), (8, "ba" * 60), (9, "short"), (10, None), (11, "")]
    rows += [(None, rows[0][1]), (None, rows[1][1]), (rows[2][0], rows[2][1]), (2000, "z" * 49), (2001, "z" * 50), (2002, "z" * 50)]
    assert have(spark, rows, length=length, hot=hot) == sorted(brute(rows, length), key=repr)


def test_many_blocks_and_buckets_agree(spark, monkeypatch):
    rows = corpus(1) + [(3000 + i, "common passage that many documents share, word for word, at length " + str(i) * 9) for i in range(80)]
    want = sorted(brute(rows, 50), key=repr)
    monkeypatch.setattr(R, "_BUCKET_BYTES", 2000)
    assert have(spark, rows) == want


def test_empty_and_long(spark):
    assert R.dedup_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    text = "".join(random.Random(0).choice("abcdefghijklmnop") for _ in range(3_000_000))
    got = have(spark, [(1, text), (2, "x" + text[1_000_000:2_000_000] + "y")])
    assert [(d, n, s) for d, n, s, _ in got] == [(1, 3_000_000, ()), (2, 1_000_002, ((1, 1_000_001),))]


def test_masks_of_aligned_suffixes():
    import numpy as np

    rng = np.random.default_rng(0)
    length, (grams, _) = 50, R._shape(50)
    rows = rng.integers(0, 2, (200, length + grams - 1)).astype(np.uint8)
    rows[:, 20:60] = rows[0, 20:60]
    lo = rng.integers(0, grams, 200)
    n = np.array([rng.integers(1, grams - x + 1) for x in lo])
    at = np.arange(rows.shape[1])
    rows[(at < lo[:, None]) | (at >= (lo + n + length - 1)[:, None])] = 0
    tag, doc = rng.integers(0, 2, 200).astype(np.uint32), rng.integers(0, 50, 200)
    got = R.suffix_masks(tag, lo, n, doc, rows, length)
    for i in range(200):
        for c in range(grams):
            inside = lo[i] <= c < lo[i] + n[i]
            same = [j for j in range(200) if inside and tag[j] == tag[i] and lo[j] <= c < lo[j] + n[j] and (rows[j, c : c + length] == rows[i, c : c + length]).all()]
            assert bool(got[i] >> c & 1) == any(doc[j] < doc[i] for j in same)
