import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from llm import best_fit
from llm.registry import QUERIES

PLAIN = Tokenizer.from_file(P.path("word_bpe_49k.json"))
PATH = P.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids string, sequence_id int"


def check(rows, docs, length, end):
    """Every document once, whole and in order; sequences gapless and not too long. Returns the number of sequences."""
    texts = [np.array([*PLAIN.encode(t or "", add_special_tokens=False).ids, end], "<u4") for _, t in docs]
    wanted = sorted((d is None, d or 0, p, s, len(ids[s : s + length]), zlib.crc32(ids[s : s + length].tobytes())) for (d, _), ids in zip(docs, texts) for p, s in enumerate(range(0, len(ids), length)))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == wanted
    spans = defaultdict(list)
    for r in rows:
        spans[r.sequence_id].append((r.offset, r.offset + r.length))
    for held in spans.values():
        at = 0
        for a, b in sorted(held):
            assert a == at
            at = b
        assert at <= length
    return len(spans), sum(len(t) for t in texts)


def corpus(seed, n):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(["alpha", "Übermut", "x.y", "der", "Haus,"]) for _ in range(int(rng.expovariate(1 / 60))))) for i in range(n)]


def test_query(spark, tmp_path):
    docs = [*corpus(1, 200), (None, None), (900, ""), (900, ""), (901, "word " * 7000), (902, "word " * 2047), (903, "word " * 2048)]
    spark.createDataFrame([(d, t, "x", 1) for d, t in docs], SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op13_best_fit_packing"](spark, str(tmp_path)).collect()
    n, tokens = check(rows, docs, 2048, 0)
    assert n <= -(-tokens // 2048) + 2


def test_few_sequences_over_many_tasks_and_ids_kept(spark):
    docs = corpus(2, 600)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], SCHEMA).repartition(12)
    rows = best_fit.pack(df, PATH, length=256, end_id=5, open_bins=64, window=128).collect()
    n, tokens = check(rows, docs, 256, 5)
    assert n <= 1.03 * tokens / 256 + 1
    for r in rows:
        ids = np.frombuffer(r.ids, "<u2").astype("<u4")
        assert len(ids) == r.length and zlib.crc32(ids.tobytes()) == r.ids_crc32
    assert len({r.sequence_id for r in rows}) == n


def test_empty_table(spark):
    assert best_fit.pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(1, 6), st.integers(1, 9))
def test_bins_against_a_plain_search(sizes, limit, window):
    """The same bins as a search through a list of open ones: least room that is enough, the last put back among equals; the fullest closes first."""
    bins, closed = best_fit.OpenBins(40, limit), []
    for i, size in enumerate(sizes):
        closed += list(bins.put(size, i))
        assert bins.open <= limit
    state, done = [], []  # [free, items], in the order in which they were put back
    for i, size in enumerate(sizes):
        fits = [b for b in state if b[0] >= size]
        if fits:
            room = min(b[0] for b in fits)
            chosen = [b for b in state if b[0] == room][-1]
            state.remove(chosen)
        else:
            if len(state) == limit and size < 40:
                least = min(b[0] for b in state)
                full = [b for b in state if b[0] == least][-1]
                state.remove(full)
                done.append(full[1])
            chosen = [40, []]
        chosen = [chosen[0] - size, [*chosen[1], (40 - chosen[0], i)]]
        (done.append(chosen[1]) if chosen[0] == 0 else state.append(chosen))
    assert closed == done
    assert sorted(b for _, b in bins.rest()) == sorted(b for _, b in state)
    rows = list(best_fit.packed(((i, 0, 0, s) for i, s in enumerate(sizes)), 40, limit, window, 40))
    assert sorted(item[0] for _, _, item in rows) == list(range(len(sizes)))
    filled = defaultdict(int)
    for sequence, offset, item in rows:
        assert offset == filled[sequence]
        filled[sequence] += item[3]
    assert all(f <= 40 for f in filled.values())
