from itertools import product

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from llm import packing as K

PATH = P.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(PATH)
WORDS = K.Words(open(PATH, encoding="utf-8").read())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=8), st.sampled_from([" ", "\n", "\x1c", "́", " ", "Σ", "it's", "It's.", "!!", "a!?", ".", "word,", "$$$", 'a".', "(b).", "<|endoftext|>", "<|", "ǅ", "H\u0331", "İ", "éÉ", "日本"])), max_size=12).map("".join))
def test_ids_are_the_tokenizers(text):
    want = PLAIN.encode(text, add_special_tokens=False).ids
    ids, stops = WORDS.encode([text, "", text], np.array([1], WORDS.dtype).tobytes())
    assert ids.tolist() == [*want, 1, 1, *want, 1]
    assert stops.tolist() == [len(want) + 1, len(want) + 2, 2 * len(want) + 3]


def test_hilbert_curve_visits_neighbours_in_turn():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        points = np.array(list(product(range(1 << bits), repeat=dims)))
        keys = K.hilbert_keys(points, bits)
        assert sorted(keys.tolist()) == list(range(len(points)))
        steps = np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


def test_pieces_hold_each_id_once_and_sequences_are_full(spark):
    texts = [(i, f"words of text number {i} " * (i % 40)) for i in range(120)] + [(500, None), (500, None), (None, "no id"), (501, "a b c d e " * 3000), (502, "")]
    rows = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS ids", "3 AS start").repartition(5)
    got = K.pack(rows, PATH, length=256).collect()
    by_sequence = {}
    for r in got:
        assert r.length * 4 == len(r.ids) and 0 < r.length <= 256
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for k, pieces in by_sequence.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 256 or k == len(by_sequence) - 1
    for i, text in texts:
        want = PLAIN.encode(text or "", add_special_tokens=False).ids + [1]
        own = sorted((r.start, r.ids) for r in got if r.doc_id == i)
        copies = sum(j == i for j, _ in texts)
        assert {r.doc_tokens for r in got if r.doc_id == i} == {len(want)}
        if copies == 1:
            assert np.frombuffer(b"".join(x for _, x in own), "<u4").tolist() == want
        else:
            assert len(own) == copies
    assert K.pack(rows.limit(0), PATH).count() == 0
