import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from llm import byte_bpe as B

RANKS = P.path("byte_bpe_50k.tiktoken")
TOKENS = B.read_ranks(RANKS)
REFERENCE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(TOKENS)}, special_tokens={})
CODEC = B.Codec(B.serialise(TOKENS), P.PATTERN)


def ids_of(text):
    return np.frombuffer(b"".join(CODEC.encode(text)), "<u4").tolist()


CASES = ["", " ", "\n\n  a", "Hello world's", "<unk> <s> </s> <|endoftext|>", "⁇unknown⁇ ▁x", "żółć 漢字 😀👩‍👩‍👧", "a" * 3000, "\x00\x01", "x1234567y", "  \t lots   of space  "]


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    assert ids_of(text) == REFERENCE.encode_ordinary(text)


@settings(max_examples=400, deadline=None)
@given(st.text())
def test_any_text_encodes_alike_and_comes_back(text):
    assert ids_of(text) == REFERENCE.encode_ordinary(text)
    assert b"".join(map(CODEC.decode, CODEC.encode(text))) == text.encode()


def test_every_token_alone():
    for i, token in enumerate(TOKENS):
        try:
            text = token.decode()
        except UnicodeDecodeError:
            continue
        assert ids_of(text) == REFERENCE.encode_ordinary(text)


def test_table(spark):
    texts = [(1, "one two"), (1, "one two"), (2, None), (3, ""), (None, "Straße " * 50_000)]
    rows = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS n_tokens", "2 AS ids")
    got = B.encoded(rows, RANKS, P.PATTERN).collect()
    assert len(got) == 5
    want = {i: REFERENCE.encode_ordinary(t or "") for i, t in texts}
    for r in got:
        assert np.frombuffer(r.ids, "<u4").tolist() == want[r.doc_id]
        assert bytes(r.decoded).decode() == (dict(texts)[r.doc_id] or "")
    assert B.encoded(rows.limit(0), RANKS, P.PATTERN).count() == 0
