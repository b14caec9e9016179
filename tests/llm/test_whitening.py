import math
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from llm import whitening
from llm.registry import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def symmetric(seed, n, values=None):
    rng = np.random.default_rng(seed)
    basis = np.linalg.qr(rng.standard_normal((n, n)))[0]
    values = rng.standard_normal(n) if values is None else np.array(values, float)
    return (basis * values) @ basis.T


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 30))
def test_eigenvalues_and_vectors_of_random_matrices(seed, n):
    a = symmetric(seed, n)
    a = (a + a.T) / 2
    k = min(n, 7)
    values, vectors = whitening.principal(a, k)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:k], atol=1e-12)
    assert np.allclose(a @ vectors, vectors * values, atol=1e-11)
    assert np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-11)


@pytest.mark.parametrize("values", [[3, 3, 3, 1, 1, 0, 0], [1] * 6, [0] * 4, [5, 5 - 1e-12, 5 - 2e-12, 2, 1], [1e12, 1, 1e-3]])
def test_clusters_and_rank(values):
    for a in (symmetric(1, len(values), values), np.diag(np.array(values, float))):
        got, vectors = whitening.principal((a + a.T) / 2, len(values))
        top = max(map(abs, values)) or 1
        assert np.allclose(got, sorted(values, reverse=True), atol=1e-12 * top)
        assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-10)
        assert np.abs(a @ vectors - vectors * got).max() <= 1e-11 * top


def brute(vectors, k=16):
    """Distinct vectors, their sums and numpy's own eigenvectors."""
    x = {i: [math.floor(64 * float(c)) + 1_000_000 for c in v] for i, v in vectors}
    distinct = np.array(sorted({tuple(math.floor(64 * float(c)) + 1_000_000 for c in v) for _, v in vectors}))
    n, sums = len(distinct), distinct.sum(axis=0)
    centred = distinct - sums / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    white = {i: (np.array(v) - sums / n) @ basis / np.sqrt(values) for i, v in x.items()}
    deviation = {i: sum((n * a - int(s)) ** 2 for a, s in zip(v, sums)) for i, v in x.items()}
    return n, deviation, white, values / np.trace(centred.T @ centred / n)


def test_query_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(3)
    kept = [(i, [float(np.float32(c)) for c in rng.standard_normal(20) * np.linspace(1, 3, 20)]) for i in range(150)]
    kept += [(i + 1000, kept[0][1]) for i in range(100)] + [(7, kept[3][1])]
    bad = [(5000, None), (5001, [None] * 20), (5002, [math.nan] * 20), (5003, [1.0] * 19 + [math.inf]), (5004, []), (5005, [1.0])]
    spark.createDataFrame([(i, v, None) for i, v in kept + bad], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = QUERIES["op11_whitening"](spark, str(tmp_path)).collect()
    assert len(rows) == len(kept) * 16
    n, deviation, white, explained = brute(kept)
    signs = {}
    for r in rows:
        if r.vec_id != 7:  # the id of two vectors
            want = white[r.vec_id][r.component - 1]
            assert (r.n, r.deviation) == (n, deviation[r.vec_id])
            assert abs(abs(r.whitened) - abs(want)) < 1e-8
            if abs(want) > 1e-6:
                assert signs.setdefault(r.component, np.sign(want * r.whitened)) == np.sign(want * r.whitened)
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9
        assert r.identity_error < 1e-9
    assert len(signs) == 16


def test_empty_low_rank_and_large_numbers(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.whitened(empty).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, None, 1)], SCHEMA)).count() == 0
    one = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0], 1), (None, [1.0, 2.0], 1)], SCHEMA)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(c, 1, 0, None, None, None) for _ in range(2) for c in (1, 2)]
    line = whitening.whitened(spark.createDataFrame([(i, [float(i), 2.0 * i], 1) for i in range(5)], SCHEMA)).collect()
    assert [r.whitened is None for r in sorted(line, key=lambda r: (r.component, r.vec_id))] == [False] * 5 + [True] * 5
    wide = spark.createDataFrame([(1, [2.0**40, 0.0], "x"), (2, [-(2.0**40), 1.0], "y"), (3, [2.0**60, 0.0], "z")], "vec_id long, embedding array<double>, n string")
    got = {r.vec_id: r.deviation for r in whitening.whitened(wide).collect()}
    a, b = [2**46, 0], [-(2**46), 64]
    assert got == {1: Decimal(sum((2 * p - p - q) ** 2 for p, q in zip(a, b))), 2: Decimal(sum((2 * q - p - q) ** 2 for p, q in zip(a, b)))}
