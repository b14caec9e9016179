import random

import xxhash

from llm import simhash_dedup as S


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({k: " " for k in (9, 10, 11, 12, 13)}).split(" ") if w]
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(p.encode(), 42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(ids, near):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and near(i, j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_fingerprints_match_brute_force(spark):
    texts = [None, "", "  \t", "One", "one TWO", "É A b c d", "a b c", "a b c a b c a b c", "x " * 70000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in S.fingerprints(rows).collect():
        assert r.fp & (1 << 64) - 1 == brute_fingerprint(texts[r.doc_id]), r.doc_id


def classes_of(spark, values, pair_limit, distance=2):
    rows = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in sorted(set(values))], "fp long")
    found = S.components(S.links(rows, distance, pair_limit)).collect()
    return {r.node: r.root for r in found}


def test_components_match_brute_force_with_and_without_hot_groups(spark):
    rng = random.Random(1)
    values = [0, 1 << 63, (1 << 64) - 1]
    for _ in range(25):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([2, 3, 12])):
            v = base
            for _ in range(rng.randrange(5)):
                v ^= 1 << rng.randrange(64)
            values.append(v)
    signed = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    for distance in (0, 1, 2):
        want = brute_classes(signed, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= distance)
        for pair_limit in (2, 32) if distance == 2 else (32,):
            got = classes_of(spark, values, pair_limit, distance)
            assert {v: got.get(v, v) for v in signed} == want


def test_documents_nulls_ties_repeats_and_clashing_columns(spark):
    base = " ".join(f"w{i}" for i in range(400))
    texts = [(3, base), (1, base), (1, base), (5, base + " tail"), (None, base), (7, None), (9, ""), (8, "entirely other words here")]
    rows = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS component_id", "3 AS n")
    got = S.near_duplicates(rows).collect()
    fp = {i: brute_fingerprint(t) for i, (_, t) in enumerate(texts)}
    assert len(got) == len(texts)
    near = fp[0] ^ fp[3]
    want = {3: 1, 1: 1, None: 1, 7: 7, 9: 7, 8: 8, 5: 1 if near.bit_count() <= 2 else 5}
    assert {r.doc_id: r.component_id for r in got} == want
    assert S.near_duplicates(rows.limit(0)).count() == 0
