import random
import re
import zlib
from collections import Counter

import pytest

from llm import spelling
from llm.registry import QUERIES

SCHEMA = "doc_id long, text string, lang string, n long, word string"


def brute_counts(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    counts = brute_counts(rows)
    around = {w: [v for v in counts if near(w, v)] for w in counts}
    forms = {}
    for w, found in around.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out[w] = (counts[w], len(around[w]), forms[w], counts[forms[w]] if forms[w] else None, root)
    return out


def corpus(seed, size=400):
    """Documents of words over a small alphabet, so that many are close, with equal letters in rows."""
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abÀÿé") for _ in range(rng.randint(4, 9))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "abababab", "bababab", "×÷×÷×"]
    rows = []
    for i in range(size):
        words = []
        for _ in range(rng.randint(0, 40)):
            w = stems[min(int(rng.expovariate(0.08)), len(stems) - 1)]
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcÿ") + w[k:], w[:k] + rng.choice("abcé") + w[k + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
        rows.append((i * 7919, rng.choice([" ", ", ", "-", "1"]).join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_query_against_brute_force(spark, tmp_path, seed):
    rows = corpus(seed) + [(None, "Ünder ünder ünder undeR"), (5, None), (6, ""), (9, "word " * 3), (9, "words " * 3), (9, "words " * 3)]
    rows += [(20 + i, "chain " * 100 + "chainx " * 30 + "chainxy " * 10 + "chainxyz " * 4) for i in range(3)]
    spark.createDataFrame([(i, t, "en", 1, "x") for i, t in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op12_spelling"](spark, str(tmp_path)).collect()
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in got} == brute(rows)
    assert len(got) == len({r.word for r in got}) and any(r.root not in (r.word, r.form) for r in got)


def test_every_pair_of_long_and_short_words_once(spark):
    rng = random.Random(4)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(5, 8))) for _ in range(150)}
    base = "".join(rng.choice("abc") for _ in range(700))
    for k in (0, 1, 349, 350, 351, 698, 699):
        words |= {base[:k] + base[k + 1 :], base[:k] + "d" + base[k + 1 :], base[:k] + "d" + base[k:]}
    words |= {base, base + "a", "b" + base}
    found = spelling.neighbours(spark.createDataFrame([(w, 3) for w in words], "word string, n long")).collect()
    pairs = [tuple(sorted((r.a, r.b))) for r in found]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(a, b) for a in words for b in words if a < b and near(a, b)}


def test_empty_tables_and_no_words(spark):
    for rows in ([], [(1, None, "en", 1, "x")], [(1, "a bc, 12", "en", 1, "x")], [(1, "alone alone", "en", 1, "x")]):
        assert spelling.variants(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_one_word_without_neighbours(spark):
    docs = spark.createDataFrame([(1, "alone alone alone", "en", 1, "x")], SCHEMA)
    (row,) = spelling.variants(docs).collect()
    assert tuple(row) == ("alone", 3, 0, None, None, "alone")


def test_runs_of_long_texts_are_cut_between_runs(monkeypatch):
    text = "Alpha beta, gammaÀ " * 40 + "x" * 300
    whole = Counter(re.findall("[a-zà-ÿÀ-ÿ]+", text.encode().lower().decode()))
    monkeypatch.setattr(spelling, "_PIECE", 7)
    assert sum(spelling.runs(text), Counter()) == whole
