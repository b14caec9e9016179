import random

import corpus_pipeline as C
import numpy as np
import public_tokenizers as P
from llm import secret_scan, simhash_dedup
from tests.llm.test_packing import PLAIN
from tests.llm.test_simhash_dedup import brute_classes, brute_fingerprint

rng = random.Random(9)
WORDS = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(300)]


def prose():
    return " ".join(rng.choice(WORDS) for _ in range(rng.randrange(40, 200)))


def test_stages_take_effect_and_match_plain_python(spark, tmp_path):
    texts = {i: prose() if i % 6 else " ".join(w + "!!" for w in prose().upper().split()) for i in range(150)}
    texts |= {200: texts[1], 201: texts[1], 202: texts[2] + "\n", 203: 'x token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ' + texts[3], 204: None}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i % 6 > 0), 0) for i in range(150)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now, after = docs, {}
    for name, stage in C.STAGES:
        now = C.stored(stage(spark, now, str(tmp_path)), name)
        after[name] = now.collect()
        if name != "packing":
            assert now.columns == docs.columns and now.schema == docs.schema, name
    kept = {r.doc_id for r in after["quality"]}
    assert not {i for i in range(150) if i % 6 == 0} & kept and {i for i in texts if i < 150 and i % 6} | {200, 201, 202, 203} <= kept
    left = {r.doc_id: r.text for r in after["exact_dedup"]}
    assert set(left) == kept - {1, 200}
    fps = {i: brute_fingerprint(t) for i, t in left.items()}
    classes = brute_classes(list(left), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    alone = {r.doc_id: r.text for r in after["simhash_dedup"]}
    assert set(alone) == set(classes.values()) and 202 not in alone
    clean = {r.doc_id: r for r in after["secrets"]}
    assert set(clean) == set(alone)
    for i, r in clean.items():
        assert r.text == (None if alone[i] is None else secret_scan.redact(alone[i]))
        assert r.n_chars == len(r.text or "")
    assert "04dbeb" not in clean[203].text if 203 in clean else True
    for i, r in clean.items():
        pieces = sorted((p.start, p.ids) for p in after["packing"] if p.doc_id == i)
        assert np.frombuffer(b"".join(x for _, x in pieces), "<u4").tolist() == PLAIN.encode(r.text or "", add_special_tokens=False).ids + [1]
    assert simhash_dedup.BITS == 64 and P.PATTERN


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, folder, docs, labels):
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_run_packs_what_the_stages_keep(spark, tmp_path):
    good = [(i, prose(), "en", "s", None) for i in range(60)]
    bad = [(100 + i, " ".join(w + "!!" for w in prose().upper().split()), None, None, 3) for i in range(60)]
    write(spark, tmp_path, [*good, *bad, (None, good[0][1], None, None, None), (500, "x " * 60_000, "en", "s", 1)], [(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(60)])
    pieces = C.run(spark, str(tmp_path)).collect()
    kept = {p.doc_id for p in pieces}
    assert len(kept & set(range(60))) >= 57 and not kept & {100 + i for i in range(60)}
    for i in kept & set(range(60)):
        ids = PLAIN.encode(secret_scan.redact(good[i][1]), add_special_tokens=False).ids + [1]
        own = sorted((p.start, p.ids) for p in pieces if p.doc_id == i)
        assert np.frombuffer(b"".join(x for _, x in own), "<u4").tolist() == ids


def test_every_stage_on_empty_and_null_tables_and_more_columns(spark, tmp_path):
    write(spark, tmp_path, [], [(1, 1, 0), (2, 0, 0), (None, None, None)])
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 2 + [(3, None, None, None, None)], SCHEMA).selectExpr("*", "1 AS score", "'x' AS digest", "2 AS fp", "3 AS keep_id")
    for name, stage in C.STAGES:
        for docs, most in ((nulls.limit(0), 0), (nulls, 3)):
            found = stage(spark, docs, str(tmp_path))
            assert found.count() <= most
            if name != "packing":
                assert found.columns == list(C.COLUMNS)
    assert C.run(spark, str(tmp_path)).count() == 0
