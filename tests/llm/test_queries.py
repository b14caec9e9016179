"""The registered queries' digest columns against plain Python on a small table."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from llm import secret_scan
from llm.registry import QUERIES
from tests.llm.test_byte_bpe import REFERENCE
from tests.llm.test_packing import PLAIN
from tests.llm.test_simhash_dedup import brute_classes, brute_fingerprint

TEXTS = {0: None, 1: "", 2: "One two three four " * 30, 3: "One two three four " * 30, 4: 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" AKIA' + "A" * 16, 7: "Üben macht müde\n" * 900}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rows = [(i, t, "en", "s", len(t or "")) for i, t in TEXTS.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def rows_of(spark, folder, name):
    return {r.doc_id: r for r in QUERIES[name](spark, folder).collect()}


def test_op4(spark, folder):
    got = rows_of(spark, folder, "op4_simhash_near_dedup")
    fps = {i: brute_fingerprint(t) for i, t in TEXTS.items()}
    classes = brute_classes(list(TEXTS), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{fps[i]:016x}", classes[i]) for i in TEXTS}


def test_op5(spark, folder):
    for i, r in rows_of(spark, folder, "op5_byte_bpe").items():
        ids = REFERENCE.encode_ordinary(TEXTS[i] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((TEXTS[i] or "").encode()).hexdigest()


def test_op7(spark, folder):
    for i, r in rows_of(spark, folder, "op7_secret_scan").items():
        found = secret_scan.spans(TEXTS[i] or "")
        base = ",".join(f"{k}:{s}:{e}" for s, k, e in found if k in ("assign", "access", "hex"))
        assert r.spans == ",".join(f"{k}:{s}:{e}" for s, k, e in found)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(base.count(k) for k in ("assign", "access", "hex"))


def test_op10(spark, folder):
    pieces = QUERIES["op10_packing"](spark, folder).collect()
    for i, text in TEXTS.items():
        ids = np.array([*PLAIN.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted((r for r in pieces if r.doc_id == i), key=lambda r: r.start)
        assert own[0].start == 0 and sum(r.length for r in own) == len(ids)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids)
            assert r.offset + r.length <= 2048
    assert P.PATTERN
