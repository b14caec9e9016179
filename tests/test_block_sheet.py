import datetime

import pytest

from catalog import storing
from pagestrata.plans.reports import CUT_CELL

LIMIT = 32767


@pytest.mark.parametrize("mark", ["a", "é", "€", "😀"])
def test_sheet_has_long_blocks_cut_and_marked(spark, monkeypatch, mark):
    pages = ["x" * n + mark * (40000 // len(mark.encode())) for n in range(4)] + ["x" * LIMIT, "x" * (LIMIT - 1) + mark, "short", "", None]
    now = datetime.datetime(2024, 1, 1)
    blocks = spark.createDataFrame(
        [("o", str(i), "content", "p", now, "{}", html) for i, html in enumerate(pages)],
        "operation_id string, block_id string, block_type string, platform string, created_at timestamp, content string, html string",
    )
    monkeypatch.setattr(storing, "site_blocks", lambda spark, sf: blocks)
    got = {int(r.block_id): r.html_preview for r in storing.h2(spark, "").collect()}
    want = {i: h if h is None or len(h.encode()) <= LIMIT else h.encode()[:LIMIT].decode(errors="ignore") + CUT_CELL for i, h in enumerate(pages)}
    assert got == want
