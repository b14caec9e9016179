"""A crawl's state: restarts, buckets, and a plan that does not shuffle the past."""

import random

import pytest
from pyspark.sql import functions as F

from pagestrata.plans import crawl as C


def graph(spark, n=60, seed=2):
    rng = random.Random(seed)
    links = {i: [rng.randrange(n) for _ in range(rng.randrange(2, 4))] for i in range(n)}
    rows = [(i, f"http://x.org/{i}", "<html>" + "".join(f'<a href="/{k}?q={k % 2}">l</a>' for k in links[i]) + "</html>", 404 if i % 13 == 5 else 200) for i in range(n)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, status int")
    seeds = spark.createDataFrame([("http://x.org/0", 3), ("http://x.org/1", 9), ("http://y.org/1", 9), ("http://x.org/1", 9)], "seed_url string, max_depth int")
    return pages, seeds, links


def by_hand(links, start, most):
    """Depths of the pages reached from a page."""
    depths, frontier = {str(start): 0}, [str(start)]
    for depth in range(1, most + 1):
        then = []
        for url in frontier:
            for k in links[int(url)] if int(url) % 13 != 5 else []:
                u = str(k)  # links lose their query
                if u not in depths:
                    depths[u] = depth
                    then.append(u)
        frontier = then
    return depths


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_a_crawl_equals_a_plain_walk(spark):
    pages, seeds, links = graph(spark)
    got = C.crawl(pages, seeds, ["x.org"], buckets=3).collect()
    for seed, most in ((0, 3), (1, 9)):
        own = {r.url.removeprefix("http://x.org/"): r.depth for r in got if r.seed_url == f"http://x.org/{seed}"}
        assert own == by_hand(links, seed, most)
    assert all(r.status == (404 if int(r.url.rpartition("/")[2]) % 13 == 5 else 200) for r in got) and max(r.depth for r in got) > 3


def test_a_crawl_that_was_cut_off_goes_on_and_a_done_one_is_read_again(spark, tmp_path, monkeypatch):
    pages, seeds, _ = graph(spark)
    whole = rows_of(C.crawl(pages, seeds, ["x.org"]))
    original = C.CrawlState.finish

    def lost(self, step, **facts):
        if step == "round-2":
            raise RuntimeError("lost")
        original(self, step, **facts)

    monkeypatch.setattr(C.CrawlState, "finish", lost)
    with pytest.raises(RuntimeError):
        C.crawl(pages, seeds, ["x.org"], state=f"{tmp_path}/state", buckets=3)  # round 2 is written but not in the ledger
    monkeypatch.setattr(C.CrawlState, "finish", original)
    rounds = []
    monkeypatch.setattr(C.CrawlState, "store_round", lambda self, depth, rows, f=C.CrawlState.store_round: rounds.append(depth) or f(self, depth, rows))
    again = C.crawl(pages, seeds, ["x.org"], state=f"{tmp_path}/state", buckets=7)
    assert rows_of(again) == whole and rounds[0] == 2
    rounds.clear()
    assert rows_of(C.crawl(pages, seeds, ["x.org"], state=f"{tmp_path}/state")) == whole and not rounds


def test_no_seeds_and_no_pages(spark):
    pages, seeds, _ = graph(spark)
    assert C.crawl(pages, seeds.limit(0), ["x.org"]).count() == 0
    assert {(r.url, r.depth, r.status) for r in C.crawl(pages.limit(0), seeds, ["x.org"]).collect()} == {("http://x.org/0", 0, None), ("http://x.org/1", 0, None)}


def test_the_past_is_not_shuffled(spark, tmp_path):
    pages, seeds, _ = graph(spark)
    C.crawl(pages, seeds, ["x.org"], state=f"{tmp_path}/state", buckets=4).count()
    kept = C.CrawlState(spark, f"{tmp_path}/state", 4)
    found = kept.rows(2).select("seed_url", "url").dropDuplicates(["seed_url", "url"])
    before = kept.rows().where(F.col("depth") <= 1).select("seed_url", "url")
    plan = found.join(before.hint("merge"), ["seed_url", "url"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SelectedBucketsCount: 4 out of 4" in plan
    lists = spark.table(kept.lists)
    plan = kept.rows(2).join(lists.hint("merge"), "page_key")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # the frontier
    kept.close()
