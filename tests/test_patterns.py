"""Substring joins and template tables against plain Python and the compiled rules."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pagestrata.operators import patterns as P
from pagestrata.operators.templates import read_template, read_templates, template_match, template_table
from pagestrata.plans.parse import page_blocks
from pagestrata.rules import TEMPLATE_SEED


def texts_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "page_id long, html string")


@pytest.mark.parametrize("limit", [50_000, 0])
def test_hits_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(P.small, "__defaults__", (limit,))
    rng = random.Random(5)
    texts = [None, "", "é", "a"] + ["".join(rng.choice("abcé<>") for _ in range(rng.randint(1, 60))) for _ in range(60)]
    marks = ["", "a", "é", "ab", "ab", "abc", "zzzzzz", None] + ["".join(rng.choice("abcé<>") for _ in range(rng.randint(1, 6))) for _ in range(40)]
    table = spark.createDataFrame([(i, m, 1) for i, m in enumerate(marks)], "no int, pattern string, gram_size int")
    got = sorted((r.page_id, r.no) for r in P.substring_hits(texts_of(spark, texts), table).collect())
    assert got == sorted((i, k) for i, t in enumerate(texts) for k, m in enumerate(marks) if t is not None and m is not None and m in t)


def test_no_texts_and_no_patterns(spark):
    table = spark.createDataFrame([(1, "a")], "no int, pattern string")
    assert P.substring_hits(texts_of(spark, []).limit(0), table).count() == 0
    assert P.substring_hits(texts_of(spark, ["abc"]), table.limit(0)).count() == 0


RULES = {
    1: '{"priority": 2, "step1": "alpha | beta", "step2": "<p"}',
    2: '{"step1": ["gamma", 5, "delta"], "step3": "never read"}',
    3: '{"priority": 1, "step1": 7, "step2": "omega"}',
    4: '{"priority": 9}',
    5: '{"priority": 0, "step1": []}',
    6: '{"priority": 3, "step1": "x||y", "step2": "kappa"}',
    7: '{"priority": -1, "step1": {"a": 1}, "step2": "[sigma]"}',
    8: None,
    9: '{"step1": "one", "step2": "two", "step10": "z", "step01": "z"}',
}


def test_rules_are_read_as_by_the_compiler(spark):
    rows = [(i, f"label {i}", rule) for i, rule in RULES.items() if rule]
    got = {r.template_id: (r.label, r.priority, tuple(map(tuple, r.steps))) for r in P.template_steps(template_table(spark, [(i, f"label {i}", r) for i, r in RULES.items()])).collect()}
    want = {t.template_id: (t.label, t.priority, t.steps) for t in (read_template(*row) for row in rows)}
    assert got == want
    with pytest.raises(ValueError, match="unsupported"):
        P.template_steps(template_table(spark), "other")


def first_by_hand(templates, text):
    for t in sorted(templates, key=lambda t: (t.priority, t.template_id)):
        if all(any(o in text for o in step) for step in t.steps):
            return t.template_id
    return None


def test_the_first_template_wins_with_odd_rules_too(spark):
    seed = [(i, f"label {i}", rule) for i, rule in RULES.items() if rule]
    texts = ["alpha <p", "beta", "gamma", "delta omega", "omega kappa", "kappa", "[sigma] gamma", "", "one two", None]
    steps = P.template_steps(template_table(spark, seed))
    for skipped in ((), (4,)):
        kept = [row for row in seed if row[0] not in skipped]
        found = P.first_templates(texts_of(spark, texts), steps.where(~F.col("template_id").isin(*skipped)) if skipped else steps, "page_id")
        got = {r.page_id: r.template_id for r in found.collect()}
        rules = [read_template(*row) for row in kept]
        assert got == {i: t for i, x in enumerate(texts) if x is not None and (t := first_by_hand(rules, x)) is not None}


def test_ten_thousand_templates_from_parquet(spark, tmp_path):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    seed = list(TEMPLATE_SEED)
    for i in range(100, 10_100):
        steps = {f"step{k + 1}": "|".join(rng.sample(words, rng.randint(1, 3))) for k in range(rng.randint(1, 3))}
        seed.append((i, f"label {i % 97}", json.dumps({"priority": rng.randint(0, 9), **steps})))
    template_table(spark, seed).repartition(4).write.parquet(f"{tmp_path}/templates")
    steps = P.template_steps(spark.read.parquet(f"{tmp_path}/templates"))
    texts = ["".join(rng.choice([*rng.sample(words, 5), "<p>", "<img ", " ", "faq"]) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    found = P.first_templates(texts_of(spark, texts), steps, "page_id")
    rules = read_templates(seed)
    want = {i: (t, dict((r.template_id, r.label) for r in rules)[t]) for i, x in enumerate(texts) if (t := first_by_hand(rules, x)) is not None}
    assert {r.page_id: (r.template_id, r.label) for r in found.collect()} == want


def test_relabelled_blocks_equal_the_compiled_rules(spark):
    at = F.expr("timestamp_seconds(page_id)")
    bodies = ["<p>words enough of them to be kept as a block, faq</p>", "<div>nothing in it that a rule would know, but long enough</div>", "<img src=a.png><b>col-3</b>"]
    pages = spark.createDataFrame([(i, f"http://x.org/{i}", f"<!DOCTYPE html><html><header>h</header><section>{b}</section><footer>f</footer>") for i, b in enumerate(bodies)], "page_id long, url string, html string")
    by_table = P.relabelled(page_blocks(pages, at, templates=()), P.template_steps(template_table(spark)))
    want = page_blocks(pages, at)
    assert by_table.columns == want.columns
    assert sorted(map(str, by_table.collect())) == sorted(map(str, want.collect()))
    assert want.where(template_match("html").isNotNull()).count() > 0
