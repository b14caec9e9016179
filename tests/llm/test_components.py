import random

from pyspark.sql import functions as F

from llm import common
from llm.components import components


def brute(links):
    near = {}
    for a, b in links:
        if a is not None and b is not None:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    root = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            k = todo.pop()
            if k not in root:
                root[k] = start
                todo += near[k]
    return root


def test_chains_stars_and_random_links(spark):
    rng = random.Random(2)
    chain = list(range(1000, 1060))
    rng.shuffle(chain)
    links = [*zip(chain, chain[1:]), *((5000, 5000 + i) for i in range(1, 300)), (7, 3), (3, 7), (9, 9), (None, 3), (4, None)]
    links += [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    want = {k: r for k, r in brute([x for x in links if x[0] != x[1]]).items()}
    assert {r.node: r.root for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_join_with_hot_and_null_keys(spark):
    rows = [(i, "hot" if i % 3 else None if i % 2 else f"k{i}") for i in range(6000)]
    many = spark.createDataFrame(rows, "id long, key string")
    one = many.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("most")).where("key IS NULL OR key <> 'k6'")
    got = {r.id: r.most for r in common.with_hot(many, one, "key", "n", len(rows)).collect()}
    most = {}
    for i, k in rows:
        most[k] = i
    assert got == {i: None if k == "k6" else most[k] for i, k in rows}
