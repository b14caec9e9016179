import numpy as np

from llm import vector_graph as G

SCHEMA = "vec_id long, embedding array<float>, label int"


def groups(seed, n, sizes, d=16):
    """Random unit vectors and, among them, groups that lie close."""
    g = np.random.default_rng(seed)
    parts = [g.standard_normal((n, d))]
    for size in sizes:
        parts.append(g.standard_normal(d) + 0.15 * g.standard_normal((size, d)))
    x = np.concatenate(parts)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def brute(rows, threshold):
    """Links by all pairs of the rows that can link."""
    links = {k: set() for k in range(len(rows))}
    for a, (i, x, la) in enumerate(rows):
        for b, (j, y, lb) in enumerate(rows):
            if a != b and la is not None and la == lb and None not in (i, j, x, y) and len(x) == len(y) and None not in x and None not in y:
                u, v = np.array(x, np.float32).astype(float), np.array(y, np.float32).astype(float)
                if np.isfinite(u).all() and np.isfinite(v).all() and u.any() and v.any() and u @ v / np.sqrt(u @ u) / np.sqrt(v @ v) >= threshold:
                    links[a].add(b)
    return links


def least(rows, links):
    root = {}
    for k in links:
        if k in root:
            continue
        todo, group = [k], set()
        while todo:
            j = todo.pop()
            if j not in group:
                group.add(j)
                todo += links[j]
        for j in group:
            root[j] = min((rows[m][0] for m in group if rows[m][0] is not None), default=None)
    return root


def check(spark, rows, **options):
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS key", "2 AS shard", "3 AS n", "4 AS copies")
    got = G.near_duplicates(frame, threshold=0.9, **options).collect()
    links = brute(rows, 0.9)
    roots = least(rows, links)
    want = sorted(((i, len(links[k]), roots[k]) for k, (i, _, _) in enumerate(rows)), key=repr)
    have = sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr)
    return have, want, got


def test_edge_rows_match_brute_force(spark):
    one, two = [1.0, 0.0, 0.5], [-1.0, 0.2, 0.0]
    rows = [(5, one, 1), (3, [2.0, 0.0, 1.0], 1), (4, one, 2), (9, one, 1), (9, one, 1), (7, two, None), (8, None, 1), (10, [0.0, 0.0, 0.0], 1)]
    rows += [(11, [float("nan"), 1.0, 0.0], 1), (12, [None, 1.0, 0.0], 1), (13, [], 1), (14, [1.0, 0.5], 1), (15, two, 1), (16, [1e30, 0.0, 5e29], 1), (20, two, 1)]
    have, want, got = check(spark, rows)
    assert have == want
    assert {r.vec_id for r in got if r.kept} == {3, 4, 7, 8, 10, 11, 12, 13, 14, 15}
    none = spark.createDataFrame([(None, one, 1), (1, one, 1)], SCHEMA)
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in G.near_duplicates(none).collect()} == {(None, 0, None, False), (1, 0, 1, True)}
    assert G.near_duplicates(none.limit(0)).count() == 0


def test_many_shards_keep_recall_and_report_no_false_link(spark):
    x = groups(0, 600, [60, 30, 2, 2, 2, 2, 2, 5, 5])
    order = np.random.default_rng(1).permutation(len(x))
    rows = [(int(i), [float(v) for v in x[j]], int(j % 2)) for i, j in enumerate(order)]
    have, want, got = check(spark, rows, shard_size=100, overlap=2)
    found, true = sum(n for _, n, _ in have), sum(n for _, n, _ in want)
    assert true > 1000 and found >= 0.9 * true and got[0].recall >= 0.9
    links = {i: n for i, n, _ in want}
    assert all(n <= links[i] for i, n, _ in have)


def test_pruned_lists_keep_the_nearest_and_cover():
    x = groups(2, 200, [40])
    lists = G.build(x, degree=8)
    near = x @ x.T
    np.fill_diagonal(near, -1)
    assert all(near[i].argmax() in found for i, found in enumerate(lists))
    assert max(map(len, lists)) <= 16
    q, node = G.search(x, lists, np.arange(len(x)), G.medoids(x), 0.9)
    assert len(q) >= 0.95 * (near >= 0.9).sum() and (near[q, node] >= 0.9).all()
