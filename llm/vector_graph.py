"""Embedding near-dedup over a robust-pruned flat graph.

Vectors are compared within equal labels only. Each label is cut into overlapping cluster shards of bounded size; in every shard a graph is
built whose lists are pruned so that a neighbour is left out if a kept one is much nearer to it; lists of the same
vector from several shards are united. Then each shard's vectors search the united graph, as far as it reaches one step
outside of the shard: a greedy search from the shard's medoids (and the vector's own list) with a bounded beam, then expansion of all
that is found in range until nothing new comes. Every link is verified by cosine in double precision.

Recall is audited: a bounded sample of vectors is compared with all rows in blocks. Below ``target_recall`` all is done again
with one more overlapping shard per vector and twice the shard size.

Pairs are counted where they are found: two vectors that share shards count in the least of these, so only links between
vectors without a common shard are listed. Equal vectors of a label are one node with a number of copies.

Nulls: rows whose id, label or vector is null, whose vector is empty or zero or holds a null or non-finite component, link with
nothing. Vectors of other length than a row's do not link with it. Repeated rows are copies. An empty table gives no rows. Only the id, vector and label
columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from llm.common import stored, with_hot
from llm.components import components

_SAMPLE = 64  # rows per centroid that k-means sees
_FANOUT = 32  # clusters that one group is cut into at most
_LEVELS = 8
_DENSE = 5
_QUERIES = 512

# -- numpy: clusters, pruning, search ---------------------------------------------------------------


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = 6) -> np.ndarray:
    """Unit centroids of unit vectors, from seeds each farthest from those before, so that a close group has one of them."""
    seeds = [int(np.random.default_rng(seed).integers(len(x)))]
    near = x @ x[seeds[0]]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(near.argmin()))
        near = np.maximum(near, x @ x[seeds[-1]])
    centres = x[seeds].copy()
    for _ in range(rounds):
        at = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-300), centres)
    return centres


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """(point, degree) kept candidates, -1 for none: nearest first, each dropping those that are ``alpha`` times nearer to it than to the point."""
    near = np.einsum("pd,pcd->pc", x[points], x[candidates])
    gap = np.sqrt(np.maximum(0, 2 - 2 * near))
    open_ = (candidates >= 0) & (candidates != points[:, None])
    kept = np.full((len(points), degree), -1)
    rows = np.arange(len(points))
    for slot in range(degree):
        best = np.where(open_, gap, np.inf).argmin(axis=1)
        some = open_[rows, best]
        if not some.any():
            break
        chosen = candidates[rows, best]
        kept[some, slot] = chosen[some]
        between = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("pd,pcd->pc", x[chosen], x[candidates])))
        open_ &= (alpha * between > gap) & (candidates != chosen[:, None])
        open_[~some] = False
    return kept


def build(x: np.ndarray, degree: int = 16, pool: int = 48, alpha: float = 1.2, seed: int = 0) -> list[np.ndarray]:
    """Out-lists of a shard's graph: pruned nearest and random candidates, then pruned again with those that point back."""
    n = len(x)
    rng = np.random.default_rng(seed)
    lists = []
    for i in range(0, n, _QUERIES):
        points = np.arange(i, min(n, i + _QUERIES))
        near = x[points] @ x.T
        near[np.arange(len(points)), points] = -np.inf
        first = np.argpartition(-near, min(pool, n) - 1, axis=1)[:, :pool]
        far = rng.integers(0, n, (len(points), degree))
        lists.append(robust_prune(x, points, np.concatenate([first, far], axis=1), degree, alpha))
    kept = np.concatenate(lists)
    source, slot = np.nonzero(kept >= 0)
    target = kept[source, slot]
    pairs = np.unique(np.concatenate([np.stack([source, target], 1), np.stack([target, source], 1)]), axis=0)
    starts = np.searchsorted(pairs[:, 0], np.arange(n + 1))
    out = [pairs[a:b, 1] for a, b in zip(starts[:-1], starts[1:])]
    for i in [i for i in range(n) if len(out[i]) > 2 * degree]:
        again = robust_prune(x, np.array([i]), out[i][None], 2 * degree, alpha)[0]
        out[i] = again[again >= 0]
    return out


def medoids(x: np.ndarray, count: int = 8, seed: int = 0) -> np.ndarray:
    """The vectors nearest to the centres of a few clusters."""
    return np.unique((k_means(x, count, seed, 4) @ x.T).argmax(axis=1))


def search(x: np.ndarray, lists: list[np.ndarray], queries: np.ndarray, starts: np.ndarray, threshold: float, beam: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(query number, node) of all nodes found at ``threshold`` or more, the query's own node left out."""
    width = max(1, max(map(len, lists), default=1))
    table = np.full((len(lists), width), -1)
    for i, found in enumerate(lists):
        table[i, : len(found)] = found
    nq, rows = len(queries), np.arange(len(queries))
    seen, expanded = np.zeros((nq, len(x)), bool), np.zeros((nq, len(x)), bool)
    seen[rows, queries] = True
    nodes, near = np.full((nq, beam), -1), np.full((nq, beam), -np.inf)
    found_q, found_node, waiting = [], [], []

    def meet(q: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Cosines of nodes seen for the first time; those in range are noted."""
        seen[q, node] = True
        cosine = np.einsum("nd,nd->n", x[queries[q]], x[node])
        hit = cosine >= threshold
        found_q.append(q[hit])
        found_node.append(node[hit])
        waiting.append((q[hit], node[hit]))
        return cosine

    def widen(q: np.ndarray, others: np.ndarray) -> None:
        """Bring one list of nodes per query into its beam."""
        fresh = (others >= 0) & ~seen[q[:, None], others]
        at, slot = np.nonzero(fresh)
        cosine = np.full(others.shape, -np.inf)
        cosine[at, slot] = meet(q[at], others[at, slot])
        both, all_nodes = np.concatenate([near[q], cosine], axis=1), np.concatenate([nodes[q], others], axis=1)
        top = np.argpartition(-both, beam - 1, axis=1)[:, :beam]
        near[q], nodes[q] = np.take_along_axis(both, top, axis=1), np.take_along_axis(all_nodes, top, axis=1)

    widen(rows, np.tile(starts, (nq, 1)))
    widen(rows, table[queries])
    while True:  # greedy: expand the nearest node of the beam that has not been expanded
        score = np.where(expanded[rows[:, None], nodes], -np.inf, near)
        best = score.argmax(axis=1)
        q = np.flatnonzero(score[rows, best] > -np.inf)
        if not len(q):
            break
        node = nodes[q, best[q]]
        expanded[q, node] = True
        widen(q, table[node])
    while waiting:  # range: expand all that is in range
        q, node = (np.concatenate(c) for c in zip(*waiting))
        waiting.clear()
        left = ~expanded[q, node]
        q, node = q[left], node[left]
        expanded[q, node] = True
        for i in range(0, len(q), 1 << 15):
            own, others = np.repeat(q[i : i + (1 << 15)], width), table[node[i : i + (1 << 15)]].ravel()
            fresh = (others >= 0) & ~seen[own, others]
            key = np.unique(own[fresh] * len(x) + others[fresh])
            meet(key // len(x), key % len(x))
        if not len(q):
            break
    return np.concatenate(found_q), np.concatenate(found_node)


def _forest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(node, root) links with the components of the pairs."""
    root: dict[int, int] = {}

    def find(i):
        while root.setdefault(i, i) != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [(i, find(i)) for i in root if find(i) != i]


# -- tasks ------------------------------------------------------------------------------------------

_NODE = "id long, label long, dim int, vec binary, copies long"


def _unit(values) -> np.ndarray | None:
    """Unit vector in double precision, or None if the vector links with nothing."""
    if not values or any(v is None for v in values):
        return None
    x = np.array(values, np.float64)
    if not np.isfinite(x).all() or not x.any():
        return None
    x /= np.abs(x).max()
    return x / np.sqrt(x @ x) + 0.0


def _prepare(batches):
    for batch in batches:
        out = []
        for vec_id, values, label in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "embedding", "label"))):
            x = None if vec_id is None or label is None else _unit(values)
            key = None if x is None else hashlib.md5(f"{label}:".encode() + x.tobytes()).digest()
            out.append((vec_id, key, label, 0 if x is None else len(x), None if x is None else x.tobytes()))
        columns = zip(*out)
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["vec_id", "key", "label", "dim", "vec"])


def _matrix(table: pa.Table, column: str = "vec") -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), np.float64).reshape(table.num_rows, -1)


def _centres(table: pa.Table) -> pa.Table:
    """One row: the centroids of a group's sample."""
    table = table.sort_by("id")
    return pa.table({"shard": table.column("shard")[:1], "centres": pa.array([k_means(_matrix(table), table.column("k")[0].as_py(), 0).tobytes()], pa.binary())})


def _assigned(batches, overlap):
    """Rows of each vector in its nearest clusters; ``first`` in the nearest of all."""
    for batch in batches:
        shards, numbers, cache = batch.column("shard").to_pylist(), [], {}
        for i, (shard, vec, blob) in enumerate(zip(shards, batch.column("vec").to_pylist(), batch.column("centres").to_pylist())):
            x = np.frombuffer(vec, np.float64)
            if shard not in cache:
                cache[shard] = np.frombuffer(blob, np.float64).reshape(-1, len(x))
            best = np.argsort(-(cache[shard] @ x), kind="stable")[:overlap]
            numbers += [(i, f"{shard}/{b}", b == best[0]) for b in best]
        if numbers:
            rows, names, first = zip(*numbers)
            taken = batch.select(["id", "label", "dim", "vec", "copies"]).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(names), *taken.columns, pa.array(map(bool, first), pa.bool_())], names=["shard", *taken.schema.names, "first"])


def _builder(degree: int):
    def built(table: pa.Table) -> pa.Table:
        """(id, list) of a shard's graph."""
        table = table.sort_by("id")
        ids = table.column("id").to_numpy()
        lists = build(_matrix(table), degree) if len(ids) > 1 else [np.zeros(0, int)] * len(ids)
        return pa.table({"id": ids, "list": pa.array([ids[found] for found in lists], pa.list_(pa.int64()))})

    return built


_FOUND = "a long, b long, n long"  # n: copies linked with a, b null; or n null: a link


def _searcher(threshold: float):
    def searched(table: pa.Table) -> pa.Table:
        return _searched(table, threshold)

    return searched


def _searched(table: pa.Table, threshold: float) -> pa.Table:
    """Links of a shard's members: numbers of those counted here, links for components, listed links out of common shards."""
    table = table.sort_by([("member", "descending"), ("id", "ascending")])
    ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
    member = int(table.column("member").to_numpy().sum())
    shard, x = table.column("shard")[0].as_py(), _matrix(table)
    homes = [frozenset(h) for h in table.column("homes").to_pylist()]
    place = {i: k for k, i in reversed(list(enumerate(ids.tolist())))}
    lists = [np.array([place[i] for i in found if i in place], int) for found in table.column("list").to_pylist()]
    starts = medoids(x[:member])
    pairs: set[tuple[int, int]] = set()
    for i in range(0, member, _QUERIES):
        queries = np.arange(i, min(member, i + _QUERIES))
        q, node = search(x, lists, queries, starts, threshold)
        a, b = np.minimum(queries[q], node), np.maximum(queries[q], node)
        pairs.update(zip(a.tolist(), b.tolist()))
    counts, links, listed = np.zeros(len(ids), np.int64), [], []
    common: dict[tuple[frozenset, frozenset], str | None] = {}
    for a, b in pairs:
        key = (homes[a], homes[b])
        if key not in common:
            common[key] = min(homes[a] & homes[b], default=None)
        if common[key] == shard:
            counts[a] += copies[b]
            counts[b] += copies[a]
            links.append((int(ids[a]), int(ids[b])))
        elif common[key] is None:
            listed.append((int(ids[a]), int(ids[b])))
    some = np.flatnonzero(counts)
    rows = [(int(ids[i]), None, int(counts[i])) for i in some]
    rows += [(a, b, None) for a, b in _forest(links)] + [(min(p), max(p), 0) for p in listed]
    columns = zip(*rows) if rows else ((), (), ())
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "n"])


# -- the operator -----------------------------------------------------------------------------------


def shards(nodes: DataFrame, shard_size: int, overlap: int) -> DataFrame:
    """Nodes with their shard, in ``overlap`` shards each where a group is cut.

    A cluster that is cut again hands on only the nodes it is nearest to, so a node's further shards add up with the levels and do not multiply. A label over ``shard_size`` is cut into at most _FANOUT clusters by k-means on a bounded sample. A cluster is cut again only
    over _DENSE times that size, so that a close group stays whole, _LEVELS times at most.
    """
    rows = nodes.withColumns({"shard": F.concat_ws(":", "label", "dim"), "first": F.lit(True)})
    done = None
    for level in range(_LEVELS):
        limit = shard_size * (_DENSE if level else 1)
        sizes = stored(rows.groupBy("shard").agg(F.count("*").alias("size"), F.count_if("first").alias("own")), "shard-sizes")
        large = sizes.where(F.col("size") > limit).withColumn("k", F.least(F.lit(_FANOUT), F.ceil(overlap * F.col("own") / shard_size)).cast("int"))
        if large.isEmpty():
            break
        fits = rows.join(sizes.where(F.col("size") <= limit).select("shard"), "shard", "left_semi")
        done = fits if done is None else done.unionByName(fits)
        big = rows.where("first").join(large, "shard")
        sample = big.where(F.pmod(F.xxhash64("id"), F.col("own")) < _SAMPLE * F.col("k"))
        centres = stored(sample.select("shard", "id", "k", "vec").groupBy("shard").applyInArrow(_centres, "shard string, centres binary"), "shard-centres")
        cut = big.select("shard", "id", "label", "dim", "vec", "copies").join(centres, "shard")
        rows = stored(cut.mapInArrow(partial(_assigned, overlap=overlap), f"shard string, {_NODE}, first boolean"), "shards")
    return (rows if done is None else done.unionByName(rows)).drop("first")


def links(nodes: DataFrame, threshold: float, shard_size: int, overlap: int, degree: int) -> DataFrame:
    """(a, b, n) rows: see _FOUND; a listed link between vectors without a common shard has n = 0."""
    placed = stored(shards(nodes, shard_size, overlap), "graph-shards")
    lists = placed.select("shard", "id", "vec").groupBy("shard").applyInArrow(_builder(degree), "id long, list array<long>")
    united = lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("list"))).alias("list"))
    homes = placed.groupBy("id").agg(F.collect_set("shard").alias("homes"))
    graph = stored(nodes.join(united, "id").join(homes, "id"), "graph")
    members = placed.select("shard", "id")
    outside = members.join(graph.select("id", F.explode("list").alias("to")), "id").select("shard", F.col("to").alias("id")).distinct()
    outside = outside.join(members, ["shard", "id"], "left_anti")
    near = members.withColumn("member", F.lit(1)).unionByName(outside.withColumn("member", F.lit(0))).join(graph, "id")
    return near.select("shard", "member", "id", "vec", "copies", "list", "homes").groupBy("shard").applyInArrow(_searcher(threshold), _FOUND)


def _exact(nodes: DataFrame, queries: list, threshold: float) -> dict[int, int]:
    """Copies linked with each query by comparison with all nodes, in blocks."""
    by_group: dict[tuple, list] = {}
    for r in queries:
        by_group.setdefault((r["label"], r["dim"]), []).append((r["id"], np.frombuffer(r["vec"], np.float64)))
    shared = nodes.sparkSession.sparkContext.broadcast({g: ([i for i, _ in v], np.stack([x for _, x in v])) for g, v in by_group.items()})

    def compare(batches):
        for batch in batches:
            ids, copies = batch.column("id").to_numpy(), batch.column("copies").to_numpy()
            groups = list(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist()))
            vecs, found = batch.column("vec").to_pylist(), {}
            for g, (q_ids, q) in shared.value.items():
                at = [i for i, other in enumerate(groups) if other == g]
                if at:
                    x = np.frombuffer(b"".join(vecs[i] for i in at), np.float64).reshape(len(at), -1)
                    hit = (q @ x.T >= threshold) & (np.array(q_ids)[:, None] != ids[at])
                    for k, n in zip(q_ids, hit @ copies[at]):
                        if n:
                            found[k] = found.get(k, 0) + int(n)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], names=["id", "n"])

    return {r["id"]: r["n"] for r in nodes.mapInArrow(compare, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.93,
    shard_size: int = 400,
    overlap: int = 2,
    degree: int = 16,
    target_recall: float = 0.95,
    audit_queries: int = 2000,
    most_rounds: int = 3,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept, recall (as audited: the mean share found of a sampled vector's links, so that no hot value hides the others)."""
    named = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("embedding"), F.col(label_col).cast("long").alias("label"))
    rows = stored(named.mapInArrow(_prepare, "vec_id long, key binary, label long, dim int, vec binary"), "vectors")
    one = F.min_by(F.struct("label", "dim", "vec"), "vec_id").alias("one")
    valid = rows.where("key IS NOT NULL")
    nodes = stored(valid.groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), one).select("id", "one.*", "copies", "key"), "vector-nodes")
    plain = nodes.select("id", "label", "dim", "vec", "copies")
    number = max(1, plain.count())
    queries = plain.where(F.pmod(F.xxhash64("id"), F.lit(number)) < audit_queries).collect()  # about that many, however many tasks there are
    truth = _exact(plain, queries, threshold) if queries else {}
    for turn in range(most_rounds):
        found = stored(links(plain, threshold, shard_size << turn, overlap + turn, degree), "graph-links")
        listed = found.where("n = 0").select("a", "b").distinct()
        both = listed.unionByName(listed.select(F.col("b").alias("a"), F.col("a").alias("b")))
        weights = plain.select(F.col("id").alias("b"), "copies")
        counted = found.where("b IS NULL").select("a", "n").unionByName(both.join(weights, "b").select("a", F.col("copies").alias("n")))
        counts = stored(counted.groupBy("a").agg(F.sum("n").alias("n")), "vector-counts")
        sampled = [r["id"] for r in queries]
        met = {r["a"]: r["n"] for r in counts.join(F.broadcast(plain.sparkSession.createDataFrame([(i,) for i in sampled], "a long")), "a").collect()}
        recall = sum(met.get(i, 0) / n for i, n in truth.items()) / len(truth) if truth else 1.0
        if recall >= target_recall:
            break
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    per_node = nodes.select("key", "id", "copies").join(counts.withColumnRenamed("a", "id"), "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    facts = per_node.select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id"), F.col("copies").alias("weight"))
    total = rows.count()
    out = with_hot(rows.select("vec_id", F.coalesce("key", F.concat(F.lit("\0").cast("binary"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")).cast("binary"))).alias("key")), facts, "key", "weight", total)
    component = F.coalesce("component_id", "vec_id")
    kept = F.coalesce(F.col("vec_id") == component, F.lit(False))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), kept.alias("kept"), F.lit(recall).alias("recall"))
