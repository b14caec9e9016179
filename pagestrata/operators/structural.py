"""Selectors and counts over whole page tables in time linear in the nodes, however deep or repetitive a page is.

The expressions of ``dom`` answer a question inside a page's row and look at all its nodes for each candidate that has an ancestor or descendant
to test. Here the nodes are rows and the tree relations are running maxima and sums along the page. Node intervals are nested or disjoint, so

* a node lies below a hit if the furthest end among the hits before it reaches the node,
* a node holds a hit if the next hit behind it starts before the node ends,
* the hits below a node are the hits up to its end less the hits up to its start.

One exchange by page serves them all, and nodes travel without markup and text. Pages with equal keys and equal markup are one page; pages
that share keys (or have null keys) but differ in markup are kept apart. A page without nodes gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from pagestrata.functions.text import sql_has_contact
from pagestrata.operators.dom import sql_matches, sql_matches_any, sql_raw_text
from pagestrata.operators.segments import sql_heuristic_label
from pagestrata.rules import CANDIDATES, FEATURES, Sel

_PAGE = "__page"
_BEFORE = (Window.unboundedPreceding, -1)


def _named_pages(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pages that have ``nodes``, each with a digest of its keys and markup."""
    name = F.md5(F.concat(F.encode(F.to_json(F.struct(*keys)), "UTF-8"), "canon_html"))
    return df.select(*keys, "nodes", "page_text", name.alias(_PAGE))


def _name(name: str) -> str:
    return f"`{name}`"


def _is_local(sel: Sel) -> bool:
    """The node and its parents alone decide, without a look along the page."""
    return not (sel.under or sel.holding) and (sel.child_of is None or _is_local(sel.child_of))


def _own(sel: Sel) -> Sel:
    return sel if _is_local(sel) else sel._replace(under=None, holding=None, child_of=None)


def _parts(sel: Sel) -> list[Sel]:
    """The selector and those it relates to, as far as they need a look along the page."""
    related = [] if _is_local(sel) else [r for r in (sel.under, sel.holding, sel.child_of) if r]
    return [_own(sel), *(p for r in related for p in _parts(r))]


def _with_hits(rows: DataFrame, sel: Sel, own: Mapping[Sel, str], into: str) -> DataFrame:
    """Add whether each node matches ``sel``; ``own`` names the columns of what nodes decide alone."""
    holds, along, part = F.col(own[_own(sel)]), Window.partitionBy(_PAGE), f"{into}_"
    if _is_local(sel):
        return rows.withColumn(into, holds)
    if sel.under:
        rows = _with_hits(rows, sel.under, own, f"{part}u")
        reach = F.max(F.when(F.col(f"{part}u"), F.col("last_desc_id"))).over(along.orderBy("node_id").rangeBetween(*_BEFORE))
        holds &= F.coalesce(reach >= F.col("node_id"), F.lit(False))
    if sel.holding:
        rows = _with_hits(rows, sel.holding, own, f"{part}h")
        # Seen from the end of the page, so that the frame only grows.
        following = F.min(F.when(F.col(f"{part}h"), F.col("node_id"))).over(along.orderBy(F.desc("node_id")).rangeBetween(*_BEFORE))
        holds &= F.coalesce(following <= F.col("last_desc_id"), F.lit(False))
    if sel.child_of:
        rows = _with_hits(rows, sel.child_of, own, f"{part}c")
        parents = rows.where(F.col(f"{part}c")).select(_PAGE, F.col("node_id").alias("parent_id"), F.lit(True).alias(f"{part}p"))
        rows = rows.join(parents, [_PAGE, "parent_id"], "left")
        holds &= F.coalesce(F.col(f"{part}p"), F.lit(False))
    return rows.withColumn(into, holds)


def selected(df: DataFrame, selectors: Mapping[str, Sequence[Sel]], *keys: str) -> DataFrame:
    """(keys, selector, node_id, tag) of each node of a page table with nodes that matches any selector of a named list."""
    every = [s for sels in selectors.values() for s in sels]
    own = {sel: f"__own{i}" for i, sel in enumerate(dict.fromkeys(p for s in every for p in _parts(s)))}
    flags = ", ".join(f"{sql_matches(sel, 'n')} AS {name}" for sel, name in own.items())
    fields = "n.node_id AS node_id, n.parent_id AS parent_id, n.last_desc_id AS last_desc_id, n.tag AS tag"
    nodes = _named_pages(df, keys).select(*keys, _PAGE, F.expr(f"inline(transform(nodes, n -> struct({fields}, {flags})))"))
    rows = nodes.repartition(_PAGE).dropDuplicates([_PAGE, "node_id"])
    for i, sel in enumerate(every):
        rows = _with_hits(rows, sel, own, f"__hit{i}")
    number, named = iter(range(len(every))), []
    for name, sels in selectors.items():
        found = reduce(lambda a, b: a | b, [F.col(f"__hit{next(number)}") for _ in sels])
        named.append(F.when(found, F.lit(name)))
    return rows.select(*keys, "node_id", "tag", F.explode(F.array_compact(F.array(*named))).alias("selector")).select(*keys, "selector", "node_id", "tag")


def counts_below(
    df: DataFrame, anchors: Sequence[Sel], features: Mapping[str, Sequence[Sel]], *keys: str, contacts: bool = False
) -> DataFrame:
    """(keys, node_id, one count per feature, child_divs) for each node that matches an anchor: what lies below it.

    Anchors and features are selectors that a node and its parents decide alone; others are refused. ``contacts`` adds ``has_contact``:
    the anchor's text holds a phone number or an address.
    """
    if not all(map(_is_local, [*anchors, *(s for sels in features.values() for s in sels)])):
        raise ValueError("selectors with ancestors or descendants: use selected()")
    hits = {name: f"int({sql_matches_any(sels, 'n')})" for name, sels in features.items()}
    nothing = ", ".join(f"0 AS {_name(name)}" for name in features)
    contact = sql_has_contact(sql_raw_text("n")) if contacts else "false"

    def event(kind: int, at: str, anchor: str, sign: int, counts: str, extra: str = "0 AS divs, false AS contact") -> str:
        return f"struct({kind} AS kind, {at} AS at, {anchor} AS anchor, {sign} AS sign, {counts}, {extra})"

    seen = event(0, "n.node_id", "-1", 0, ", ".join(f"{sql} AS {_name(name)}" for name, sql in hits.items()))
    child = event(1, "n.node_id", "n.parent_id", 0, nothing, "1 AS divs, false AS contact")
    starts = event(2, "n.node_id", "n.node_id", -1, nothing, f"0 AS divs, {contact} AS contact")
    ends = event(3, "n.last_desc_id", "n.node_id", 1, nothing)
    lists = [
        f"transform(nodes, n -> {seen})",
        f"transform(filter(nodes, n -> n.tag = 'div'), n -> {child})",
        f"transform(filter(nodes, n -> {sql_matches_any(anchors, 'n')}), n -> {starts})",
        f"transform(filter(nodes, n -> {sql_matches_any(anchors, 'n')}), n -> {ends})",
    ]
    events = _named_pages(df, keys).select(*keys, _PAGE, F.expr(f"inline(concat({', '.join(lists)}))"))
    events = events.repartition(_PAGE).dropDuplicates([_PAGE, "kind", "at", "anchor"])
    so_far = Window.partitionBy(_PAGE).orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    running = events.select("*", *[F.sum(name).over(so_far).alias(f"__upto_{name}") for name in features])
    sums = running.where("anchor >= 0").groupBy(_PAGE, "anchor").agg(
        *[F.first(k).alias(k) for k in keys],
        *[F.sum(F.col(f"__upto_{name}") * F.col("sign")).alias(name) for name in features],
        F.sum("divs").alias("child_divs"),
        F.max("contact").alias("has_contact"),
        F.max("kind").alias("__kind"),
    )
    found = sums.where("__kind = 3").withColumnRenamed("anchor", "node_id")
    return found.select(*keys, "node_id", *features, "child_divs", *(["has_contact"] if contacts else []))


def block_labels(df: DataFrame, *keys: str, anchors: Sequence[Sel] = tuple(CANDIDATES)) -> DataFrame:
    """(keys, node_id, label) of each candidate by the heuristic features, read off running counts instead of each candidate's nodes."""
    counts = counts_below(df, anchors, FEATURES, *keys, contacts=True)
    wide = {f"columns_{n}": (F.col(f"columns_{n}") > 0) | (F.col("child_divs") == n) for n in (2, 3)}
    flags = {name: F.col(name) > 0 for name in ("maps", "products", "sliders", "faqs")}
    features = counts.withColumns({**flags, **wide, "contacts": (F.col("contacts") > 0) | F.col("has_contact")})
    return features.withColumn("f", F.struct(*FEATURES)).select(*keys, "node_id", F.expr(sql_heuristic_label("f")).alias("label"))
