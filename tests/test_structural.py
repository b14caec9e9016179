"""Structural joins and running counts against the expressions inside a page's row and plain loops."""

import pytest
from pyspark.sql import functions as F

from pagestrata.functions.markup import Reader
from pagestrata.operators.dom import sql_below, sql_select, with_nodes
from pagestrata.operators.segments import sql_candidates, sql_features, sql_heuristic_label
from pagestrata.operators.structural import block_labels, counts_below, selected
from pagestrata.rules import CANDIDATES, FEATURES, cls, on, tags

PAGES = [
    (1, "<main><div class=a><img><a class=b><img></a></div><div><p>x<p>y</div></main><section><h2>t</h2></section>"),
    (2, "<section><div class=block><form></form><section><img><button>b</button></section></div></section>"),
    (3, "<div class=container>+7 (999) 123-45-67 write<div>1</div><div>2</div></div><div class=content><table></table></div>"),
    (None, "<ul><li><a href=1><b>t</b></a><li><b>u</b></ul>"),
    (None, "<a><img></a>"),
    (4, ""),
    (5, None),
    (1, "<main><div class=a><img><a class=b><img></a></div><div><p>x<p>y</div></main><section><h2>t</h2></section>"),
    (6, "<div class='block slider faq-x'><div class='card map'>one</div><p>two</p><div class='col-2 product'>x</div></div>"),
]
SELECTORS = {
    "img under a": [on("img", under=on("a"))],
    "img under b under div": [on("img", under=on(None, cls("b"), under=on("div")))],
    "a holding img": [on("a", holding=on("img"))],
    "div holding a holding img": [on("div", holding=on("a", holding=on("img")))],
    "div in main": [on("div", child_of=on("main"))],
    "b in a in li": [on("b", child_of=on("a", child_of=on("li")))],
    "img in a under div": [on("img", child_of=on("a", under=on("div")))],
    "text": [on("section", text="T")],
    "p or h2": tags("p", "h2"),
}


@pytest.fixture(scope="module")
def read(spark):
    return with_nodes(spark.createDataFrame(PAGES, "page_id int, html string")).cache()


def test_selectors_equal_those_inside_a_row(read):
    found = sorted(map(tuple, selected(read, SELECTORS, "page_id").collect()), key=repr)
    want = set()
    distinct = read.dropDuplicates(["page_id", "html"])
    for name, sels in SELECTORS.items():
        hits = distinct.select("page_id", F.md5("html").alias("d"), F.expr(f"inline({sql_select(sels)})"))
        want |= {(r.page_id, name, r.node_id, r.tag, r.d) for r in hits.collect()}
    assert found == sorted((w[:4] for w in want), key=repr) and {f[1] for f in found} == set(SELECTORS)


def test_counts_and_labels_equal_those_inside_a_row(read):
    below = sql_below("c")
    own = f"transform({sql_candidates()}, c -> struct(c.node_id AS node_id, {sql_features('c', below)} AS f))"
    rows = read.dropDuplicates(["page_id", "html"]).select("page_id", F.expr(f"inline({own})"))
    want = rows.select("page_id", "node_id", "f.images", "f.paragraphs", "f.headings", F.expr(sql_heuristic_label("f")).alias("label"))
    counts = counts_below(read, CANDIDATES, {k: FEATURES[k] for k in ("images", "paragraphs", "headings")}, "page_id").drop("child_divs")
    labels = block_labels(read, "page_id")
    found = counts.join(labels, ["page_id", "node_id"])
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and want.count() == 9
    assert labels.select("label").distinct().count() >= 5


def test_deep_pages_are_counted(spark):
    n = 3_000
    page = with_nodes(spark.createDataFrame([(1, "<section><img>" * n)], "page_id int, html string"))
    found = {r.node_id: r.images for r in counts_below(page, [on("section")], {"images": tags("img")}, "page_id").collect()}
    assert found == {2 * i: n - i for i in range(n)}
    assert selected(page, {"x": [on("img", under=on("section"))]}, "page_id").count() == n


def test_selectors_that_look_along_the_page_are_refused_as_anchors(read):
    with pytest.raises(ValueError):
        counts_below(read, [on("img", under=on("a"))], {"images": tags("img")}, "page_id")


def test_empty_table(spark):
    empty = with_nodes(spark.createDataFrame([], "page_id int, html string"))
    assert selected(empty, SELECTORS, "page_id").count() == 0 and block_labels(empty, "page_id").count() == 0


def test_reader_is_linear_in_nesting_and_formatting():
    deep = Reader().read("<div>" * 20_000 + "x")
    assert deep.nodes[-1].depth == 19_999
    many = Reader().read("".join(f"<b id={i}><p>" for i in range(2_000)))
    assert len(many.nodes) < 2_000 * 70
    few = Reader().read("<p>" + "".join(f"<b id={i}>" for i in range(40)) + "a<p>b")
    assert sum(n.tag == "b" for n in few.nodes) == 80
