"""Parse a corpus: pages to operations and labelled blocks.

One scan, one pass over the markup, no shuffle: platform, containers, fields
and labels are expressions over the page's own row, and the blocks of a page
are exploded from it at the end.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pagestrata.operators import fields
from pagestrata.operators.containers import (
    box,
    sql_container_node,
    sql_filled,
    sql_tilda_node,
    tilda_html,
    wordpress_fragment,
)
from pagestrata.operators.detect import bitrix_version, platform
from pagestrata.operators.dom import sql_inner_html, with_nodes
from pagestrata.operators.links import kept_hrefs
from pagestrata.operators.segments import (
    sql_candidates,
    sql_excluded_footer,
    sql_kept,
    sql_labelled,
    sql_measured,
    sql_outside,
)
from pagestrata.operators.templates import read_templates
from pagestrata.rules import CONTAINERS, MARKERS, PLATFORMS, OwnPlatform, Template, on

BLOCK_COLUMNS = (
    "operation_id", "block_id", "block_type", "platform", "position", "block_no", "content", "html", "created_at",
)


def operation_id(url: Column, page_id: Column) -> Column:
    return F.md5(F.concat_ws("|", url, page_id.cast("string")))


def block_id(operation: Column, position: Column) -> Column:
    return F.md5(F.concat_ws("|", operation, position.cast("string")))


def operations(pages: DataFrame, created_at: Column, updated_at: Column, status: str = "pending") -> DataFrame:
    """One operation per page, with an id that is the same on every run."""
    return pages.select(
        operation_id(F.col("url"), F.col("page_id")).alias("operation_id"),
        "url",
        F.lit(status).alias("status"),
        created_at.alias("created_at"),
        updated_at.alias("updated_at"),
    )


def _json(columns: Mapping[str, str | Column]) -> Column:
    """JSON of the fields that are there; absent ones have no key."""
    parts = [(F.expr(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()]
    return F.to_json(F.struct(*parts))


def _block(kind: str, content: Column, html: Column) -> Column:
    return F.struct(F.lit(kind).alias("block_type"), content.alias("content"), html.alias("html"))


def with_page_blocks(
    pages: DataFrame,
    templates: Sequence[Template] | None = None,
    markers: Mapping[str, Sequence[str]] = MARKERS,
    order: Sequence[str] = PLATFORMS,
    own: Mapping[str, OwnPlatform] | None = None,
    links: bool = False,
) -> DataFrame:
    """Add ``platform`` and ``blocks`` (array of ``{position, block_type, content, html}``) to pages.

    ``own`` names further platforms; their markers are tried before the others. With ``links`` the same reading of the markup also
    gives ``hrefs``, as ``with_hrefs`` does, and pages of all platforms are read.
    """
    own = own or {}
    markers = {**markers, **{p: rules.markers for p, rules in own.items()}}
    order = (*own, *order)
    templates = read_templates() if templates is None else templates
    name = F.col("platform")
    df = pages.withColumn("platform", platform(F.col("html"), markers, order))
    df = df.withColumn("__tree", F.lit(True) if links else name.isin("html5", "tilda", "bitrix", *own))
    df = with_nodes(df, only_if="__tree")
    html5 = name == "html5"

    def node(part: str) -> Column:
        found = (
            F.when(html5, F.expr(sql_container_node([on(part)])))
            .when(name == "tilda", F.expr(sql_tilda_node(part)))
            .when(name == "bitrix", F.expr(sql_container_node(CONTAINERS["bitrix", part])))
        )
        for p, rules in own.items():
            found = found.when(name == p, F.expr(sql_container_node(rules.containers[part])))
        return found

    def html(part: str) -> Column:
        found = f"__{part}_node"
        return (
            F.when(name == "wordpress", wordpress_fragment(part))
            .when(name == "tilda", tilda_html(found, part))
            .when(name == "bitrix", F.coalesce(F.expr(sql_inner_html(found)), F.lit("")))
            .when(name.isin("html5", *own) & F.expr(sql_filled(found)), F.expr(sql_inner_html(found)))
        )

    df = df.withColumns(
        {
            "__header_node": node("header"),
            "__footer_node": node("footer"),
            "__excluded": F.when(html5, F.expr(sql_excluded_footer())),
        }
    )
    outside = sql_outside(sql_candidates(), "__header_node", "__excluded")
    df = df.withColumns(
        {
            "__header": box("__header_node", html("header")),
            "__footer": box("__footer_node", html("footer")),
            "__measured": F.when(html5, F.expr(sql_measured(outside))),
        }
    )
    version = bitrix_version(F.col("html"))

    def edge(part: str) -> Column:
        found = f"__{part}"
        readers = {
            "html5": fields.html5_header if part == "header" else fields.html5_footer,
            "tilda": fields.tilda_header if part == "header" else fields.tilda_footer,
            "bitrix": fields.bitrix_header if part == "header" else fields.bitrix_footer,
        }
        fragment = F.col(f"{found}.html")
        read_fragment = fields.wordpress_header if part == "header" else fields.wordpress_footer
        content = F.when(name == "wordpress", _json(read_fragment(fragment)))
        for platform_name, read in readers.items():
            columns = read(found)
            if platform_name == "bitrix":
                columns = {**columns, "version": version}
            content = content.when(name == platform_name, _json(columns))
        for p, rules in own.items():
            if rules.fields.get(part):
                content = content.when(name == p, _json(fields.own_fields(found, rules.fields[part])))
        content = F.coalesce(content, F.lit("{}"))
        return F.when(fragment.isNotNull(), _block(part, content, fragment))

    labelled = F.expr(sql_labelled(sql_kept("__measured"), templates))
    content = F.transform(
        labelled,
        lambda b: _block(
            "content",
            F.to_json(F.struct(b["matched"].alias("matched_pattern"), b["label"].alias("template_name"))),
            b["html"],
        ),
    )
    none = F.array().cast("array<struct<block_type:string,content:string,html:string>>")
    df = df.withColumn(
        "__parts", F.concat(F.array(edge("header")), F.coalesce(content, none), F.array(edge("footer")))
    )
    placed = F.expr(
        "filter(transform(__parts, (p, i) -> named_struct('position', i, 'block_type', p.block_type, "
        "'content', p.content, 'html', p.html)), b -> b.block_type IS NOT NULL)"
    )
    hrefs = [kept_hrefs(F.filter("nodes", lambda n: n["tag"] == "a")).alias("hrefs")] if links else []
    return df.select(*pages.columns, "platform", placed.alias("blocks"), *hrefs)


def outcomes(pages: DataFrame, created_at: Column, updated_at: Column, templates: Sequence[Template] | None = None) -> DataFrame:
    """Operations after the parse, with ``status`` completed or error and the ``error``: no page, or no templates for an HTML5 page."""
    some = bool(read_templates() if templates is None else templates)
    error = F.when(F.col("html").isNull(), "no page").when((platform(F.col("html")) == "html5") & F.lit(not some), "no templates")
    marked = pages.withColumn("__error", error)
    return marked.select(
        operation_id(F.col("url"), F.col("page_id")).alias("operation_id"),
        "url",
        F.when(F.col("__error").isNull(), "completed").otherwise("error").alias("status"),
        F.col("__error").alias("error"),
        created_at.alias("created_at"),
        updated_at.alias("updated_at"),
    )


def page_blocks(pages: DataFrame, created_at: Column, **rules) -> DataFrame:
    """Block rows of a corpus (see ``BLOCK_COLUMNS``); ``created_at`` is an input, not the clock."""
    return block_rows(with_page_blocks(pages.withColumn("__at", created_at), **rules))


def block_rows(df: DataFrame) -> DataFrame:
    """Block rows of parsed pages with their time ``__at``."""
    operation = operation_id(F.col("url"), F.col("page_id"))
    # The outer form keeps Spark from copying the whole block expression into a filter below the explode.
    exploded = F.posexplode_outer("blocks").alias("no", "b")
    rows = df.select(operation.alias("operation_id"), "platform", "__at", exploded)
    return rows.filter(F.col("b.block_type").isNotNull()).select(
        "operation_id",
        block_id(F.col("operation_id"), F.col("b.position")).alias("block_id"),
        "b.block_type",
        "platform",
        "b.position",
        (F.col("no") + 1).alias("block_no"),
        "b.content",
        "b.html",
        F.col("__at").alias("created_at"),
    )
