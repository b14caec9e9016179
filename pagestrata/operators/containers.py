"""Header and footer containers, by platform.

A container is a struct ``{node_id, last_desc_id, text_start, html, text,
below}``: its markup, raw text and descendants.  Fields are then read from the
container alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pagestrata import rules
from pagestrata.functions.chains import first_chain, leftmost_chain
from pagestrata.operators.dom import (
    sql_below,
    sql_inner_html,
    sql_let,
    sql_ordered_first,
    sql_text_bytes,
    sql_select,
)
from pagestrata.rules import CONTAINERS, TILDA_RECORD, Sel


def sql_container_node(sels: Sequence[Sel]) -> str:
    """First node of the first selector with a hit, or null."""
    return f"get(nodes, {sql_ordered_first(sels)}.node_id)"


def sql_tilda_node(part: str) -> str:
    """Node by the selectors if it has markup, else the outermost record, else that node after all."""
    records = sql_select([TILDA_RECORD])
    record = f"get({records}, 0)" if part == "header" else f"get(reverse({records}), 0)"
    return sql_let(
        sql_container_node(CONTAINERS["tilda", part]),
        "hit",
        f"CASE WHEN {sql_filled('hit')} THEN hit ELSE coalesce({record}, hit) END",
    )


def sql_filled(node: str) -> str:
    return f"coalesce({node}.inner_end > {node}.inner_start, false)"


def box(node: str, html: Column | None = None) -> Column:
    """Container struct of a node column."""
    n = F.col(node)
    return F.struct(
        n["node_id"].alias("node_id"),
        n["last_desc_id"].alias("last_desc_id"),
        n["text_start"].alias("text_start"),
        (F.expr(sql_inner_html(node)) if html is None else html).alias("html"),
        F.expr(sql_text_bytes(node)).alias("text"),
        F.expr(sql_below(node)).alias("below"),
    )


def tilda_html(node: str, part: str) -> Column:
    """Markup of the Tilda container; without one, a fragment of the raw page, or null."""
    chains = rules.TILDA_HEADER_FALLBACK if part == "header" else rules.TILDA_FOOTER_FALLBACK
    fragment = leftmost_chain(F.col("html"), chains)
    return F.when(F.expr(sql_filled(node)), F.expr(sql_inner_html(node))).otherwise(fragment)


def wordpress_fragment(part: str) -> Column:
    """WordPress header or footer, cut from the raw page with its own tags."""
    chains = rules.WORDPRESS_HEADER if part == "header" else rules.WORDPRESS_FOOTER
    return first_chain(F.col("html"), chains)


def with_container(df: DataFrame, sels: Sequence[Sel], into: str, keep_empty: bool = False) -> DataFrame:
    """Add the container of the first selector with a hit.

    One without markup counts as not found unless ``keep_empty``.
    """
    df = df.withColumn("__node", F.expr(sql_container_node(sels)))
    found = F.col("__node").isNotNull() if keep_empty else F.expr(sql_filled("__node"))
    return df.withColumn(into, F.when(found, box("__node"))).drop("__node")


def with_tilda_container(df: DataFrame, part: str, into: str) -> DataFrame:
    """Add the Tilda container; if only a fragment is found, it has ``html`` and no nodes."""
    df = df.withColumn("__node", F.expr(sql_tilda_node(part)))
    df = df.withColumn("__html", tilda_html("__node", part))
    return df.withColumn(into, F.when(F.col("__html").isNotNull(), box("__node", F.col("__html")))).drop(
        "__node", "__html"
    )
