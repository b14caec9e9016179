"""Content blocks of a page: candidates, filters, features and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from pagestrata import rules
from pagestrata.functions.text import quoted, sql_has_contact
from pagestrata.operators.dom import (
    sql_below,
    sql_inner_html,
    sql_inside,
    sql_let,
    sql_matches_any,
    sql_ordered_first,
    sql_raw_text,
    sql_select,
    sql_text,
)
from pagestrata.operators.templates import read_templates, sql_template_match
from pagestrata.rules import Template

MIN_TEXT_BYTES = 30
MIN_HTML_BYTES = 50


def _count(below: str, feature: str) -> str:
    return f"size(filter({below}, n -> {sql_matches_any(rules.FEATURES[feature], 'n')}))"


def _any(below: str, feature: str) -> str:
    return f"exists({below}, n -> {sql_matches_any(rules.FEATURES[feature], 'n')})"


def sql_columns(below: str, node: str, count: int) -> str:
    """Block is laid out in ``count`` columns: by class names, or by that many child divs."""
    children = f"size(filter({below}, n -> n.tag = 'div' AND n.parent_id = {node}.node_id)) = {count}"
    return f"({_any(below, f'columns_{count}')} OR {children})"


def sql_features(node: str, below: str) -> str:
    """Struct of counts and flags the heuristic labels depend on."""
    counts = ("images", "buttons", "headings", "paragraphs", "forms", "tables")
    flags = ("maps", "products", "sliders", "faqs")
    parts = [f"'{c}', {_count(below, c)}" for c in counts]
    parts += [f"'{f}', {_any(below, f)}" for f in flags]
    parts += [f"'contacts', ({_any(below, 'contacts')} OR {sql_has_contact(sql_raw_text(node))})"]
    parts += [f"'columns_2', {sql_columns(below, node, 2)}", f"'columns_3', {sql_columns(below, node, 3)}"]
    return f"named_struct({', '.join(parts)})"


def sql_heuristic_label(f: str) -> str:
    """Label from the features struct ``f``; the first line that holds decides."""
    text, image, button = f"{f}.paragraphs > 0", f"{f}.images > 0", f"{f}.buttons > 0"
    words = f"({text} OR {f}.headings > 0)"
    lines = [
        (f"{f}.maps", rules.LABEL_MAP),
        (f"{f}.forms > 0", rules.LABEL_FORM),
        (f"{f}.contacts", rules.LABEL_CONTACTS),
        (f"{f}.faqs", rules.LABEL_FAQ),
        (f"{f}.tables > 0", rules.LABEL_TABLE),
        (f"{f}.sliders AND {words}", rules.LABEL_SLIDER_TEXT),
        (f"{f}.sliders", rules.LABEL_SLIDER),
        (f"{f}.products", rules.LABEL_PRODUCTS),
        (f"{image} AND {button}", rules.LABEL_IMAGE_ACTION),
        (f"{text} AND {image}", rules.LABEL_TEXT_IMAGE),
        (f"{text} AND {button}", rules.LABEL_TEXT_ACTION),
        (f"{image} AND {f}.columns_3", rules.LABEL_IMAGE_COLUMNS),
        (image, rules.LABEL_IMAGE),
        (f"{words} AND {f}.columns_2", rules.LABEL_TEXT_COLUMNS),
        (words, rules.LABEL_TEXT),
    ]
    cases = " ".join(f"WHEN {condition} THEN {quoted(label)}" for condition, label in lines)
    return f"CASE {cases} ELSE {quoted(rules.LABEL_MIXED)} END"


def sql_candidates() -> str:
    """All candidate nodes in document order, nested ones included."""
    return sql_select(rules.CANDIDATES)


def sql_excluded_footer() -> str:
    return f"get(nodes, {sql_ordered_first(rules.EXCLUDED_FOOTERS)}.node_id)"


def sql_outside(candidates: str, header: str, footer: str) -> str:
    """Candidates that neither are nor lie in the page's header or footer node."""

    def within(outer: str) -> str:
        return f"coalesce({sql_inside('c', outer)} OR c.node_id = {outer}.node_id, false)"

    return f"filter({candidates}, c -> NOT {within(header)} AND NOT {within(footer)})"


def sql_measured(candidates: str) -> str:
    """Candidates with markup, size and the digest of their markup: ``{node, html, text_bytes, has_image, outer}``."""
    image = f"exists({sql_below('c')}, n -> n.tag = 'img')"
    struct = (
        f"named_struct('node', c, 'html', {sql_inner_html('c')}, 'text_bytes', octet_length({sql_text('c')}), "
        f"'has_image', {image}, 'outer', c.digest)"
    )
    return f"transform({candidates}, c -> {struct})"


def sql_large_text(m: str) -> str:
    return f"({m}.text_bytes >= {MIN_TEXT_BYTES} OR {m}.has_image)"


def sql_large_html(m: str) -> str:
    return f"(octet_length({m}.html) >= {MIN_HTML_BYTES} OR {m}.has_image)"


def sql_first_of_each(array: str, key: str) -> str:
    """Elements of ``array`` whose ``key`` did not occur before, in order; sorts instead of comparing pairs."""
    keyed = "array_sort(transform(xs, (x, i) -> struct(x." + key + " AS k, i AS i)))"
    firsts = "filter(s, (e, j) -> j = 0 OR get(s, j - 1).k <> e.k)"
    order = f"array_sort({sql_let(keyed, 's', f'transform({firsts}, e -> e.i)')})"
    return sql_let(array, "xs", f"transform({order}, i -> get(xs, i))")


def sql_kept(measured: str) -> str:
    """Measured candidates that are large enough, each outer markup once."""
    return sql_first_of_each(f"filter({measured}, m -> {sql_large_text('m')} AND {sql_large_html('m')})", "outer")


def sql_labelled(kept: str, templates: Sequence[Template]) -> str:
    """Blocks ``{node_id, html, label, matched}``: by template, else by heuristics."""
    features = sql_features("m.node", sql_below("m.node"))
    heuristic = sql_let(features, "f", sql_heuristic_label("f"))
    block = (
        "named_struct('node_id', m.node.node_id, 'html', m.html, "
        f"'label', coalesce(t, {heuristic}), 'matched', t IS NOT NULL)"
    )
    return f"transform({kept}, m -> {sql_let(sql_template_match('m.html', templates), 't', block)})"


def with_measured(df: DataFrame, into: str = "measured") -> DataFrame:
    """Add the measured candidates outside of header and footer."""
    df = df.withColumns(
        {
            "__head": F.expr(f"get({sql_select([rules.on('header')])}, 0)"),
            "__foot": F.expr(sql_excluded_footer()),
        }
    )
    outside = sql_outside(sql_candidates(), "__head", "__foot")
    return df.withColumn(into, F.expr(sql_measured(outside))).drop("__head", "__foot")


def with_blocks(df: DataFrame, into: str = "content_blocks", templates: Sequence[Template] | None = None) -> DataFrame:
    """Add the labelled content blocks of each page, in document order."""
    templates = read_templates() if templates is None else templates
    df = with_measured(df, "__measured")
    return df.withColumn(into, F.expr(sql_labelled(sql_kept("__measured"), templates))).drop("__measured")
