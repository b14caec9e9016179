"""Template rules: reading them and matching block markup against them."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagestrata.functions.text import quoted
from pagestrata.rules import PLATFORMS, TEMPLATE_SEED, Template


def template_table(spark: SparkSession, seed: Iterable[tuple[int, str, str]] = TEMPLATE_SEED) -> DataFrame:
    """Template dimension as stored: one JSON rule column per platform."""
    rows = [(i, label, None, None, None, rule) for i, label, rule in seed]
    return spark.createDataFrame(
        rows, "template_id int, label string, wordpress string, tilda string, bitrix string, html5 string"
    )


def templates_of(table: DataFrame, platform: str) -> DataFrame:
    """Rules of one platform in match order: priority, then id."""
    if platform not in PLATFORMS:
        raise ValueError(f"unsupported platform: {platform}")
    rule = F.col(platform)
    priority = F.get_json_object(rule, "$.priority").cast("int")
    return (
        table.filter(rule.isNotNull())
        .select("template_id", "label", priority.alias("priority"), rule.alias("rule"))
        .orderBy("priority", "template_id")
    )


def _options(value: object) -> tuple[str, ...] | None:
    if isinstance(value, str):
        return tuple(o.strip() for o in value.split("|")) if "|" in value else (value,)
    if isinstance(value, list):
        return tuple(o for o in value if isinstance(o, str))
    return None


def read_template(template_id: int, label: str, rule: str) -> Template:
    """Steps are step1, step2, ... up to the first missing one; other types than text and list hold always."""
    data = json.loads(rule)
    steps = []
    number = 1
    while f"step{number}" in data:
        options = _options(data[f"step{number}"])
        if options is not None:
            steps.append(options)
        number += 1
    return Template(template_id, label, int(data.get("priority") or 0), tuple(steps))


def read_templates(seed: Iterable[tuple[int, str, str]] = TEMPLATE_SEED) -> list[Template]:
    """Template rules as configuration, in match order."""
    return sorted((read_template(*row) for row in seed), key=lambda t: (t.priority, t.template_id))


def sql_template_match(html: str, templates: Sequence[Template], value: str = "label") -> str:
    """CASE that gives the label (or id) of the first template whose steps all hold, else null."""
    cases = []
    for template in templates:
        steps = [
            "(" + " OR ".join([f"contains({html}, {quoted(o)})" for o in step] or ["false"]) + ")"
            for step in template.steps
        ]
        result = quoted(template.label) if value == "label" else str(template.template_id)
        cases.append(f"WHEN {' AND '.join(steps) or 'true'} THEN {result}")
    return f"CASE {' '.join(cases)} END" if cases else "CAST(NULL AS STRING)"


def template_match(html: str, templates: Sequence[Template] | None = None, value: str = "label") -> Column:
    return F.expr(sql_template_match(html, read_templates() if templates is None else templates, value))
