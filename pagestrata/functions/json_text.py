"""Indented JSON text of stored block content.

The content's own keys are written in alphabetical order, whatever they are: values are text, flags, numbers, lists of text
or one small object of text. Absent values are left out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from pagestrata.functions.text import html_safe_json, json_string


def _braced(lines: Column, prefix: str) -> Column:
    body = F.array_join(lines, ",\n")
    return F.when(body == "", F.lit("{}")).otherwise(F.concat(F.lit("{\n"), body, F.lit(f"\n{prefix}}}")))


def _line(prefix: str, name: Column, value: Column) -> Column:
    return F.concat(F.lit(f"{prefix}  "), html_safe_json(json_string(name)), F.lit(": "), value)


def indented_object(values: Mapping[str, Column], prefix: str = "", raw: Sequence[str] = ()) -> Column:
    """JSON object over several lines; null values are left out, ``raw`` ones are JSON already."""
    lines = [_line(prefix, F.lit(name), value if name in raw else html_safe_json(json_string(value))) for name, value in values.items()]
    return _braced(F.array_compact(F.array(*lines)), prefix)


def _indented_list(items: Column, prefix: str) -> Column:
    lines = F.transform(items, lambda v: F.concat(F.lit(prefix + "  "), html_safe_json(json_string(v))))
    return F.when(F.size(items) == 0, F.lit("[]")).otherwise(F.concat(F.lit("[\n"), F.array_join(lines, ",\n"), F.lit(f"\n{prefix}]")))


def _entries(texts: Column) -> Column:
    """Entries with a value, by key."""
    return F.array_sort(F.filter(F.map_entries(texts), lambda e: e["value"].isNotNull()))


def _indented_value(value: Column, prefix: str) -> Column:
    """One value of the content, a variant."""
    kind = F.schema_of_variant(value)
    pairs = _entries(value.cast("map<string,string>"))
    small = F.transform(pairs, lambda e: _line(prefix, e["key"], html_safe_json(json_string(e["value"]))))
    return (
        F.when(kind == "STRING", html_safe_json(json_string(value.cast("string"))))
        .when(F.startswith(kind, F.lit("ARRAY")), _indented_list(value.cast("array<string>"), prefix))
        .when(F.startswith(kind, F.lit("OBJECT")), _braced(small, prefix))
        .when(kind != "VOID", value.cast("string"))
    )


def indented_content(prefix: str = "") -> Column:
    """Indented form of column ``content``; ``prefix`` leads every line but the first."""
    parsed = F.from_json("content", "map<string,variant>")
    keys = F.array_sort(F.map_keys(parsed))
    lines = F.transform(keys, lambda k: _line(prefix, k, _indented_value(F.element_at(parsed, k), prefix + "  ")))
    return _braced(F.array_compact(lines), prefix)
