"""Rules as tables of any size: substrings found in texts by an inverted index, templates matched through their rarest step.

A pattern's index entry is one of its byte grams of four (patterns shorter than that: the whole pattern). Texts give their distinct grams, an equality join meets the two, and what meets is
verified on the text. So work grows with texts and true candidates, not with texts times patterns. The index is broadcast while it is small by
count, else joined by sort and merge.

Nulls: a null text holds no pattern, a null pattern is in no text. An empty pattern is in every text that is not null. Repeated patterns hit each by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagestrata.functions.text import trimmed
from pagestrata.rules import PLATFORMS

GRAM = 4
#: An index or rule table of at most so many rows is broadcast; rows are a gram and an id, or a rule of bounded length.
BROADCAST_ROWS = 50_000
#: Rules longer than this are not broadcast, however few.
BROADCAST_BYTES = 16 << 20


def _bytes(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def text_grams(text: Column, sizes: list[int]) -> Column:
    """Distinct grams of a text, as hexadecimal strings: for each size every run of so many bytes."""

    def of_size(raw: Column, size: int) -> Column:
        starts = F.when(F.octet_length(raw) >= size, F.sequence(F.lit(1), F.octet_length(raw) - (size - 1)))
        return F.coalesce(F.transform(starts, lambda i: F.hex(raw.substr(i, F.lit(size)))), F.array().cast("array<string>"))

    # the bytes are bound once as an array's only element; a cast within the inner lambda would copy the text for each gram
    grams = F.transform(F.array(_bytes(text)), lambda raw: F.array_distinct(F.concat(*(of_size(raw, n) for n in sizes))))
    return F.get(grams, F.lit(0))


def pattern_index(patterns: DataFrame, pattern: str = "pattern") -> DataFrame:
    """Patterns with ``gram``: of the grams of a pattern the one that fewest patterns have (ties: the least), so that few texts become candidates."""
    rows = patterns.where(F.octet_length(pattern) > 0).withColumn("__no", F.monotonically_increasing_id())
    size = F.least(F.octet_length(F.col(pattern)), F.lit(GRAM))
    raw = _bytes(F.col(pattern))
    own = F.transform(F.array(raw), lambda r: F.array_distinct(F.transform(F.sequence(F.lit(1), F.octet_length(r) - size + 1), lambda i: F.hex(r.substr(i, size)))))
    grams = rows.select("__no", pattern, F.explode(F.get(own, F.lit(0))).alias("gram"))
    counts = grams.select(pattern, "gram").distinct().groupBy("gram").agg(F.count("*").alias("__n"))
    best = grams.select(pattern, "gram").distinct().join(counts, "gram").groupBy(pattern).agg(F.min(F.struct("__n", "gram")).alias("__best"))
    return rows.drop("__no").join(best, pattern).withColumn("gram", F.col("__best.gram")).drop("__best")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A table marked for broadcast if it is small by count and by bytes, else for a merge join."""
    sizes = [F.coalesce(F.octet_length(F.to_json(F.struct(F.col(c)))), F.lit(0)) for c in df.columns]
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(sum(sizes[1:], sizes[0])), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if found["n"] <= rows and found["bytes"] <= BROADCAST_BYTES else df.hint("merge")


def candidates(texts: DataFrame, index: DataFrame, key: str, text: str) -> DataFrame:
    """(key, id columns of the index) for each text that has an entry's gram; once per entry."""
    sizes = sorted(r[0] for r in index.select((F.length("gram") / 2).cast("int").alias("n")).distinct().collect())  # GRAM values at most
    ids = [c for c in index.columns if c != "gram"]
    if not sizes:
        return texts.select(key).join(index.select(*ids), F.lit(False))
    grams = texts.select(key, F.explode(text_grams(F.col(text), sizes)).alias("gram"))
    return grams.join(small(index.select("gram", *ids)), "gram").drop("gram").distinct()


def substring_hits(texts: DataFrame, patterns: DataFrame, key: str = "page_id", text: str = "html", pattern: str = "pattern") -> DataFrame:
    """(key, all columns of ``patterns``) for each text and each pattern that it holds, case-sensitive.

    ``key`` is unique and not null in ``texts``.
    """
    found = candidates(texts, pattern_index(patterns, pattern), key, text)
    read = texts.select(key, F.col(text).alias("__text"))
    hits = found.join(read, key).where(F.contains("__text", F.col(pattern))).select(key, *patterns.columns)
    everywhere = small(patterns.where(F.octet_length(pattern) == 0))
    return hits.unionByName(read.where("__text IS NOT NULL").join(everywhere).select(key, *patterns.columns))


def marker_table_hits(pages: DataFrame, markers: DataFrame) -> DataFrame:
    """(page_id, platform, marker) for a table of markers ``platform, marker``."""
    return substring_hits(pages, markers.select("platform", "marker"), pattern="marker").select("page_id", "platform", "marker")


# -- templates -------------------------------------------------------------------


def template_steps(table: DataFrame, platform: str = "html5") -> DataFrame:
    """(template_id, label, priority, steps) of a template table's rules for one platform, read by Spark from their JSON.

    ``steps`` is an array of arrays of options. Steps are step1, step2, ... up to the first missing one. A text is split at | into trimmed options, a list gives its texts,
    any other value always holds and is left out. A missing priority is 0. A rule that is not a JSON object is left out.
    """
    if platform not in PLATFORMS:
        raise ValueError(f"unsupported platform: {platform}")
    rules = table.select("template_id", "label", F.try_parse_json(F.col(platform)).alias("rule")).where("schema_of_variant(rule) LIKE 'OBJECT%'")
    priority = F.coalesce(F.try_variant_get("rule", "$.priority", "int"), F.lit(0)).alias("priority")
    heads = rules.select("template_id", "label", priority)
    fields = rules.lateralJoin(_fields_of_rule(rules)).where(r"key RLIKE '^step[1-9][0-9]*$' AND length(key) <= 12")
    number = F.substring("key", 5, 8).cast("int")
    kind = F.schema_of_variant("value")
    text = F.try_variant_get("value", "$", "string")
    parts = F.when(F.contains(text, F.lit("|")), F.transform(F.split(text, "\\|"), trimmed)).otherwise(F.array(text))
    listed = F.expr("transform(filter(try_variant_get(value, '$', 'array<variant>'), v -> schema_of_variant(v) = 'STRING'), v -> variant_get(v, '$', 'string'))")
    options = F.when(kind == "STRING", parts).when(F.startswith(kind, F.lit("ARRAY")), listed)
    steps = fields.select("template_id", F.struct(number.alias("number"), options.alias("options")).alias("step"))
    grouped = steps.groupBy("template_id").agg(F.array_sort(F.collect_list("step")).alias("all"))  # the steps of one rule
    running = F.filter(F.filter("all", lambda s, i: s["number"] == i + 1), lambda s: s["options"].isNotNull())
    grouped = grouped.select("template_id", F.transform(running, lambda s: s["options"]).alias("steps"))
    none = F.array().cast("array<array<string>>")
    return heads.join(grouped, "template_id", "left").withColumn("steps", F.coalesce("steps", none))


def _fields_of_rule(rules: DataFrame) -> DataFrame:
    return rules.sparkSession.tvf.variant_explode(F.col("rule").outer()).select("key", "value")


def sql_steps_hold(text: str, steps: str = "steps") -> str:
    return f"forall({steps}, s -> exists(s, o -> contains({text}, o)))"


def template_index(templates: DataFrame) -> DataFrame:
    """(template_id, gram) of the step through which a template is sought: the one whose shortest option is longest, then the one of fewest options."""
    weight = F.transform("steps", lambda s: F.struct(F.coalesce(F.array_min(F.transform(s, F.octet_length)), F.lit(0)).alias("least"), (-F.size(s)).alias("few"), s.alias("options")))
    chosen = templates.where("size(steps) > 0").select("template_id", F.array_max(weight).alias("step")).where("step.least > 0")
    options = chosen.select("template_id", F.explode("step.options").alias("pattern")).distinct()
    return pattern_index(options).select("template_id", "gram").distinct()


def first_templates(texts: DataFrame, templates: DataFrame, key: str = "block_id", text: str = "html") -> DataFrame:
    """(key, template_id, label) of the first template, by priority and id, whose steps all hold; texts without one have no row.

    ``templates`` as from ``template_steps``, with unique ids; ``key`` is unique and not null in ``texts``. A template all of whose steps have an empty option, or that has none, holds for every text
    and needs no index: only the first of these can win.
    """
    found = candidates(texts, template_index(templates), key, text)
    rules = small(templates)
    read = texts.select(key, F.col(text).alias("__text")).where("__text IS NOT NULL")
    held = found.join(rules, "template_id").join(read, key).where(F.expr(sql_steps_hold("__text")))
    place = F.struct("priority", "template_id", "label")
    always = templates.where("forall(steps, s -> exists(s, o -> o = ''))").agg(F.min(place).alias("best")).where("best IS NOT NULL")
    both = held.select(key, place.alias("best")).unionByName(read.select(key).join(F.broadcast(always)))
    best = both.groupBy(key).agg(F.min("best").alias("best"))
    return best.select(key, "best.template_id", "best.label")


def relabelled(blocks: DataFrame, templates: DataFrame) -> DataFrame:
    """Block rows whose content blocks are labelled by a template table; blocks that no template fits keep their heuristic label.

    ``blocks`` come from a parse without templates (``page_blocks(..., templates=())``).
    """
    content = blocks.where("block_type = 'content'").select("block_id", "html")
    found = first_templates(content, templates).select(F.col("block_id").alias("__id"), F.col("label").alias("__label"))
    joined = blocks.join(found, F.col("block_id") == F.col("__id"), "left")
    by_rule = F.to_json(F.struct(F.lit(True).alias("matched_pattern"), F.col("__label").alias("template_name")))
    return joined.withColumn("content", F.when(F.col("__id").isNotNull(), by_rule).otherwise(F.col("content"))).select(*blocks.columns)
