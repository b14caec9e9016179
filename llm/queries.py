"""One query per operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from llm import best_fit, byte_bpe, exact_dedup, line_dedup, neural_lm, packing, quality_cnn, repeat_dedup, secret_scan, simhash_dedup, spelling, vector_graph, whitening
from llm.common import table
from llm.registry import query


@query(
    "op8_exact_dedup",
    """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
      doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
)
def op8(spark, sf):
    index = exact_dedup.DigestIndex.temporary(spark)
    found = exact_dedup.ingest(index, table(spark, sf, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op4_simhash_near_dedup")
def op4(spark, sf):
    found = simhash_dedup.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op5_byte_bpe")
def op5(spark, sf):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = byte_bpe.encoded(table(spark, sf, "documents"), ranks, public_tokenizers.PATTERN)
    return found.select(
        "doc_id",
        F.expr("cast(octet_length(ids) / 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _joined(spans):
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def _number(kind):
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


@query("op7_secret_scan")
def op7(spark, sf):
    found = secret_scan.scan(table(spark, sf, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE_KINDS))
    counts = [_number(kind) for kind in secret_scan.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


@query("op9_quality_classifier")
def op9(spark, sf):
    return quality_cnn.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op10_packing")
def op10(spark, sf):
    found = packing.pack(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op2_lm_scoring")
def op2(spark, sf):
    return neural_lm.scored(table(spark, sf, "documents"))


@query(
    "op1_line_dedup",
    f"""WITH cut AS (
      SELECT page_id, lower(coalesce(regexp_extract(url, '{line_dedup.HOST}', 1), '')) AS host,
        list_filter(list_transform(string_split(coalesce(regexp_replace(html, '{line_dedup.BREAKS}', chr(10), 'g'), ''), chr(10)),
          lambda x: trim(x, ' ')), lambda x: x <> '') AS lines
      FROM pages
    ), counts AS (
      SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM cut) GROUP BY host, line
    ), hosts AS (SELECT host, count(*) AS pages FROM cut GROUP BY host
    ), dropped AS (
      SELECT host, list(line) AS common FROM counts JOIN hosts USING (host) WHERE n >= 3 AND n / pages > 0.3 GROUP BY host
    )
    SELECT page_id, host, len(lines) AS n_lines, len(lines) - len(stays) AS n_dropped, array_to_string(stays, chr(10)) AS text
    FROM (SELECT page_id, host, lines, list_filter(lines, lambda x: NOT coalesce(list_contains(common, x), false)) AS stays
      FROM cut LEFT JOIN dropped USING (host))""",
)
def op1(spark, sf):
    pages = table(spark, sf, "pages")
    text = line_dedup.text_of_html(F.col("html"))
    return line_dedup.dedup_lines(pages.select("page_id", line_dedup.host_of(F.col("url")).alias("host"), text.alias("text")))


@query("op3_vector_graph")
def op3(spark, sf):
    return vector_graph.near_duplicates(table(spark, sf, "embeddings"))


@query("op6_repeat_dedup")
def op6(spark, sf):
    found = repeat_dedup.dedup_repeats(table(spark, sf, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_whitening")
def op11(spark, sf):
    found = whitening.whitened(table(spark, sf, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


@query("op12_spelling")
def op12(spark, sf):
    return spelling.variants(table(spark, sf, "documents"))


@query("op13_best_fit_packing")
def op13(spark, sf):
    found = best_fit.pack(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
