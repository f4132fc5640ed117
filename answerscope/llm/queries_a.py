"""Registered queries: line dedup, quality rules, mixing, packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerscope.llm import line_dedup, mixing, packing, quality
from answerscope.llm.common import documents, query


@query("op3_line_dedup", """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (SELECT key, min(doc_id) AS holder FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)),
told AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.holder AS dropped FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(dropped AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM told GROUP BY doc_id""")
def _line_dedup(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text")
    return line_dedup.drop_repeated_lines(docs).select(
        "row.doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256")
    )


@query("op8_quality_rules")
def _quality(spark, sf):
    """Not expressible in SQL: the exact binomial certificates; tests hold it against brute force."""
    rows = quality.judged(documents(spark, sf).select("doc_id", "text", "lang"), spark.read.parquet(f"{sf}/labels.parquet"))
    return rows.select(F.col("id").alias("doc_id"), *quality.COUNTS, "base_failed", "kept")


@query("op9_mixing")
def _mixing(spark, sf):
    """Not expressible in SQL: a sequential random walk; tests check totals, bounds and reruns."""
    return mixing.mix_report(documents(spark, sf).select("doc_id", "text", "source"))


@query("op10_packing")
def _packing(spark, sf):
    """Not expressible in SQL: the tokenizer; tests check coverage, offsets and checksums."""
    import public_tokenizers

    return packing.packed_pieces(documents(spark, sf).select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
