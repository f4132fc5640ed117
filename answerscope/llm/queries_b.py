"""Registered queries: SimHash near-duplicates, language, secrets, fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerscope.llm import language, secrets, simhash, sketches
from answerscope.llm.common import documents, id_back, query
from answerscope.llm.secrets_sql import SQL as SECRETS_SQL


@query("op6_simhash")
def _simhash(spark, sf):
    """Not expressible in SQL: XXH64; tests hold it against brute force over all pairs."""
    found = simhash.near_duplicates(documents(spark, sf).select("doc_id", "text"))
    return found.select(id_back().alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), id_back("component").alias("component_id"))


@query("op5_language")
def _language(spark, sf):
    """Not expressible in SQL: byte context trees; tests hold it against brute force and held-out labels."""
    docs = documents(spark, sf).select("doc_id", "text", "lang")
    return language.identify(docs, language.learn(docs))


@query("op1_secrets", SECRETS_SQL)
def _secrets(spark, sf):
    found = secrets.secrets(documents(spark, sf).select("doc_id", "text"))
    of = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        "doc_id", *[of(rank).alias(f"n_{kind}") for rank, kind in enumerate(secrets.KINDS[:3])],
        F.sha2(secrets.spelled(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secrets.spelled(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


@query("op7_fingerprints")
def _fingerprints(spark, sf):
    """Not expressible in SQL: XXH64; tests hold it against brute force."""
    return sketches.compared(documents(spark, sf).select("doc_id", "text"))
