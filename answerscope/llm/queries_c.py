"""Registered queries: toxicity, language-model scores."""

from __future__ import annotations

from answerscope.llm import pseudo_likelihood as lm
from answerscope.llm import toxicity
from answerscope.llm.common import documents, query


@query("op4_toxicity")
def _toxicity(spark, sf):
    """Not expressible in SQL: a fitted regression; tests check held-out accuracy."""
    docs = documents(spark, sf).select("doc_id", "text")
    return toxicity.score(docs, toxicity.fit(toxicity.labelled(docs, spark.read.parquet(f"{sf}/labels.parquet"))))


@query("op2_pseudo_likelihood")
def _pseudo_likelihood(spark, sf):
    """Not expressible in SQL: a trained network; tests check gradients, normalisation and ranking."""
    docs = documents(spark, sf).select("doc_id", "text")
    words, distinct = lm.count_tokens(docs)
    return lm.score(docs, words, distinct, lm.train(docs, words))
