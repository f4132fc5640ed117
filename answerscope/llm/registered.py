"""All registered queries of the subpackage, and the pipeline at the repository's top."""

from __future__ import annotations

import corpus_pipeline

from answerscope.llm import queries_a, queries_b, queries_c, queries_d  # noqa: F401
from answerscope.llm.common import ORACLES, QUERIES, query

query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)

__all__ = ["ORACLES", "QUERIES"]
