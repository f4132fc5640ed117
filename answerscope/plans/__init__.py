"""Registered queries, grouped by subject; importing this package registers them all."""

from answerscope.plans import (  # noqa: F401
    evaluation_queries,
    job_queries,
    sampling_queries,
    source_queries,
    spectral_queries,
    text_queries,
    token_queries,
)
from answerscope.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
