"""All registered queries."""

from bedside.plans import (  # noqa: F401
    acquisition_queries, frequency_queries, mixture_queries, score_queries, sequence_queries,
    source_queries, tabular_queries,
)
from bedside.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
