"""All queries over the graph, vectors, texts and metrics."""

from . import graphs, metric_queries, more_queries, relational, small_queries, source_queries, state_queries, texts, vectors  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
