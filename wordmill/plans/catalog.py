"""All registered queries."""

from wordmill.plans import (  # noqa: F401
    assoc_queries,
    feature_queries,
    metric_queries,
    rewrite_queries,
    source_queries,
    swap_queries,
    text_queries,
    vocab_queries,
)
from wordmill.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
