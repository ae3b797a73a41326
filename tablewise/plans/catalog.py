"""All registered queries; importing the modules fills the registry."""

from tablewise.plans import (  # noqa: F401
    cleaning_queries,
    clustering_queries,
    explore_queries,
    model_queries,
    ratings_queries,
    stream_queries,
)
from tablewise.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
