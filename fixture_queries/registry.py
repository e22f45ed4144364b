"""All registered queries: importing the modules fills the catalog."""

from fixture_queries import (  # noqa: F401
    monthly_queries,
    policy_queries,
    question_queries,
    source_queries,
)
from fixture_queries.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
