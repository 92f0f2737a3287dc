"""All registered queries."""

from chromaloom.plans import catalog_features, catalog_relational, catalog_sources  # noqa: F401
from chromaloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
