"""The registered queries and their SQL."""

from .plans import cleaning, learned, reports, scoring  # noqa: F401 - they register their queries
from .plans.catalogue import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
