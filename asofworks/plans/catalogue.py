"""All queries over the driver's tables, with their SQL."""

from . import evidence, graph, ingestion, quality, questions, records, search, series  # noqa: F401  they register their queries
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
