"""All queries of the package by name, and the SQL that gives the same rows."""

from .plans import comparison, corpus, evaluation, examples, rendering  # noqa: F401
from .plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
