"""Registered queries and their SQL counterparts."""

from itembank.plans import extraction, features, library, reading, structure, upkeep, workbook  # noqa: F401  they register
from itembank.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
