"""Registered queries by name, and their SQL."""

from . import changes, kept  # noqa: F401  register their queries
from .catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
