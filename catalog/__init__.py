"""Queries over the driver's tables, each with the SQL that must give the same rows."""

from catalog.base import QUERIES, SQL

from catalog import checks, features, jobs, profiles, raw, windows  # noqa: F401,E402

__all__ = ["QUERIES", "SQL"]
