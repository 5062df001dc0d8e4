"""Registered queries on the given tables, each beside the SQL that checks it."""

from cohortweave.catalog import cohorts, models, relational
from cohortweave.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "cohorts", "models", "relational"]
