"""Queries over the given tables, one or more per operator, with the SQL that must agree."""

from queries.registry import ORACLES, QUERIES
from queries import banks, calls, files, functions, keys, links, lists, reports, shapes  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
