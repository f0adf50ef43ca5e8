"""Operators for training-data pipelines, and their queries over the given tables."""

from roster.llm.common import ORACLES, QUERIES
from roster.llm import queries  # noqa: F401, E402

__all__ = ["ORACLES", "QUERIES"]
