"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

from gridlore.llm.queries import QUERIES, SQL  # noqa: F401
