"""Registered queries and their SQL."""

from checks.registry import QUERIES, SQL  # noqa: F401
from checks import core, quality, reports, series, statistics, texts  # noqa: F401,E402
