"""Registered queries over the test tables."""

from . import documents, records, relational, service  # noqa: F401  they register their queries
from .registry import QUERIES, Query  # noqa: F401
