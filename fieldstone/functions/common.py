"""Shared building blocks of Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once and standing once in the plan, however often the body refers to it."""
    return F.get(F.transform(F.array(value), body), 0)
