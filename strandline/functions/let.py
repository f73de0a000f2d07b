"""Naming a value inside an expression."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, and written once in the generated code."""
    return F.element_at(F.transform(F.array(value), body), 1)
