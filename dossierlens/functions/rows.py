"""Binding a value so that it is computed once per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def computed_once(value: Column) -> Column:
    """A generator of the one row ``value``; drops the row if it is null.

    The optimizer copies the expression of a projected column into every filter and column
    above it. It does not look through a generator, so long strings built here are not
    built again for each test on them.
    """
    return F.explode(F.filter(F.array(value), lambda v: v.isNotNull()))
