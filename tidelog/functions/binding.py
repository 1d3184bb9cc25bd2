"""Expressions that name a value several times and compute it once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once. A plain expression would hold the value's
    own expression at every place that names it: it would grow beyond what can be
    compiled, and inside a function over an array be computed for every element."""
    return F.transform(F.array(value), use)[0]
