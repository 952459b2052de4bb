"""Naming an intermediate value inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Spark repeats an expression that is used several times inside conditions
    and lambdas; a one-element array gives it a name instead.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
