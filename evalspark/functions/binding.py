"""A let-binding for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A lambda evaluates every outer expression again for each element; binding first
    turns a quadratic array expression back into a linear one.
    """
    return F.transform(F.array(value), body)[0]
