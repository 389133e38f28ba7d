"""Naming an intermediate value inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    A Python variable that holds a Column is copied into the expression at every use; inside
    lambdas over arrays nothing removes the copies, and they multiply with each level.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
