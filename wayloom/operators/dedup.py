"""Keyed duplicate removal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_first(table: DataFrame, key: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    """One row per key: the one that comes first in ``order``.

    An aggregate rather than a ranking window: partial results are combined before the
    shuffle, so a key that holds a third of all rows sends one row per task and not all of them
    to one sort.
    """
    keys = [k.alias(f"_k{i}") for i, k in enumerate(key)]
    row = F.struct(*[F.col(c) for c in table.columns])
    first = table.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("_row"))
    return first.select("_row.*")
