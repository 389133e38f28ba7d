"""Repeatable random draws.

``rand()`` depends on partitioning and differs after a task is retried. These draws
hash (row id, field, seed) instead, so a lost executor or another partition count
gives the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Twelve hex digits: 48 bits, which a double holds exactly.
_DIGITS = 12
_SPAN = float(16**_DIGITS)


def uniform(row_id: Column, field: str, seed: int) -> Column:
    """Uniform double in [0, 1) for one field of one row."""
    digest = F.md5(F.concat_ws("|", row_id.cast("string"), F.lit(field), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("double") / F.lit(_SPAN)


def uniform_int(draw: Column, low: int, high: int) -> Column:
    """Whole number in [low, high], both ends included."""
    return (F.floor(draw * F.lit(high - low + 1)) + F.lit(low)).cast("int")


def pick(draw: Column, values: Sequence[str]) -> Column:
    """Equal-chance draw from a short fixed list."""
    options = F.array(*[F.lit(value) for value in values])
    return F.get(options, F.floor(draw * F.lit(len(values))).cast("int"))


def pick_weighted(draw: Column, weighted: Sequence[tuple[object, float]]) -> Column:
    """Weighted draw from a short fixed list: one CASE over cumulative weights, no join.

    Values may be literals or columns; without any weight the draw is NULL.
    """
    total = float(sum(weight for _, weight in weighted))
    if not total:
        return F.lit(None)
    reached = 0.0
    choice = None
    *head, (last, _) = weighted
    for value, weight in head:
        reached += weight / total
        hit = draw < F.lit(reached)
        value = value if isinstance(value, Column) else F.lit(value)
        choice = F.when(hit, value) if choice is None else choice.when(hit, value)
    last = last if isinstance(last, Column) else F.lit(last)
    return last if choice is None else choice.otherwise(last)
