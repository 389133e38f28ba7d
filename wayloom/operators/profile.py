"""Column profiles: distinct values, frequencies, histograms, quantiles, next key.

Value tables may be as large as the data, so none of them passes through one task: totals
are scalar subqueries and running positions are computed per hash bucket, with only the
bucket sizes (a fixed number of rows) summed in one place.
"""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayloom.functions.parse import currency_style

FIRST_KEY = 1000

# Three hex digits of a digest: the most rows any of the offset tables below can have.
BUCKET_DIGITS = 3


def distinct_values(table: DataFrame, column: str, name: str = "value") -> DataFrame:
    """Distinct values of a column, NULL left out."""
    return table.select(F.col(column).alias(name)).where(F.col(name).isNotNull()).distinct()


def value_counts(table: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """``(column, value, count)`` of several columns, values as text, NULL left out.

    One scan and one shuffle for all columns, with counts combined before the shuffle.
    """
    pairs = [
        F.struct(F.lit(name).alias("column"), value.cast("string").alias("value"))
        for name, value in columns.items()
    ]
    return (
        table.select(F.inline(F.array(*pairs)))
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count("*").alias("count"))
    )


def frequencies(table: DataFrame, column: str | Column, name: str = "value") -> DataFrame:
    """``(value, count, probability)`` of the values that are not NULL."""
    value = F.col(column) if isinstance(column, str) else column
    counts = (
        table.select(value.alias(name))
        .where(F.col(name).isNotNull())
        .groupBy(name)
        .agg(F.count("*").alias("count"))
    )
    total = counts.agg(F.sum("count")).scalar()
    return counts.withColumn("probability", F.col("count") / total)


def histogram(
    table: DataFrame, column: str, low: float, width: float, bins: int
) -> DataFrame:
    """``(bin, lo, hi, count, probability)`` for equal bins from ``low``.

    A bin holds its lower edge; the last one also its upper edge. Values outside are
    ignored. Empty bins are listed with 0.
    """
    high = low + width * bins
    value = F.col(column)
    bucket = F.when(value == high, bins - 1).otherwise(F.floor((value - low) / width))
    counts = (
        table.where(value.between(low, high))
        .groupBy(bucket.cast("int").alias("bin"))
        .agg(F.count("*").alias("count"))
    )
    every = table.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    filled = every.join(counts, "bin", "left").na.fill({"count": 0})
    # No more rows than bins: a window over all of them is safe.
    total = F.sum("count").over(Window.partitionBy(F.lit(0)))
    return filled.select(
        "bin",
        (F.col("bin") * width + low).alias("lo"),
        (F.col("bin") * width + low + width).alias("hi"),
        "count",
        F.coalesce(F.try_divide(F.col("count"), total), F.lit(0.0)).alias("probability"),
    )


def style_frequencies(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How often each way of writing an amount occurs, pooled over the columns."""
    texts = table.select(
        F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias("text")
    )
    return frequencies(texts.where(F.col("text").isNotNull()), currency_style(F.col("text")), "style")


def next_key(table: DataFrame, column: str, first: int = FIRST_KEY) -> DataFrame:
    """One row ``next_key``: the maximum plus one, or ``first`` for an empty table."""
    return table.agg(F.coalesce(F.max(column) + 1, F.lit(first)).cast("bigint").alias("next_key"))


# --- positions of values ----------------------------------------------------------------


def positions(counts: DataFrame, name: str = "value", by: Sequence[str] = ()) -> DataFrame:
    """The rows with ``index`` (0, 1, …) and the interval ``lo``, ``hi`` of their counts laid end to
    end, both in the order of the values' digests and for each ``by`` anew.

    One shuffle by (``by``, bucket of the digest) places all of them. The sizes of the buckets, at
    most 16^BUCKET_DIGITS for each ``by`` whatever the data holds, are summed up and broadcast.
    """
    digest = F.md5(F.col(name).cast("string"))
    bucketed = counts.withColumn("_digest", digest).withColumn(
        "_bucket", F.substring("_digest", 1, BUCKET_DIGITS)
    )
    sizes = bucketed.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"), F.sum("count").alias("_weight"))
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *by,
        "_bucket",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.coalesce(F.sum("_weight").over(earlier), F.lit(0)).alias("_offset"),
    )
    placed = bucketed.join(F.broadcast(offsets), [*by, "_bucket"])
    order = Window.partitionBy(*by, "_bucket").orderBy("_digest", name)
    hi = F.col("_offset") + F.sum("count").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    index = F.col("_before") + F.row_number().over(order) - 1
    return placed.select(
        *counts.columns,
        index.cast("bigint").alias("index"),
        (hi - F.col("count")).alias("lo"),
        hi.alias("hi"),
    )


def indexed_values(values: DataFrame, name: str = "value") -> DataFrame:
    """``(value, index)`` with indexes 0, 1, … in the order of the values' digests."""
    return positions(values.select(name, F.lit(1).alias("count")), name).select(name, "index")


def cumulative_intervals(counts: DataFrame, name: str = "value") -> DataFrame:
    """``(value, lo, hi)``: counts laid end to end, in the order of the values' digests."""
    return positions(counts.select(name, "count"), name).select(name, "lo", "hi")


# --- exact quantiles --------------------------------------------------------------------

ACCURACY = 10_000
SMALL = 100_000


@dataclass
class _Bracket:
    """Open interval that holds the value of one rank; ``below`` values are at or under ``lo``.
    None is an end that is not known yet."""

    rank: int
    inside: int
    below: int = 0
    lo: float | None = None
    hi: float | None = None
    answer: float | None = None


def quantiles(table: DataFrame, column: str, probabilities: Sequence[float]) -> list[float]:
    """Exact quantiles with linear interpolation, NULL and NaN ignored; empty input gives [].

    The built-in exact percentile keeps every distinct value in one task. Here the first full read
    counts the rows and asks a sketch for two values around each quantile; the second one counts
    exactly below and between them, about one row in ACCURACY / 4. What is between is then read
    through a filter that reaches the scan, where row groups without such values are skipped, and is
    narrowed in the same way until SMALL rows or fewer are left to sort. Two full reads are enough for
    any input, and a sketch that is wrong costs a further narrowing and not the result. Repeated
    values sit on the interval ends, where they are only counted.
    """
    if not probabilities:
        return []
    value = F.col(column).cast("double")
    values = table.select(value.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    step = 2.0 / ACCURACY
    ends = [e for p in probabilities for e in (max(p - step, 0.0), min(p + step, 1.0))]
    n, bounds = values.agg(F.count("x"), F.percentile_approx("x", ends, ACCURACY)).first()
    if n == 0:
        return []
    wanted = [(int(p * (n - 1)), p * (n - 1) - int(p * (n - 1))) for p in probabilities]
    near = {}
    for i, (rank, _) in enumerate(wanted):
        for r in (rank, min(rank + 1, n - 1)):
            near.setdefault(r, (bounds[2 * i], bounds[2 * i + 1]))
    found = _values_at(values, near, n)
    return [
        found[rank] + (found[min(rank + 1, n - 1)] - found[rank]) * part for rank, part in wanted
    ]


def _values_at(values: DataFrame, near: dict[int, tuple[float, float]], n: int) -> dict[int, float]:
    """The values of the ranks, each probably between the two that ``near`` gives."""
    brackets = [_Bracket(rank, n) for rank in sorted(near)]
    if n > SMALL:
        _settle(values, [(b, *near[b.rank]) for b in brackets])
    while pending := [b for b in brackets if b.answer is None and b.inside > SMALL]:
        step = 2.0 / ACCURACY
        # Brackets with the same ends share one sketch.
        shared: dict[tuple, list[_Bracket]] = {}
        for b in pending:
            shared.setdefault((b.lo, b.hi), []).append(b)
        asks = []
        for i, group in enumerate(shared.values()):
            at = [(b.rank - b.below + 0.5) / b.inside for b in group]
            ends = [e for p in at for e in (max(p - step, 0.0), min(p + step, 1.0))]
            sketch = F.percentile_approx(_inside(group[0]), ends, ACCURACY)
            asks.append(sketch.alias(f"q{i}"))
        narrower = []
        for group, bounds in zip(shared.values(), _between(values, pending).agg(*asks).first()):
            narrower += [(b, bounds[2 * k], bounds[2 * k + 1]) for k, b in enumerate(group)]
        _settle(_between(values, pending), narrower)
    rest = [b for b in brackets if b.answer is None]
    if rest:
        # At most SMALL values each; brackets with the same ends share one list.
        lists = {(b.lo, b.hi): F.sort_array(F.collect_list(_inside(b))) for b in rest}
        picks = [
            F.get(lists[b.lo, b.hi], F.lit(b.rank - b.below)).alias(f"v{i}")
            for i, b in enumerate(rest)
        ]
        for b, answer in zip(rest, _between(values, rest).agg(*picks).first()):
            b.answer = answer
    return {b.rank: b.answer for b in brackets}


def _open(b: _Bracket) -> Column:
    x = F.col("x")
    tests = [x > F.lit(b.lo)] if b.lo is not None else []
    tests += [x < F.lit(b.hi)] if b.hi is not None else []
    return reduce(operator.and_, tests, F.lit(True))


def _inside(b: _Bracket) -> Column:
    return F.when(_open(b), F.col("x"))


def _between(values: DataFrame, brackets: list[_Bracket]) -> DataFrame:
    """Only the rows between the ends of any bracket: comparisons that the scan can use."""
    distinct = {(b.lo, b.hi): b for b in brackets}
    return values.where(reduce(operator.or_, map(_open, distinct.values())))


def _settle(values: DataFrame, narrower: list[tuple[_Bracket, float, float]]) -> None:
    """Count around the two values given for each bracket, which then holds its rank between or
    beside them; answers ranks that fall on one of them."""
    x = F.col("x")
    counts = values.agg(
        *[
            F.count_if(_open(b) & test).alias(f"c{i}{k}")
            for i, (b, lo, hi) in enumerate(narrower)
            for k, test in enumerate(
                (x < F.lit(lo), x <= F.lit(lo), x < F.lit(hi), x <= F.lit(hi))
            )
        ]
    ).first()
    for i, (b, lo, hi) in enumerate(narrower):
        under, upto_lo, under_hi, upto_hi = (b.below + c for c in counts[4 * i : 4 * i + 4])
        if b.rank < under:
            b.hi, b.inside = lo, under - b.below
        elif b.rank < upto_lo:
            b.answer = lo
        elif b.rank < under_hi:
            b.lo, b.hi, b.below, b.inside = lo, hi, upto_lo, under_hi - upto_lo
        elif b.rank < upto_hi:
            b.answer = hi
        else:
            b.lo, b.below, b.inside = hi, upto_hi, b.below + b.inside - upto_hi
