"""Row synthesis from a profile.

``spark.range(n)`` plus hash draws: rows do not depend on partitioning, retries or on each
other, so any number of them is generated in parallel. Values drawn from data are looked up
by equality joins whose keys are uniform by construction, so no value, however frequent, is a
hot key; Spark broadcasts the value table when it is small enough.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.functions import draws
from wayloom.functions.parse import (
    STYLE_DOLLAR,
    STYLE_DOLLAR_COMMAS,
    STYLE_PLAIN,
    STYLE_USD,
    end_date,
    format_currency,
    format_us_date,
    parse_currency,
    parse_number,
    round_to_tens,
)
from wayloom.operators import profile as prof
from wayloom.operators.clean import drop_empty_rows, or_default
from wayloom.schemas import TRIP_COLUMNS
from wayloom.session import stage
from wayloom.sources import reference_lists as lists

# Defaults of a batch.
BATCH_SIZE = 20
DATE_RANGE_FUTURE = 180
DATE_RANGE_PAST = 180
PAST_DATE_RATIO = 0.3

# Fixed value: length of a trip whose own cannot be read.
DEFAULT_DURATION = 7.0

# Ages are profiled in ten bins of five years from 18.
AGE_LOW, AGE_WIDTH, AGE_BINS = 18, 5, 10

# How likely a cost falls between two neighbouring quartile marks.
COST_BAND_WEIGHTS = (0.2, 0.3, 0.3, 0.2)

# Cost tiers as (name, weight, low, high).
ACCOMMODATION_TIERS = (
    ("budget", 0.2, 200, 500),
    ("mid-range", 0.5, 500, 1200),
    ("luxury", 0.2, 1200, 2000),
    ("ultra-luxury", 0.1, 2000, 5000),
)
TRANSPORTATION_TIERS = (
    ("local", 0.1, 50, 200),
    ("regional", 0.3, 200, 500),
    ("international", 0.5, 500, 1000),
    ("premium", 0.1, 1000, 2000),
)

# How often each way of writing a tiered cost is used.
STYLE_WEIGHTS = (
    (STYLE_PLAIN, 0.3),
    (STYLE_DOLLAR, 0.3),
    (STYLE_DOLLAR_COMMAS, 0.2),
    (STYLE_USD, 0.2),
)

# Bounds of a raw cost, a tiered trip's length and a tiered traveller's age.
RAW_COST_RANGE = (50.0, 3000.0)
TIERED_DURATION_RANGE = (3, 14)
TIERED_AGE_RANGE = (18, 75)
GENDERS = ("Male", "Female")

SAMPLED_COLUMNS = (
    "Destination",
    "Traveler name",
    "Traveler nationality",
    "Accommodation type",
    "Transportation type",
)
COST_COLUMNS = ("Accommodation cost", "Transportation cost")


@dataclass
class TripProfile:
    """What the synthesis needs to know about existing trips.

    ``values`` and ``durations``, ``(value, count, index, lo, hi)`` as ``profile.positions`` gives
    them, may be large and stay tables; the rest is a handful of numbers: ten bins, five marks per
    cost column, four styles, and for each column how many values it has and how often in all.
    """

    values: dict[str, DataFrame]
    durations: DataFrame
    ages: list[tuple[float, float]]
    cost_marks: dict[str, list[float]] = field(default_factory=dict)
    styles: list[tuple[str, float]] = field(default_factory=list)
    first_id: int = prof.FIRST_KEY
    sizes: dict[str, tuple[int, int]] = field(default_factory=dict)


def profile_trips(trips: DataFrame, parse_costs: bool = False) -> TripProfile:
    """Profile of raw trips.

    With ``parse_costs`` amounts are parsed for their quartile marks, and a trip whose length
    cannot be read counts as the default length instead of not at all.
    """
    # Read and parsed once: the passes below then fetch only their own columns.
    parsed = {f"_{c}": parse_currency(F.col(c)) for c in COST_COLUMNS} if parse_costs else {}
    trips = stage(drop_empty_rows(trips, TRIP_COLUMNS).withColumns(parsed))
    length = parse_number(F.col("Duration (days)"))
    if parse_costs:
        length = or_default(length, DEFAULT_DURATION)
    # The value tables are read by every batch: counted and placed once for all columns together,
    # one folder each.
    counts = prof.value_counts(
        trips,
        {c: F.col(c) for c in SAMPLED_COLUMNS} | {"Duration (days)": F.floor(length).cast("int")},
    ).select("column", "value", "count")
    placed = stage(prof.positions(counts, by=["column"]), partition_by="column")
    # One row for each column.
    sums = placed.groupBy("column").agg(F.count("*").alias("size"), F.sum("count").alias("total"))
    sizes = {r["column"]: (r["size"], r["total"]) for r in sums.collect()}

    def of(column: str) -> DataFrame:
        return placed.where(F.col("column") == column).drop("column")

    aged = trips.withColumn("_age", parse_number(F.col("Traveler age")))
    ages = prof.histogram(aged, "_age", AGE_LOW, AGE_WIDTH, AGE_BINS)
    styles = prof.style_frequencies(trips, COST_COLUMNS)
    key = prof.next_key(trips.select(F.col("Trip ID").cast("bigint").alias("id")), "id")
    marks = {}
    if parse_costs:
        at = (0.0, 0.25, 0.5, 0.75, 1.0)
        marks = {c: prof.quantiles(trips, f"_{c}", at) for c in COST_COLUMNS}
    return TripProfile(
        values={c: of(c) for c in SAMPLED_COLUMNS},
        durations=of("Duration (days)").withColumn("value", F.col("value").cast("int")),
        sizes=sizes,
        # Four styles and ten bins at most: small results by definition.
        ages=[(r["lo"], r["probability"]) for r in ages.orderBy("bin").collect()],
        styles=[(r["style"], r["probability"]) for r in styles.orderBy("style").collect()],
        cost_marks=marks,
        first_id=key.first()["next_key"],
    )


#: Cells of one value that are listed at once.
CELL_BLOCK = 4096

# --- draws from value tables ------------------------------------------------------------


def draw_value(
    rows: DataFrame,
    draw: Column,
    values: DataFrame,
    name: str,
    value: str = "value",
    size: int | None = None,
) -> DataFrame:
    """Add ``name``: an equal-chance draw from the values, by dense index.

    With ``size``, how many there are, the values have their ``index`` already.
    """
    if size is None:
        values, size = prof.indexed_values(values, value), values.count()
    slot = F.floor(draw * size).cast("bigint")
    lookup = values.select(F.col(value).alias(name), F.col("index").alias("_slot"))
    return rows.withColumn("_slot", slot).join(lookup, "_slot", "left").drop("_slot")


def draw_weighted(
    rows: DataFrame,
    draw: Column,
    counts: DataFrame,
    name: str,
    value: str = "value",
    size: tuple[int, int] | None = None,
) -> DataFrame:
    """Add ``name``: a draw weighted by ``counts.count``, exact for any number of values.

    Counts laid end to end make intervals of [0, N). The range is cut into as many equal cells as
    there are values, each interval is listed once per cell it touches (at most twice as many rows
    as values), and draws find theirs by the cell as equality key and the interval as filter. A
    value with a third of the weight owns a third of the cells: the join keys stay uniform.

    With ``size``, the number of values and the sum of their counts, they have ``lo`` and ``hi``.
    """
    if size is None:
        size = tuple(counts.agg(F.count("*"), F.coalesce(F.sum("count"), F.lit(0))).first())
        counts = prof.cumulative_intervals(counts, value)
    values, total = size
    width = max(1, -(-total // max(1, values)))
    # Listed in two steps: no row holds an array of more than a block of cells, or of blocks.
    first, last = F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width)
    blocks = counts.withColumns({"_first": first, "_last": last})
    blocks = blocks.withColumn(
        "_block",
        F.explode(F.sequence(F.floor(F.col("_first") / CELL_BLOCK), F.floor(F.col("_last") / CELL_BLOCK))),
    )
    start = F.greatest(F.col("_first"), F.col("_block") * CELL_BLOCK)
    end = F.least(F.col("_last"), F.col("_block") * CELL_BLOCK + (CELL_BLOCK - 1))
    cells = blocks.withColumn("_cell", F.explode(F.sequence(start, end))).select(
        F.col(value).alias(name), "lo", "hi", "_cell"
    )
    placed = rows.withColumn("_at", F.floor(draw * total).cast("bigint")).withColumn(
        "_cell", F.floor(F.col("_at") / width)
    )
    on = [
        placed["_cell"] == cells["_cell"],
        placed["_at"] >= cells["lo"],
        placed["_at"] < cells["hi"],
    ]
    return placed.join(cells, on, "left").drop("_cell", "_at", "lo", "hi")


# --- fields -----------------------------------------------------------------------------


def start_day(row_id: Column, as_of: dt.date, seed: int, past_ratio: float, future: int) -> Column:
    """A past day with the given chance, else a future one; ``as_of`` stands for today."""
    back = draws.uniform_int(draws.uniform(row_id, "days_back", seed), 1, DATE_RANGE_PAST)
    ahead = draws.uniform_int(draws.uniform(row_id, "days_ahead", seed), 1, future)
    today = F.lit(as_of)
    is_past = draws.uniform(row_id, "is_past", seed) < past_ratio
    return F.when(is_past, F.date_sub(today, back)).otherwise(F.date_add(today, ahead))


def profiled_age(row_id: Column, ages: list[tuple[float, float]], seed: int) -> Column:
    weighted = [(int(lo), p) for lo, p in ages]
    low = draws.pick_weighted(draws.uniform(row_id, "age_bin", seed), weighted).cast("int")
    return low + draws.uniform_int(draws.uniform(row_id, "age_in_bin", seed), 0, AGE_WIDTH - 1)


def banded_cost(row_id: Column, name: str, marks: list[float], seed: int) -> Column:
    """Cost uniform between two neighbouring marks (minimum, quartiles, maximum), in tens.

    NULL where no cost was there to profile.
    """
    if not marks:
        return F.lit(None).cast("double")
    bands = list(zip(marks, marks[1:]))
    band_draw = draws.uniform(row_id, f"{name} band", seed)
    low = draws.pick_weighted(band_draw, [(b[0], w) for b, w in zip(bands, COST_BAND_WEIGHTS)])
    span = draws.pick_weighted(
        band_draw, [(b[1] - b[0], w) for b, w in zip(bands, COST_BAND_WEIGHTS)]
    )
    return round_to_tens(low + span * draws.uniform(row_id, f"{name} in band", seed))


def tiered_cost(row_id: Column, name: str, tiers: tuple, seed: int) -> Column:
    inside = draws.uniform(row_id, f"{name} in tier", seed)
    return draws.pick_weighted(
        draws.uniform(row_id, f"{name} tier", seed),
        [(draws.uniform_int(inside, low, high), weight) for _, weight, low, high in tiers],
    )


def styled(row_id: Column, name: str, amount: Column, styles, seed: int, decimals: int) -> Column:
    style = draws.pick_weighted(draws.uniform(row_id, f"{name} style", seed), list(styles))
    return format_currency(amount, style, decimals)


# --- batches ----------------------------------------------------------------------------


def _ids(spark: SparkSession, n: int, first_id: int) -> DataFrame:
    return spark.range(first_id, first_id + n).withColumnRenamed("id", "Trip ID")


def _from_profile(
    spark: SparkSession, profile: TripProfile, n: int, as_of: dt.date, seed: int, **dates
) -> DataFrame:
    row = F.col("Trip ID")
    rows = draw_weighted(
        _ids(spark, n, profile.first_id),
        draws.uniform(row, "duration", seed),
        profile.durations,
        "Duration (days)",
        size=profile.sizes.get("Duration (days)", (0, 0)),
    )
    for column in SAMPLED_COLUMNS:
        size, _ = profile.sizes.get(column, (0, 0))
        rows = draw_value(rows, draws.uniform(row, column, seed), profile.values[column], column, size=size)
    start = start_day(
        row,
        as_of,
        seed,
        dates.get("past_ratio", PAST_DATE_RATIO),
        dates.get("future_days", DATE_RANGE_FUTURE),
    )
    return rows.withColumns(
        {
            "Start date": format_us_date(start),
            "End date": format_us_date(end_date(start, F.col("Duration (days)"))),
            "Traveler age": profiled_age(row, profile.ages, seed),
            "Traveler gender": draws.pick(draws.uniform(row, "gender", seed), GENDERS),
        }
    )


def synthesize(
    spark: SparkSession,
    profile: TripProfile,
    as_of: dt.date,
    n: int = BATCH_SIZE,
    seed: int = 0,
    **dates,
) -> DataFrame:
    """Trips like the profiled ones, costs as numbers drawn from the quartile bands."""
    rows = _from_profile(spark, profile, n, as_of, seed, **dates)
    costs = {
        c: banded_cost(F.col("Trip ID"), c, profile.cost_marks[c], seed) for c in COST_COLUMNS
    }
    return rows.withColumns(costs).select(*TRIP_COLUMNS)


def synthesize_raw(
    spark: SparkSession,
    profile: TripProfile,
    as_of: dt.date,
    n: int = BATCH_SIZE,
    seed: int = 0,
    **dates,
) -> DataFrame:
    """Trips like the profiled ones, costs uniform and written in the styles seen."""
    row = F.col("Trip ID")
    low, high = RAW_COST_RANGE
    rows = _from_profile(spark, profile, n, as_of, seed, **dates)
    costs = {}
    for c in COST_COLUMNS:
        amount = round_to_tens(draws.uniform(row, c, seed) * (high - low) + low)
        costs[c] = styled(row, c, amount, profile.styles, seed, decimals=1)
    return rows.withColumns(costs).select(*TRIP_COLUMNS)


def synthesize_tiered(
    spark: SparkSession,
    as_of: dt.date,
    first_id: int = prof.FIRST_KEY,
    n: int = BATCH_SIZE,
    seed: int = 0,
    past_ratio: float = PAST_DATE_RATIO,
    future_days: int = DATE_RANGE_FUTURE,
) -> DataFrame:
    """Trips from the built-in lists and cost tiers alone; no profile, no join."""
    row = F.col("Trip ID")
    start = start_day(row, as_of, seed, past_ratio, future_days)
    duration = draws.uniform_int(draws.uniform(row, "duration", seed), *TIERED_DURATION_RANGE)
    gender = draws.pick(draws.uniform(row, "gender", seed), GENDERS)

    def listed(name: str, values) -> Column:
        return draws.pick(draws.uniform(row, name, seed), values)

    def cost(name: str, tiers) -> Column:
        amount = tiered_cost(row, name, tiers, seed)
        return styled(row, name, amount, STYLE_WEIGHTS, seed, decimals=0)

    given = F.when(gender == "Male", listed("given name", lists.MALE_NAMES)).otherwise(
        listed("given name", lists.FEMALE_NAMES)
    )
    return _ids(spark, n, first_id).select(
        "Trip ID",
        listed("Destination", lists.TRIP_DESTINATIONS).alias("Destination"),
        format_us_date(start).alias("Start date"),
        format_us_date(end_date(start, duration)).alias("End date"),
        duration.alias("Duration (days)"),
        F.concat_ws(" ", given, listed("family name", lists.FAMILY_NAMES)).alias("Traveler name"),
        draws.uniform_int(draws.uniform(row, "age", seed), *TIERED_AGE_RANGE).alias("Traveler age"),
        gender.alias("Traveler gender"),
        listed("Traveler nationality", lists.NATIONALITIES).alias("Traveler nationality"),
        listed("Accommodation type", lists.ACCOMMODATION_TYPES).alias("Accommodation type"),
        cost("Accommodation cost", ACCOMMODATION_TIERS).alias("Accommodation cost"),
        listed("Transportation type", lists.TRANSPORTATION_TYPES).alias("Transportation type"),
        cost("Transportation cost", TRANSPORTATION_TIERS).alias("Transportation cost"),
    )
