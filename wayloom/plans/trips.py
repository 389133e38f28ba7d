"""Trips: cleaning and the shape of the warehouse table."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.functions.parse import (
    currency_is_malformed,
    date_is_malformed,
    format_iso_date,
    is_blank,
    parse_currency,
    parse_date,
    parse_integer,
    parse_number,
)
from wayloom.operators.clean import (
    drop_columns,
    drop_empty_rows,
    fill_constants,
    or_default,
    rename_columns,
)
from wayloom.operators.profile import next_key
from wayloom.operators.synth import (
    BATCH_SIZE,
    COST_COLUMNS,
    DEFAULT_DURATION,
    profile_trips,
    synthesize,
    synthesize_raw,
    synthesize_tiered,
)
from wayloom.schemas import TRIP_COLUMNS, TRIPS_TABLE

DATE_COLUMNS = ("Start date", "End date")

# What stands in for a missing category.
UNKNOWN = {
    "Traveler gender": "Unknown",
    "Traveler nationality": "Unknown",
    "Accommodation type": "Unknown",
    "Transportation type": "Unknown",
}

# The table's column names have no blanks, and no brackets around a unit.
TABLE_NAMES = {c: re.sub(r"[()]", "", c).replace(" ", "_") for c in TRIP_COLUMNS if " " in c}


def clean_trips(raw: DataFrame, on_error: str = "fail") -> DataFrame:
    """Parsed costs, durations, ages and ISO dates; categories never missing.

    One projection over the scan. ``on_error`` says what text without an amount in a cost
    column does: stop the job, or become NULL.
    """
    parsed = drop_empty_rows(raw, TRIP_COLUMNS).withColumns(
        {c: parse_currency(F.col(c), on_error) for c in COST_COLUMNS}
        | {
            "Duration (days)": or_default(
                parse_number(F.col("Duration (days)")), DEFAULT_DURATION
            ),
            "Traveler age": parse_number(F.col("Traveler age")),
        }
        | {c: format_iso_date(parse_date(F.col(c))) for c in DATE_COLUMNS}
    )
    return fill_constants(parsed, UNKNOWN)


def to_warehouse(
    trips: DataFrame,
    ingested_at: Column | None = None,
    source_file: Column | None = None,
    on_error: str = "fail",
) -> DataFrame:
    """Raw or cleaned trips in the columns and types of the trips table.

    Here a date that cannot be read is an error like a cost, not a NULL.
    """
    dated = trips.withColumns(
        {
            "Start_date": parse_date(F.col("Start date"), on_error=on_error),
            "End_date": parse_date(F.col("End date"), on_error=on_error),
        }
    )
    names = {c: n for c, n in TABLE_NAMES.items() if c not in DATE_COLUMNS}
    named = rename_columns(drop_columns(dated, *DATE_COLUMNS), names)
    typed = named.withColumns(
        {
            "Accommodation_cost": parse_currency(F.col("Accommodation_cost"), on_error),
            "Transportation_cost": parse_currency(F.col("Transportation_cost"), on_error),
            "Trip_ID": parse_integer(F.col("Trip_ID")),
            "Duration_days": parse_integer(F.col("Duration_days")),
            "Traveler_age": parse_integer(F.col("Traveler_age")),
            "Ingestion_timestamp": F.current_timestamp() if ingested_at is None else ingested_at,
            "Source_file": F.lit(None).cast("string") if source_file is None else source_file,
        }
    )
    return typed.select(*[F.col(f.name).cast(f.dataType) for f in TRIPS_TABLE.fields])


def is_malformed() -> Column:
    """True for a raw trip the table cannot take: no id, or a cost or date nobody can read."""
    problem = is_blank(F.col("Trip ID")) | parse_integer(F.col("Trip ID")).isNull()
    for c in COST_COLUMNS:
        problem = problem | currency_is_malformed(F.col(c))
    for c in DATE_COLUMNS:
        problem = problem | date_is_malformed(F.col(c))
    return F.coalesce(problem, F.lit(True))


def generate(
    spark: SparkSession,
    method: str,
    sample: DataFrame | None,
    as_of: dt.date,
    n: int = BATCH_SIZE,
    seed: int = 0,
) -> DataFrame:
    """A batch of trips by ``distribution``, ``raw`` (both need a sample) or ``tiered``."""
    if method == "tiered":
        if sample is None:
            return synthesize_tiered(spark, as_of, n=n, seed=seed)
        ids = sample.select(parse_integer(F.col("Trip ID")).alias("id"))
        first = next_key(ids, "id").first()["next_key"]
        return synthesize_tiered(spark, as_of, first_id=first, n=n, seed=seed)
    if sample is None:
        raise ValueError(f"method {method!r} needs a sample")
    if method == "raw":
        return synthesize_raw(spark, profile_trips(sample), as_of, n=n, seed=seed)
    if method == "distribution":
        profile = profile_trips(sample, parse_costs=True)
        return synthesize(spark, profile, as_of, n=n, seed=seed)
    raise ValueError(f"unknown method {method!r}")
