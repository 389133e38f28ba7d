"""Weather: nested daily forecasts to one row per place and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayloom.functions.binding import let
from wayloom.functions.parse import epoch_to_timestamp, epoch_to_utc_date, logical_key
from wayloom.operators.clean import FORECAST_DAYS_RANGE, or_default, split_by
from wayloom.operators.quality import defaults_filled
from wayloom.schemas import FORECAST_PAYLOAD, WEATHER_TABLE
from wayloom.session import spread
from wayloom.sources.reference_lists import FORECAST_DAYS

# Output field and payload field of the values that default to 0.
ZERO_DEFAULTS = {
    "precipitation_probability": "pop",
    "rain": "rain",
    "uvi": "uvi",
    "clouds": "clouds",
}


def parse_payloads(
    table: DataFrame, text: str = "payload", partitions: int | None = None
) -> DataFrame:
    """Payload columns from one column of JSON text; ``partitions`` deals few files over tasks.

    Unpacked by a generator, which later filters cannot be pushed through: pushed below the
    parse they would parse every text again.
    """
    parsed = F.from_json(F.col(text), FORECAST_PAYLOAD)
    return spread(table, partitions).select(*[c for c in table.columns if c != text], F.inline(F.array(parsed)))


def with_and_without_forecast(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Payloads that hold a daily forecast, and the others for the log."""
    return split_by(payloads, F.col("response.daily").isNotNull())


def _unusable(day: Column) -> Column:
    """A day no row can be made of: an entry every row needs is not there."""
    return (
        day["dt"].isNull()
        | day["temp"].isNull()
        | day["feels_like"].isNull()
        | F.coalesce(F.size(day["weather"]) < 1, F.lit(True))
        | day["sunrise"].isNull()
        | day["sunset"].isNull()
    )


def _usable_prefix(days: Column) -> Column:
    """Days before the first unusable one: that one ends its place's forecast."""
    flags = F.transform(days, _unusable)
    return let(
        F.nullif(F.array_position(flags, F.lit(True)).cast("int"), F.lit(0)),
        lambda stop: F.slice(days, F.lit(1), F.coalesce(stop - 1, F.size(days))),
    )


def check_days(days: int) -> None:
    low, high = FORECAST_DAYS_RANGE
    if not low <= days <= high:
        raise ValueError(f"days must be {low} to {high}, not {days}")


def cut_days(payloads: DataFrame, days: int = FORECAST_DAYS) -> DataFrame:
    """Wanted days that became no rows because of an unusable day before them or themselves:
    ``(city, country, day_no, unusable, d)``."""
    check_days(days)
    wanted, _ = with_and_without_forecast(payloads)
    cut = wanted.withColumn("_days", F.slice(F.col("response.daily"), 1, days))
    used = cut.withColumn("_used", F.size(_usable_prefix(F.col("_days"))))
    # Taken within the row: days that are used never become rows.
    rest = F.slice(F.col("_days"), F.col("_used") + 1, F.size("_days"))
    rows = used.select("city", "country", "_used", F.posexplode_outer(rest).alias("_after", "d"))
    return rows.where(F.col("_after").isNotNull()).select(
        "city",
        "country",
        (F.col("_used") + F.col("_after")).alias("day_no"),
        _unusable(F.col("d")).alias("unusable"),
        "d",
    )


def forecast_days(payloads: DataFrame, days: int = FORECAST_DAYS) -> DataFrame:
    """One row per place and day with the day's entry as ``d``; the envelope is repeated.

    The array is cut before it is exploded, so days beyond the wanted ones never become rows.
    """
    check_days(days)
    wanted, _ = with_and_without_forecast(payloads)
    cut = wanted.withColumn("_days", F.slice(F.col("response.daily"), 1, days))
    usable = cut.withColumn("_days", _usable_prefix(F.col("_days"))).drop("response")
    columns = [c for c in usable.columns if c != "_days"]
    # The outer form draws no filter on the array, which would compute the array twice.
    rows = usable.select(*columns, F.posexplode_outer("_days").alias("day_no", "d"))
    return rows.where(F.col("day_no").isNotNull())


def forecast_rows(
    payloads: DataFrame, days: int = FORECAST_DAYS, ingested_at: Column | None = None
) -> DataFrame:
    """The 25 columns of the weather table."""
    d = F.col("d")
    day = epoch_to_utc_date(d["dt"])
    weather = F.get(d["weather"], 0)
    values = {
        "city": F.col("city"),
        "country": F.col("country"),
        "latitude": F.col("latitude"),
        "longitude": F.col("longitude"),
        "forecast_date": day,
        "forecast_timestamp": epoch_to_timestamp(d["dt"]),
        "max_temp": d["temp"]["max"],
        "min_temp": d["temp"]["min"],
        "day_temp": d["temp"]["day"],
        "night_temp": d["temp"]["night"],
        "feels_like_day": d["feels_like"]["day"],
        "feels_like_night": d["feels_like"]["night"],
        "humidity": d["humidity"],
        "wind_speed": d["wind_speed"],
        "weather_main": weather["main"],
        "weather_description": weather["description"],
        "weather_icon": weather["icon"],
        **{out: or_default(d[field], 0.0) for out, field in ZERO_DEFAULTS.items()},
        "sunrise": epoch_to_timestamp(d["sunrise"]),
        "sunset": epoch_to_timestamp(d["sunset"]),
        "ingestion_timestamp": F.current_timestamp() if ingested_at is None else ingested_at,
        "logical_key": logical_key(
            F.col("city"), F.col("country"), F.date_format(day, "yyyy-MM-dd")
        ),
    }
    return forecast_days(payloads, days).select(
        *[values[f.name].cast(f.dataType).alias(f.name) for f in WEATHER_TABLE.fields]
    )


def filled_defaults(payloads: DataFrame, days: int = FORECAST_DAYS) -> DataFrame:
    """How often each of the four zero defaults was used, ``(field, filled)``."""
    fields = {out: F.col("d")[field] for out, field in ZERO_DEFAULTS.items()}
    return defaults_filled(forecast_days(payloads, days), fields)


def location_completeness(payloads: DataFrame, days: int = FORECAST_DAYS) -> DataFrame:
    """Expected, available, fetched and missing days of every place with a forecast.

    Fetched are the days that become rows: wanted ones before the first unusable one.
    """
    check_days(days)
    wanted, _ = with_and_without_forecast(payloads)
    available = F.size("response.daily")
    fetched = F.size(_usable_prefix(F.slice(F.col("response.daily"), 1, days)))
    return wanted.select(
        "city",
        "country",
        F.lit(days).alias("expected_days"),
        available.alias("available_days"),
        fetched.alias("fetched_days"),
        F.greatest(F.lit(days) - fetched, F.lit(0)).alias("missing_days"),
    )


def label_utc(table: DataFrame) -> DataFrame:
    """Give ``forecast_date`` and every ``*time*`` column without a zone the zone UTC.

    Values are labelled, not shifted, whatever the session zone is.
    """
    casts = {}
    for f in table.schema.fields:
        named = f.name == "forecast_date" or "time" in f.name.lower()
        if named and isinstance(f.dataType, (T.DateType, T.TimestampNTZType)):
            wall = F.col(f.name).cast("timestamp_ntz").cast("string")
            casts[f.name] = F.concat(wall, F.lit("Z")).cast("timestamp")
    return table.withColumns(casts) if casts else table
