"""Declared schemas of the three flows."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, LONG, DOUBLE = T.StringType(), T.LongType(), T.DoubleType()
DATE, TIMESTAMP = T.DateType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# --- trips ------------------------------------------------------------------------------

TRIP_COLUMNS = (
    "Trip ID",
    "Destination",
    "Start date",
    "End date",
    "Duration (days)",
    "Traveler name",
    "Traveler age",
    "Traveler gender",
    "Traveler nationality",
    "Accommodation type",
    "Accommodation cost",
    "Transportation type",
    "Transportation cost",
)

# Read as text: parsing is an explicit step and not an accident of inference.
TRIPS_RAW = T.StructType([T.StructField(name, STRING) for name in TRIP_COLUMNS])

TRIPS_TABLE = T.StructType(
    [
        T.StructField("Trip_ID", LONG, nullable=False),
        T.StructField("Destination", STRING),
        T.StructField("Start_date", DATE),
        T.StructField("End_date", DATE),
        T.StructField("Duration_days", LONG),
        T.StructField("Traveler_name", STRING),
        T.StructField("Traveler_age", LONG),
        T.StructField("Traveler_gender", STRING),
        T.StructField("Traveler_nationality", STRING),
        T.StructField("Accommodation_type", STRING),
        T.StructField("Accommodation_cost", DOUBLE),
        T.StructField("Transportation_type", STRING),
        T.StructField("Transportation_cost", DOUBLE),
        T.StructField("Ingestion_timestamp", TIMESTAMP),
        T.StructField("Source_file", STRING),
    ]
)

# --- destinations -----------------------------------------------------------------------

PAGE = T.StructType(
    [
        T.StructField("destination_name", STRING),
        T.StructField("url", STRING),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("headers", T.MapType(STRING, STRING)),
        T.StructField("content", STRING),
        T.StructField("encoding", STRING),
    ]
)

ATTRACTION = _struct(name=STRING, description=STRING, image_url=STRING, type=STRING)

DESTINATION_RECORD = _struct(
    destination_name=STRING,
    description=STRING,
    coordinates=_struct(latitude=DOUBLE, longitude=DOUBLE),
    country=STRING,
    population=_struct(count=LONG, year=LONG),
    timezone=STRING,
    languages=T.ArrayType(STRING),
    climate=STRING,
    image_url=STRING,
    sections=T.ArrayType(STRING),
    attractions=T.ArrayType(ATTRACTION),
)

DESTINATIONS_TABLE = _struct(
    destination_name=STRING,
    description=STRING,
    country=STRING,
    latitude=DOUBLE,
    longitude=DOUBLE,
    population_count=LONG,
    population_year=LONG,
    timezone=STRING,
    languages=STRING,
    climate=STRING,
    image_url=STRING,
    sections=STRING,
    area_km2=DOUBLE,
    region=STRING,
    attractions_count=LONG,
    attractions=STRING,
    ingestion_timestamp=TIMESTAMP,
)

# Declared field rules for validation: name -> (type, mode).
DESTINATION_RULES: dict[str, tuple[str, str]] = {
    "destination": ("STRING", "REQUIRED"),
    "country": ("STRING", "REQUIRED"),
    "description": ("STRING", "REQUIRED"),
    "attractions": ("RECORD", "REPEATED"),
    "rating": ("FLOAT", "NULLABLE"),
    "reviews_count": ("INTEGER", "NULLABLE"),
    "weather": ("RECORD", "NULLABLE"),
    "has_beaches": ("BOOLEAN", "NULLABLE"),
    "updated_at": ("TIMESTAMP", "NULLABLE"),
}

# --- weather ----------------------------------------------------------------------------

FORECAST_DAY = _struct(
    dt=LONG,
    temp=_struct(max=DOUBLE, min=DOUBLE, day=DOUBLE, night=DOUBLE),
    feels_like=_struct(day=DOUBLE, night=DOUBLE),
    humidity=DOUBLE,
    wind_speed=DOUBLE,
    weather=T.ArrayType(_struct(main=STRING, description=STRING, icon=STRING)),
    pop=DOUBLE,
    rain=DOUBLE,
    uvi=DOUBLE,
    clouds=DOUBLE,
    sunrise=LONG,
    sunset=LONG,
)

FORECAST_PAYLOAD = _struct(
    city=STRING,
    country=STRING,
    latitude=DOUBLE,
    longitude=DOUBLE,
    response=_struct(daily=T.ArrayType(FORECAST_DAY)),
)

WEATHER_TABLE = _struct(
    city=STRING,
    country=STRING,
    latitude=DOUBLE,
    longitude=DOUBLE,
    forecast_date=DATE,
    forecast_timestamp=TIMESTAMP,
    max_temp=DOUBLE,
    min_temp=DOUBLE,
    day_temp=DOUBLE,
    night_temp=DOUBLE,
    feels_like_day=DOUBLE,
    feels_like_night=DOUBLE,
    humidity=DOUBLE,
    wind_speed=DOUBLE,
    weather_main=STRING,
    weather_description=STRING,
    weather_icon=STRING,
    precipitation_probability=DOUBLE,
    rain=DOUBLE,
    uvi=DOUBLE,
    clouds=DOUBLE,
    sunrise=TIMESTAMP,
    sunset=TIMESTAMP,
    ingestion_timestamp=TIMESTAMP,
    logical_key=STRING,
)
