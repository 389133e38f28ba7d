"""Nested forecasts, keys, and completeness on the given tables."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.functions import parse
from wayloom.operators import quality
from wayloom.plans import weather
from wayloom.session import spread, stage
from wayloom.suite.inputs import cores, table

STAMP = dt.datetime(2024, 1, 5, 12, 0, tzinfo=dt.timezone.utc)
DAYS = 3


def payload_text(spark: SparkSession, folder: str) -> DataFrame:
    """Every order as a forecast payload in JSON text.

    The place is the customer, the first day the order date. How many days a payload holds
    goes by the priority; orders in process have no forecast, and a low balance of the order
    leaves gaps in rain and clouds.
    """
    first = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    price = F.col("o_totalprice")
    length = F.substring("o_orderpriority", 1, 1).cast("int")
    cheap = price < 100_000

    def day(i: Column) -> Column:
        at = first + i.cast("bigint") * 86400
        return F.struct(
            at.alias("dt"),
            F.struct(
                (i + 20.5).alias("max"),
                (i - 3.25).alias("min"),
                price.alias("day"),
                F.lit(1.0).alias("night"),
            ).alias("temp"),
            F.struct(F.lit(2.5).alias("day"), (i * 0.5).alias("night")).alias("feels_like"),
            F.when(~cheap, i * 10.0).alias("humidity"),
            F.lit(4.0).alias("wind_speed"),
            # From the fourth day on a cheap order has no weather entry: that ends its forecast.
            F.when(
                cheap & (i >= 2), F.array().cast("array<struct<main:string>>")
            ).otherwise(F.array(F.struct(F.col("o_orderpriority").alias("main")))).alias("weather"),
            F.when(i != 1, i * 0.25).alias("pop"),
            F.when(~cheap, F.lit(3.5)).alias("rain"),
            F.lit(5.0).alias("uvi"),
            F.when(~cheap, i * 1.0).alias("clouds"),
            (at + 21600).alias("sunrise"),
            (at + 64800).alias("sunset"),
            F.lit("unused").alias("summary"),
        )

    days = F.transform(F.sequence(F.lit(0), length - 1), day)
    response = F.struct(F.when(F.col("o_orderstatus") != "P", days).alias("daily"))
    return spread(table(spark, folder, "orders"), cores(spark)).select(
        F.to_json(
            F.struct(
                F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("city"),
                F.col("o_orderpriority").alias("country"),
                F.lit(1.5).alias("latitude"),
                F.col("o_orderkey").cast("double").alias("longitude"),
                response.alias("response"),
            )
        ).alias("payload")
    )


def payloads(spark: SparkSession, folder: str) -> DataFrame:
    return weather.parse_payloads(payload_text(spark, folder))


# Day numbers of an order that become rows; from the third day on a cheap order is cut.
SQL_LENGTH = "CAST(substr(o_orderpriority, 1, 1) AS INTEGER)"
SQL_DAYS = f"""
SELECT *, CAST(o_orderdate AS DATE) + CAST(i AS INTEGER) AS day, o_totalprice < 100000 AS cheap
FROM (SELECT *, unnest(range(least({DAYS}, {SQL_LENGTH}))) AS i
      FROM orders WHERE o_orderstatus <> 'P')
WHERE NOT (o_totalprice < 100000 AND i >= 2)"""


def explode_forecast(spark: SparkSession, folder: str) -> DataFrame:
    rows = weather.forecast_rows(payloads(spark, folder), DAYS, F.lit(STAMP))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return rows.select(
        "city",
        "longitude",
        "forecast_date",
        text("forecast_timestamp"),
        "max_temp",
        "min_temp",
        "day_temp",
        "feels_like_night",
        "humidity",
        "weather_main",
        "weather_icon",
        "precipitation_probability",
        "rain",
        "clouds",
        text("sunset"),
        text("ingestion_timestamp"),
        "logical_key",
    )


SQL_EXPLODE_FORECAST = f"""
SELECT 'C' || o_custkey AS city, CAST(o_orderkey AS DOUBLE) AS longitude,
       CAST(day AS DATE) AS forecast_date, strftime(day, '%Y-%m-%d 00:00:00') AS forecast_timestamp,
       CAST(i + 20.5 AS DOUBLE) AS max_temp, CAST(i - 3.25 AS DOUBLE) AS min_temp,
       o_totalprice AS day_temp, CAST(i * 0.5 AS DOUBLE) AS feels_like_night,
       CASE WHEN NOT cheap THEN CAST(i * 10 AS DOUBLE) END AS humidity,
       o_orderpriority AS weather_main, CAST(NULL AS VARCHAR) AS weather_icon,
       CASE WHEN i = 1 THEN 0.0 ELSE CAST(i * 0.25 AS DOUBLE) END AS precipitation_probability,
       CAST(CASE WHEN cheap THEN 0 ELSE 3.5 END AS DOUBLE) AS rain,
       CAST(CASE WHEN cheap THEN 0 ELSE i END AS DOUBLE) AS clouds,
       strftime(day, '%Y-%m-%d 18:00:00') AS sunset, '2024-01-05 12:00:00' AS ingestion_timestamp,
       'C' || o_custkey || '|' || o_orderpriority || '|' || strftime(day, '%Y-%m-%d') AS logical_key
FROM ({SQL_DAYS})"""


def without_forecast(spark: SparkSession, folder: str) -> DataFrame:
    _, rejected = weather.with_and_without_forecast(payloads(spark, folder))
    return rejected.groupBy("country").agg(F.count("*").alias("payloads"))


SQL_WITHOUT_FORECAST = """
SELECT o_orderpriority AS country, count(*) AS payloads
FROM orders WHERE o_orderstatus = 'P' GROUP BY 1"""


def defaults_filled(spark: SparkSession, folder: str) -> DataFrame:
    return weather.filled_defaults(payloads(spark, folder), DAYS)


SQL_DEFAULTS_FILLED = f"""
WITH d AS ({SQL_DAYS})
SELECT 'precipitation_probability' AS field, count(*) FILTER (i = 1) AS filled FROM d
UNION ALL SELECT 'rain', count(*) FILTER (cheap) FROM d
UNION ALL SELECT 'uvi', count(*) FILTER (false) FROM d
UNION ALL SELECT 'clouds', count(*) FILTER (cheap) FROM d"""


def missing_share(spark: SparkSession, folder: str) -> DataFrame:
    shares = quality.missing_pct(weather.forecast_rows(payloads(spark, folder), DAYS))
    return shares.select("field", F.round("missing_pct", 6).alias("missing_pct"))


SQL_MISSING_PCT = f"""
WITH d AS ({SQL_DAYS})
SELECT field, CASE WHEN field = 'humidity' THEN round(100.0 * count(*) FILTER (cheap) / count(*), 6)
       ELSE 0.0 END AS missing_pct
FROM d, (VALUES ('max_temp'), ('min_temp'), ('humidity'), ('wind_speed'), ('weather_main'),
                ('forecast_timestamp')) AS f(field)
GROUP BY field"""


def location_completeness(spark: SparkSession, folder: str) -> DataFrame:
    places = weather.location_completeness(payloads(spark, folder), DAYS)
    return places.groupBy("country", "available_days", "fetched_days", "missing_days").agg(
        F.count("*").alias("places"), F.sum("expected_days").alias("expected")
    )


# A cheap order's third day cannot be used and ends its forecast.
SQL_FETCHED = f"CASE WHEN o_totalprice < 100000 THEN least(2, {SQL_LENGTH}) ELSE least({DAYS}, {SQL_LENGTH}) END"
SQL_COMPLETENESS = f"""
SELECT o_orderpriority AS country, {SQL_LENGTH} AS available_days,
       {SQL_FETCHED} AS fetched_days, {DAYS} - {SQL_FETCHED} AS missing_days,
       count(*) AS places, CAST(count(*) * {DAYS} AS BIGINT) AS expected
FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL"""


def forecast_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Rows for every permitted number of days, and the days that became none.

    The payloads are parsed once and read again for every number.
    """
    rows = stage(payloads(spark, folder))
    parts = []
    for days in range(1, 8):
        count = F.lit(days).alias("days")
        used = weather.forecast_days(rows, days).agg(F.count("*").alias("rows"))
        lost = weather.cut_days(rows, days).agg(
            F.count("*").alias("lost"), F.count_if("unusable").alias("unusable")
        )
        parts.append(
            used.select(
                count,
                "rows",
                lost.select("lost").scalar().alias("lost"),
                lost.select("unusable").scalar().alias("unusable"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


SQL_FORECAST_LENGTHS = f"""
SELECT CAST(n AS INTEGER) AS days, sum(used) AS rows, sum(wanted - used) AS lost,
       sum(CAST(cheap AND wanted > 2 AS BIGINT) * (wanted - used)) AS unusable
FROM (SELECT n, CAST(least(n, {SQL_LENGTH}) AS BIGINT) AS wanted, o_totalprice < 100000 AS cheap,
             CAST(CASE WHEN o_totalprice < 100000 THEN least(2, n, {SQL_LENGTH})
                       ELSE least(n, {SQL_LENGTH}) END AS BIGINT) AS used
      FROM orders, range(1, 8) AS r(n) WHERE o_orderstatus <> 'P')
GROUP BY 1"""
SQL_FORECAST_LENGTHS = (
    f"SELECT days, CAST(rows AS BIGINT) AS rows, CAST(lost AS BIGINT) AS lost, "
    f"CAST(unusable AS BIGINT) AS unusable FROM ({SQL_FORECAST_LENGTHS})"
)


def _grid(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, folder, "events").select(
        "user_id", F.col("ts").cast("date").alias("day")
    )
    users = events.select("user_id").distinct()
    grid = quality.expected_grid(users, F.lit(dt.date(2024, 1, 1)), F.lit(31))
    return grid, events


def missing_cells(spark: SparkSession, folder: str) -> DataFrame:
    grid, events = _grid(spark, folder)
    return quality.missing_cells(grid, events, ["user_id", "day"])


SQL_MISSING_CELLS = """
WITH grid AS (SELECT user_id, CAST(unnest(range(DATE '2024-01-01', DATE '2024-02-01',
                     INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT DISTINCT user_id FROM events))
SELECT user_id, day FROM grid
WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = grid.user_id
                  AND CAST(e.ts AS DATE) = grid.day)"""


def coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Days with an event in percent of the days of January, per user."""
    _, events = _grid(spark, folder)
    seen = events.distinct().groupBy("user_id").agg(F.count("*").alias("days"))
    return seen.select(
        "user_id", "days", quality.coverage_pct(F.col("days"), F.lit(31)).alias("coverage_pct")
    )


SQL_COVERAGE = """
SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS days,
       round(count(DISTINCT CAST(ts AS DATE)) / 31 * 100, 2) AS coverage_pct
FROM events GROUP BY 1"""


def epoch_times(spark: SparkSession, folder: str) -> DataFrame:
    """Times without a zone labelled UTC, and back from epoch seconds."""
    events = table(spark, folder, "events").select("event_id", F.col("ts").alias("event_time"))
    labelled = weather.label_utc(events)
    seconds = F.unix_seconds("event_time")
    return labelled.select(
        "event_id",
        seconds.alias("epoch"),
        parse.epoch_to_utc_date(seconds).alias("day"),
        F.date_format(parse.epoch_to_timestamp(seconds), "yyyy-MM-dd HH:mm:ss").alias("text"),
    )


SQL_EPOCH_TIMES = """
SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS epoch, CAST(ts AS DATE) AS day,
       strftime(ts, '%Y-%m-%d %H:%M:%S') AS text
FROM events"""


def logical_keys(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part")
    name = F.initcap("p_name")
    return parts.select(
        "p_partkey",
        parse.logical_key(F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("key"),
        parse.slug(name).alias("slug"),
        parse.page_url(name).alias("url"),
        parse.absolute_url(F.concat(F.lit("//img/"), parse.slug(name))).alias("image"),
    )


SQL_LOGICAL_KEYS = """
WITH n AS (SELECT *, array_to_string([upper(w[1]) || lower(w[2:]) FOR w IN
                  string_split(p_name, ' ')], '_') AS slug FROM part)
SELECT p_partkey, concat_ws('|', p_name, p_brand, p_type) AS key, slug,
       'https://en.wikipedia.org/wiki/' || slug AS url, 'https://img/' || slug AS image
FROM n"""


def json_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every part name as a JSON array of structs, built within the row."""
    words = F.transform(
        F.split("p_name", " "), lambda w, i: F.struct(w.alias("word"), (i + 1).alias("at"))
    )
    return table(spark, folder, "part").select(
        "p_partkey",
        F.to_json(words).alias("words"),
        F.size(words).alias("word_count"),
        F.to_json(F.array().cast("array<string>")).alias("empty"),
    )


SQL_JSON_COLUMNS = """
WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS ws FROM part)
SELECT p_partkey, '[' || array_to_string(list_transform(ws, lambda x, i:
       '{"word":"' || x || '","at":' || i || '}'), ',') || ']' AS words,
       CAST(len(ws) AS INTEGER) AS word_count, '[]' AS empty
FROM w"""

QUERIES = {
    "forecast_lengths": forecast_lengths,
    "explode_forecast": explode_forecast,
    "without_forecast": without_forecast,
    "defaults_filled": defaults_filled,
    "missing_pct": missing_share,
    "location_completeness": location_completeness,
    "missing_cells": missing_cells,
    "coverage": coverage,
    "epoch_times": epoch_times,
    "logical_key": logical_keys,
    "json_columns": json_columns,
}
ORACLES = {
    "forecast_lengths": SQL_FORECAST_LENGTHS,
    "explode_forecast": SQL_EXPLODE_FORECAST,
    "without_forecast": SQL_WITHOUT_FORECAST,
    "defaults_filled": SQL_DEFAULTS_FILLED,
    "missing_pct": SQL_MISSING_PCT,
    "location_completeness": SQL_COMPLETENESS,
    "missing_cells": SQL_MISSING_CELLS,
    "coverage": SQL_COVERAGE,
    "epoch_times": SQL_EPOCH_TIMES,
    "logical_key": SQL_LOGICAL_KEYS,
    "json_columns": SQL_JSON_COLUMNS,
}
