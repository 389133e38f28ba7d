"""Completeness and run metrics."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fields whose gaps are reported.
CRITICAL_FIELDS = (
    "max_temp",
    "min_temp",
    "humidity",
    "wind_speed",
    "weather_main",
    "forecast_timestamp",
)


def missing_pct(table: DataFrame, fields: Sequence[str] = CRITICAL_FIELDS) -> DataFrame:
    """Share of missing values per field in percent, all fields in one pass.

    Returns ``(field, missing_pct)``; fields the table lacks are left out.
    """
    present = [f for f in fields if f in table.columns]
    shares = table.agg(
        *[F.avg(F.col(f).isNull().cast("int")).alias(f) for f in present]
    ).select(*[(F.col(f) * 100.0).alias(f) for f in present])
    return shares.unpivot([], present, "field", "missing_pct")


def coverage_pct(rows: Column, expected: Column) -> Column:
    """Rows in percent of the expected ones, two decimals, 0 if none were expected."""
    return F.when(expected > 0, F.round(rows / expected * 100, 2)).otherwise(F.lit(0.0))


def defaults_filled(table: DataFrame, fields: Mapping[str, Column]) -> DataFrame:
    """How often a default had to stand in, ``(field, filled)``; run before filling."""
    names = list(fields)
    counts = table.agg(*[F.count_if(value.isNull()).alias(name) for name, value in fields.items()])
    return counts.unpivot([], names, "field", "filled")


def expected_grid(places: DataFrame, start: Column, days: Column, name: str = "day") -> DataFrame:
    """Every place with each of its expected days, generated per row and not by a cross join."""
    last = F.date_add(start, days.cast("int") - 1)
    return places.withColumn(name, F.explode(F.sequence(start, last)))


def missing_cells(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected cells without any row; repeats in ``actual`` are folded before the join."""
    return expected.join(actual.select(*keys).distinct(), list(keys), "left_anti")


def fetch_status(pages: DataFrame) -> DataFrame:
    """Adds ``status``: ``succeeded``, or ``failed`` for error responses and absent bodies."""
    good = F.col("content").isNotNull() & (F.col("status_code") < 400)
    return pages.withColumn("status", F.when(good, "succeeded").otherwise("failed"))


def fetch_summary(pages: DataFrame) -> DataFrame:
    """Pages per status. The failed ones are rows of :func:`failed_fetches`: a list of names
    in one cell would gather them all in one task."""
    return fetch_status(pages).groupBy("status").agg(F.count("*").alias("pages"))


def failed_fetches(pages: DataFrame, name: str = "destination_name") -> DataFrame:
    return fetch_status(pages).where(F.col("status") == "failed").select(name)


RUN_METRICS = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("flow", T.StringType()),
        T.StructField("generation_method", T.StringType()),
        T.StructField("files_generated", T.LongType()),
        T.StructField("files_ingested", T.LongType()),
        T.StructField("files_total", T.LongType()),
        T.StructField("rows_in", T.LongType()),
        T.StructField("rows_out", T.LongType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("error", T.StringType()),
        T.StructField("execution_time_seconds", T.DoubleType()),
    ]
)


def run_metrics(spark: SparkSession, **values: object) -> DataFrame:
    """One row of run metrics; what is not given is NULL."""
    unknown = set(values) - set(RUN_METRICS.names)
    if unknown:
        raise ValueError(f"unknown metrics: {sorted(unknown)}")
    values.setdefault("timestamp", dt.datetime.now(dt.timezone.utc))
    return spark.createDataFrame([tuple(values.get(n) for n in RUN_METRICS.names)], RUN_METRICS)
