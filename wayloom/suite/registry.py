"""All registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.suite import pages, profiles, tables, trips, weather

MODULES = (trips, weather, profiles, tables, pages)


# Results with dates; both sides write them as text, so that no client library's own date type
# stands between the two.
DATES = {
    "parse_dates": ("day",),
    "to_warehouse": ("Start_date", "End_date"),
    "explode_forecast": ("forecast_date",),
    "missing_cells": ("day",),
    "epoch_times": ("day",),
    "incremental_pickup": ("Start_date", "End_date"),
    "merge_upsert": ("last_day",),
    "merge_null_safe": ("last_day",),
    "merge_ansi_notes": ("last_day",),
    "merge_into_table": ("last_day",),
    "merge_buckets": ("last_day",),
}


def _prepared(name: str, query: Callable) -> Callable[[SparkSession, str], DataFrame]:
    """Times are read in UTC whatever the session was started with."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        result = query(spark, folder)
        return result.withColumns({c: F.col(c).cast("string") for c in DATES.get(name, ())})

    run.__doc__ = query.__doc__
    return run


def _with_text_dates(name: str, sql: str) -> str:
    if name not in DATES:
        return sql
    texts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in DATES[name])
    return f"SELECT * REPLACE ({texts}) FROM ({sql})"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _prepared(name, q) for module in MODULES for name, q in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {
        name: _with_text_dates(name, sql)
        for module in MODULES
        for name, sql in module.ORACLES.items()
    }
