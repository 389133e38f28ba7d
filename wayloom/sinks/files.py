"""CSV and JSON sinks. A "file" is a folder of part files, written in parallel."""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.functions.parse import slug
from wayloom.sources.files import CSV_OPTIONS

TEXT_TIMESTAMP = "yyyy-MM-dd HH:mm:ss"


def dated_name(prefix: str, at: dt.datetime, with_time: bool = False) -> str:
    """``travel_data_20240105.csv`` or, with the time, ``travel_data_20240105_103000.csv``."""
    return f"{prefix}_{at:%Y%m%d_%H%M%S}.csv" if with_time else f"{prefix}_{at:%Y%m%d}.csv"


def cleaned_name(name: str) -> str:
    """``x.csv`` to ``x_cleaned.csv``."""
    stem, extension = os.path.splitext(os.path.basename(name))
    return f"{stem}_cleaned{extension}"


def write_csv(table: DataFrame, folder: str, name: str) -> str:
    """CSV with header and without an index; returns the path."""
    path = f"{folder}/{name}"
    table.write.mode("overwrite").option("header", True).options(**CSV_OPTIONS).csv(path)
    return path


def _write_json(table: DataFrame, path: str, **options: str) -> str:
    writer = table.write.mode("append").option("ignoreNullFields", False)
    writer.option("timestampFormat", TEXT_TIMESTAMP).options(**options).json(path)
    return path


def archive_raw_pages(
    pages: DataFrame, base: str, at: dt.datetime, name: str = "destination_name"
) -> str:
    """Raw page records below ``raw/wiki/YYYY/MM/DD``, each with its slug and run stamp.

    One folder per run and not one file per page: millions of tiny objects would be slower
    to write and to read than the pages themselves.
    """
    stamped = pages.withColumns(
        {"slug": slug(F.col(name)), "archived_at": F.lit(f"{at:%Y%m%d_%H%M%S}")}
    )
    return _write_json(stamped, f"{base}/raw/wiki/{at:%Y/%m/%d}/{at:%Y%m%d_%H%M%S}.json")


def archive_records(records: DataFrame, base: str, at: dt.datetime) -> str:
    """Processed records of one run, JSON lines; non-ASCII text stays readable."""
    return _write_json(records, f"{base}/processed/wiki/destinations_{at:%Y%m%d_%H%M%S}.json")


def archive_payloads(payloads: DataFrame, base: str, at: dt.datetime) -> str | None:
    """Raw weather payloads, gzip JSON lines; nothing to store is fine and writes nothing."""
    if payloads.isEmpty():
        return None
    path = f"{base}/weather_raw/{at:%Y%m%d_%H%M%S}_raw_responses.json.gz"
    return _write_json(payloads, path, compression="gzip")


def archive_partitioned(
    table: DataFrame, path: str, day: str, compression: str = "none"
) -> str:
    """JSON partitioned by the year, month and day of a date column, so that later reads of a
    period list only its folders."""
    parts = {
        "year": F.date_format(day, "yyyy"),
        "month": F.date_format(day, "MM"),
        "day": F.date_format(day, "dd"),
    }
    # Without it every task would write a file per day. Rebalancing gathers the rows of a day
    # and still splits a day that is far larger than the others.
    gathered = table.withColumns(parts).hint("rebalance", *parts)
    writer = gathered.write.partitionBy(*parts).mode("append")
    writer.option("compression", compression).option("timestampFormat", TEXT_TIMESTAMP).json(path)
    return path
