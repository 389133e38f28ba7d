"""The three flows end to end, each returning a record of what it did."""

from __future__ import annotations

import datetime as dt
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.operators import quality
from wayloom.plans import destinations, trips, weather
from wayloom.schemas import DESTINATIONS_TABLE
from wayloom.session import stage
from wayloom.sinks import files as file_sinks
from wayloom.sinks import tables
from wayloom.sources.files import TRIP_FILES, latest_file, read_csv
from wayloom.sources.reference_lists import FORECAST_DAYS
from wayloom.streaming.pickup import PickupResult, pick_up_trips


@dataclass
class FlowResult:
    """``success`` is True only if every step was; ``steps`` holds each step's own result."""

    flow: str
    success: bool = True
    error: str | None = None
    seconds: float = 0.0
    steps: dict[str, object] = field(default_factory=dict)


def _timed(flow: str, body) -> FlowResult:
    result, began = FlowResult(flow), time.monotonic()
    try:
        body(result)
    except Exception as error:  # a flow reports its failure, it does not raise
        result.success, result.error = False, str(error)
    result.seconds = time.monotonic() - began
    return result


# File name prefix of each way to make a batch.
PREFIXES = {
    "distribution": "travel_data",
    "raw": "raw_travel_data",
    "tiered": "faker_travel_data",
}


def run_trips(
    spark: SparkSession,
    folder: str,
    table_path: str,
    sample: DataFrame | None = None,
    method: str = "distribution",
    generate: bool = True,
    ingest: bool = True,
    now: dt.datetime | None = None,
    n: int = trips.BATCH_SIZE,
    seed: int | None = None,
    on_error: str = "fail",
    multi_line: bool = True,
    metrics_table: str | None = None,
    table: str | None = None,
) -> FlowResult:
    """Generate a batch, then clean and load every trip file not loaded before.

    ``metrics_table`` names a catalog table to which the run appends its metrics, whatever came of it;
    ``table`` gives the loaded trips their name in the catalog.
    ``multi_line`` off lets large files be split over tasks, if no value holds a line end.
    """
    now = now or dt.datetime.now(dt.timezone.utc)

    def body(result: FlowResult) -> None:
        result.steps["method"] = method
        result.steps["files_generated"] = 0
        result.steps["pickup"] = PickupResult()
        if generate:
            draw_seed = now.toordinal() if seed is None else seed
            batch = trips.generate(spark, method, sample, now.date(), n, draw_seed)
            name = file_sinks.dated_name(PREFIXES[method], now)
            result.steps["file"] = file_sinks.write_csv(batch, folder, name)
            result.steps["files_generated"] = 1
        if ingest:
            picked = pick_up_trips(
                spark,
                folder,
                table_path,
                on_error=on_error,
                ingested_at=now,
                multi_line=multi_line,
                table=table,
            )
            result.steps["pickup"] = picked
            result.success = picked.files_loaded == picked.files_total

    result = _timed("trips", body)
    if metrics_table:
        result.steps["metrics"] = tables.append(
            trip_metrics(spark, result, now), metrics_table, quality.RUN_METRICS, report_total=False
        )
    return result


def clean_file(spark: SparkSession, path: str, folder: str, multi_line: bool = True) -> str:
    """A raw trips file, cleaned, written to ``folder`` as ``<name>_cleaned.csv``; its path."""
    cleaned = trips.clean_trips(read_csv(spark, path, multi_line=multi_line))
    return file_sinks.write_csv(cleaned, folder, file_sinks.cleaned_name(path))


def clean_latest(
    spark: SparkSession,
    source: str,
    folder: str,
    pattern: str = TRIP_FILES,
    by: str = "date",
    multi_line: bool = True,
) -> str | None:
    """:func:`clean_file` of the newest file of a folder; None if there is no file."""
    newest = latest_file(spark, source, pattern, by)
    return clean_file(spark, newest, folder, multi_line) if newest else None


def trip_metrics(spark: SparkSession, result: FlowResult, now: dt.datetime) -> DataFrame:
    """The run as one row of the metrics table."""
    pickup = result.steps.get("pickup", PickupResult())
    return quality.run_metrics(
        spark,
        timestamp=now,
        flow=result.flow,
        generation_method=result.steps.get("method"),
        files_generated=result.steps.get("files_generated", 0),
        files_ingested=pickup.files_loaded,
        files_total=pickup.files_total,
        rows_in=pickup.rows_loaded + pickup.rows_withheld,
        rows_out=pickup.rows_loaded,
        success=result.success,
        error=result.error,
        execution_time_seconds=result.seconds,
    )


def run_destinations(
    spark: SparkSession,
    pages: DataFrame,
    archive: str,
    table: str,
    now: dt.datetime | None = None,
    change_test: str = "ansi",
) -> FlowResult:
    """Archive pages, extract records, archive them, upsert them by name."""
    now = now or dt.datetime.now(dt.timezone.utc)

    def body(result: FlowResult) -> None:
        counts = {r["status"]: r["pages"] for r in quality.fetch_summary(pages).collect()}
        result.steps["fetch"] = counts
        fetched = destinations.available(pages)
        result.steps["raw_archive"] = file_sinks.archive_raw_pages(fetched, archive, now)
        # Extraction is the costly step: its result is written once and read by both sinks.
        records = stage(
            destinations.extract_destinations(fetched).withColumn(
                "ingestion_timestamp", F.lit(now)
            )
        )
        result.steps["record_archive"] = file_sinks.archive_records(records, archive, now)
        load = tables.merge_into(
            destinations.to_warehouse(records),
            table,
            DESTINATIONS_TABLE,
            ["destination_name"],
            change_test=change_test,
        )
        result.steps["load"] = load
        result.success, result.error = load.ok, load.error

    return _timed("destinations", body)


def run_weather(
    spark: SparkSession,
    payloads: DataFrame,
    archive: str,
    table: str,
    locations: DataFrame,
    days: int = FORECAST_DAYS,
    now: dt.datetime | None = None,
) -> FlowResult:
    """Rows from payloads, completeness figures, gzip archive, append."""
    now = now or dt.datetime.now(dt.timezone.utc)

    def body(result: FlowResult) -> None:
        wanted, _ = weather.with_and_without_forecast(payloads)
        rows = stage(weather.label_utc(weather.forecast_rows(payloads, days, F.lit(now))))
        fetched, expected = rows.count(), locations.count() * days
        result.steps["expected_rows"], result.steps["fetched_rows"] = expected, fetched
        result.steps["coverage_pct"] = (
            round(100.0 * fetched / expected, 2) if expected else 0.0
        )
        if not fetched:
            result.success, result.error = False, "no forecast in any payload"
            return
        result.steps["missing_pct"] = dict(map(tuple, quality.missing_pct(rows).collect()))
        filled = weather.filled_defaults(payloads, days)
        result.steps["filled_defaults"] = dict(map(tuple, filled.collect()))
        result.steps["archive"] = file_sinks.archive_payloads(wanted, archive, now)
        load = tables.append_autodetect(rows, table)
        result.steps["load"] = load
        result.success, result.error = load.status != "failed", load.error

    return _timed("weather", body)
