"""Incremental pickup: every file is loaded once, whatever happens in between.

The table keeps a log of its files. A run lists the folder, takes the files the log does not show
as loaded, and publishes its rows by adding its lines to the log as the last step: a run that fails
leaves nothing that readers see, and the next one takes the same files again. A file counts by its
path, size and time, so one that was withheld and then corrected is tried again, however old its
time is, and nothing in the folder is moved or renamed. Files of no bytes are not there yet. A run
goes in batches of a named number of files, each with log lines of its own, so what a failure costs
is one batch. Runs into one table follow each other.
"""

from __future__ import annotations

import datetime as dt
import operator
import uuid
from dataclasses import astuple, dataclass
from itertools import count

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayloom.functions.parse import parse_integer
from wayloom.operators.clean import drop_empty_rows
from wayloom.plans.trips import clean_trips, is_malformed, to_warehouse
from wayloom.schemas import TRIP_COLUMNS, TRIPS_RAW, TRIPS_TABLE
from wayloom.session import discard, matches, scratch_path, stage
from wayloom.sinks import loads
from wayloom.sources.files import TRIP_FILES, list_files, read_csv

LOG = loads.FILES
IDENTITY = ("path", "parts", "bytes", "modified")
#: Files that one step of a run loads and publishes.
BATCH_FILES = 2000


@dataclass(frozen=True)
class PickupResult:
    files_total: int = 0
    files_loaded: int = 0
    rows_loaded: int = 0
    rows_withheld: int = 0


def pending_files(
    spark: SparkSession,
    folder: str,
    table_path: str,
    pattern: str = TRIP_FILES,
    run: str | None = None,
) -> DataFrame:
    """Files of the folder that were not loaded as they are now, nor tried already by ``run``."""
    found = list_files(spark, folder, pattern).withColumnRenamed("name", "Source_file")
    done = F.col("loaded") if run is None else F.col("loaded") | F.col("load").startswith(run)
    settled = file_log(spark, table_path).where(done).select(*IDENTITY)
    return found.join(settled, list(IDENTITY), "left_anti")


def pick_up_trips(
    spark: SparkSession,
    folder: str,
    table_path: str,
    pattern: str = TRIP_FILES,
    on_error: str = "fail",
    ingested_at: dt.datetime | None = None,
    batch_files: int = BATCH_FILES,
    multi_line: bool = True,
    table: str | None = None,
) -> PickupResult:
    """Clean and load the trip files that are pending.

    ``on_error="fail"`` withholds a file with a malformed row as a whole, all of its parts, and
    loads the others; ``"null"`` loads every file with NULL where a value cannot be read, and puts
    rows without an id, which the table needs, aside (:func:`rejected_trips`).

    Files are taken ``batch_files`` at a time, in order of path, and every batch is published by
    itself: the driver holds the names of one batch, and a run that breaks off keeps the batches
    before. With ``multi_line`` off, large files whose values hold no line ends are split over tasks.

    ``table`` names the table in the catalog (:func:`wayloom.sinks.loads.register`).
    """
    stamp = ingested_at or dt.datetime.now(dt.timezone.utc)
    run = uuid.uuid4().hex
    if table:
        loads.register(spark, table_path, TRIPS_TABLE, table)
    total = PickupResult()
    for number in count():
        load = f"{run}-{number:06d}"
        found = _pick_up_batch(
            spark, folder, table_path, pattern, on_error, stamp, run, load, batch_files, multi_line, table
        )
        total = PickupResult(*map(operator.add, astuple(total), astuple(found)))
        if found.files_total < batch_files:
            return total


def _pick_up_batch(
    spark: SparkSession,
    folder: str,
    table_path: str,
    pattern: str,
    on_error: str,
    stamp: dt.datetime,
    run: str,
    load: str,
    batch_files: int,
    multi_line: bool,
    table: str | None,
) -> PickupResult:
    """The next files that this run has not tried, loaded and published as ``load``."""
    folders = [scratch_path(spark, f"pickup-{name}") for name in ("pending", "rows", "report")]
    try:
        waiting = pending_files(spark, folder, table_path, pattern, run)
        pending = stage(waiting.orderBy("path").limit(batch_files), path=folders[0])
        # Their names are what the reader is given; Spark lists the same files itself.
        paths = [r["path"] for r in pending.select("path").collect()]
        if not paths:
            return PickupResult()
        read = read_csv(spark, paths, TRIPS_RAW, lineage="Source_file", multi_line=multi_line)
        checked = drop_empty_rows(read, TRIP_COLUMNS).withColumns(
            {"_bad": is_malformed(), "_no_id": parse_integer(F.col("Trip ID")).isNull()}
        )
        # Parsed once; the report and the rows are both taken from here.
        rows = stage(checked, path=folders[1])
        # Per-file counts are combined before the shuffle: one huge file is not a hot key.
        counts = rows.groupBy("Source_file").agg(
            F.count("*").alias("rows"),
            F.count_if("_bad").alias("malformed_rows"),
            F.count_if("_no_id").alias("rows_without_id"),
        )
        withheld = F.lit(on_error == "fail") & (F.col("malformed_rows") > 0)
        report = pending.join(counts, "Source_file", "left").na.fill(
            0, ["rows", "malformed_rows", "rows_without_id"]
        )
        report = stage(report.withColumns({"loaded": ~withheld, "load": F.lit(load)}), path=folders[2])
        # Known to the catalog before it holds rows, and seen from the log's lines on.
        loads.add_load(spark, table, load)
        written = _publish(rows, report, table_path, load, stamp)
        loads.refresh(spark, table)
        withheld = F.when(F.col("loaded"), F.col("rows_without_id")).otherwise(F.col("rows"))
        totals = report.agg(F.count("*"), F.count_if("loaded"), F.sum(withheld)).first()
        return PickupResult(totals[0], totals[1], written, totals[2] or 0)
    finally:
        for path in folders:
            discard(spark, path)


def _publish(
    rows: DataFrame, report: DataFrame, table_path: str, load: str, stamp: dt.datetime
) -> int:
    """Write the rows of the accepted files, the rejected rows, and then the log's lines.

    Returns the number of rows written, counted by the write itself.
    """
    # Spark broadcasts the names if they are few, else a file with most rows is split.
    accepted = rows.join(report.where("loaded").select("Source_file"), "Source_file", "left_semi")
    cleaned = clean_trips(accepted.where(~F.col("_no_id")).drop("_bad", "_no_id"), "null")
    shaped = to_warehouse(cleaned, F.lit(stamp), F.col("Source_file"), on_error="null")
    seen = Observation()
    counted = shaped.observe(seen, F.count(F.lit(1)).alias("rows"))
    # The catalog may have made the folder; a load's name is never used twice.
    counted.write.mode("append").parquet(f"{table_path}/rows/load={load}")
    rejected = accepted.where("_no_id").drop("_bad", "_no_id")
    rejected.write.parquet(f"{table_path}/rejects/load={load}")
    lines = report.select(*[f.split()[0] for f in LOG.split(", ")])
    lines.coalesce(1).write.mode("append").parquet(f"{table_path}/files")
    return seen.get["rows"]


def loaded_trips(spark: SparkSession, table_path: str) -> DataFrame:
    """All rows loaded so far; folders of runs that did not end are left out."""
    return loads.read_rows(spark, table_path, TRIPS_TABLE)


def compact_trips(
    spark: SparkSession, table_path: str, table: str | None = None, file_rows: int = loads.FILE_ROWS
) -> loads.Compaction:
    """:func:`wayloom.sinks.loads.compact` of the loaded trips."""
    return loads.compact(spark, table_path, TRIPS_TABLE, table, file_rows)


def rejected_trips(spark: SparkSession, table_path: str) -> DataFrame:
    """Rows without an id in loaded files, as they were read, with their file."""
    raw = T.StructType([T.StructField("Source_file", T.StringType()), *TRIPS_RAW.fields])
    published = file_log(spark, table_path).select("load")
    if not matches(spark, f"{table_path}/rejects"):
        return spark.createDataFrame([], raw)
    full = T.StructType([*raw.fields, T.StructField("load", T.StringType())])
    found = spark.read.schema(full).parquet(f"{table_path}/rejects")
    return found.join(published, "load", "left_semi").drop("load")


def file_log(spark: SparkSession, table_path: str) -> DataFrame:
    """A line for each file and run: what it was, what it held, whether it was loaded."""
    return loads.log(spark, table_path, "files", LOG)
