"""Tables kept as published loads: visibility, a name in the catalog, compaction.

Rows lie in ``rows/load=…`` below the table's path and count from the moment the log ``files`` has
the load's lines. Many small loads make many small files, so :func:`compact` writes those together
as one load and publishes, as its last step, one file of lines that say which loads it stands for.
Readers see the loads before or the one after and never both; the old folders stay for those
that still read them until :func:`remove_replaced`.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayloom.session import discard, matches
from wayloom.sinks.tables import ensure_database, quoted, table_location

#: A line for each file and load: what it was, what it held, whether it was loaded.
FILES = (
    "path string, Source_file string, parts long, bytes long, modified timestamp, rows long, "
    "malformed_rows long, rows_without_id long, loaded boolean, load string"
)
#: A line for each load that a compaction stands for, with the rows of the compaction.
COMPACTIONS = "load string, replaced string, rows long, compacted_at timestamp"
#: Loads below this size are written together, into files of this size.
FILE_ROWS = 5_000_000
#: Loads that one compaction takes: the driver holds their names.
MOST_LOADS = 10_000


@dataclass(frozen=True)
class Compaction:
    load: str | None = None
    loads_replaced: int = 0
    rows: int = 0
    files: int = 0


def log(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """One of the table's logs as it is now, empty if nothing was written yet."""
    if not matches(spark, f"{path}/{kind}"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{kind}")


def visible_loads(spark: SparkSession, path: str) -> DataFrame:
    """``(load, rows)`` of the loads that make up the table now."""
    files = log(spark, path, "files", FILES)
    compactions = log(spark, path, "compactions", COMPACTIONS)
    stored = F.when(F.col("loaded"), F.col("rows") - F.col("rows_without_id")).otherwise(0)
    loads = files.groupBy("load").agg(F.sum(stored).alias("rows"))
    joined = compactions.groupBy("load").agg(F.max("rows").alias("rows"))
    replaced = compactions.select(F.col("replaced").alias("load"))
    return loads.unionByName(joined).join(replaced, "load", "left_anti")


def read_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table's rows; folders of runs that did not end are left out."""
    # The logs are listed before the rows: what they name is there then.
    loads = visible_loads(spark, path).select("load")
    if not matches(spark, f"{path}/rows"):
        return spark.createDataFrame([], schema)
    full = T.StructType([*schema.fields, T.StructField("load", T.StringType())])
    found = spark.read.schema(full).parquet(f"{path}/rows")
    return found.join(loads, "load", "left_semi").drop("load")


# --- the table's name -------------------------------------------------------------------


def register(spark: SparkSession, path: str, schema: T.StructType, name: str) -> None:
    """Give the table a name: a view ``name`` of the declared columns, in the catalog.

    Below it are external tables ``name__rows`` (a partition for each load), ``name__files`` and
    ``name__compactions``. Loads published without the name are taken up; a name that belongs to
    another path is refused. A session that has read the name sees later loads after
    :func:`refresh`, as with every table whose files another session writes.
    """
    rows = f"{name}__rows"
    if "." in name:
        ensure_database(spark, name.rsplit(".", 1)[0])
    if not spark.catalog.tableExists(rows):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(
            f"CREATE TABLE {quoted(rows)} ({columns}, load string) USING parquet "
            f"PARTITIONED BY (load) LOCATION '{path}/rows'"
        )
    elif _plain(table_location(spark, rows)) != _plain(f"{path}/rows"):
        raise ValueError(f"{name} is the table of {table_location(spark, rows)}")
    for kind, log_schema in (("files", FILES), ("compactions", COMPACTIONS)):
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {quoted(f'{name}__{kind}')} ({log_schema}) "
            f"USING parquet LOCATION '{path}/{kind}'"
        )
    if matches(spark, f"{path}/rows"):
        spark.catalog.recoverPartitions(rows)
    refresh(spark, name)
    columns = ", ".join(f"`{f.name}`" for f in schema.fields)
    files, compactions = quoted(f"{name}__files"), quoted(f"{name}__compactions")
    spark.sql(
        f"CREATE VIEW IF NOT EXISTS {quoted(name)} AS SELECT {columns} FROM {quoted(rows)} "
        f"LEFT SEMI JOIN (SELECT load FROM {files} UNION SELECT load FROM {compactions}) USING (load) "
        f"LEFT ANTI JOIN (SELECT replaced AS load FROM {compactions}) USING (load)"
    )


def _plain(location: str) -> str:
    return location.removeprefix("file:").rstrip("/")


def add_load(spark: SparkSession, name: str | None, load: str) -> None:
    """Make a written load known to the catalog; it counts once the log has it."""
    if name:
        spark.sql(f"ALTER TABLE {quoted(f'{name}__rows')} ADD IF NOT EXISTS PARTITION (load = '{load}')")


def refresh(spark: SparkSession, name: str | None) -> None:
    """Let this session look at the table's files anew."""
    for kind in ("rows", "files", "compactions") if name else ():
        spark.catalog.refreshTable(f"{name}__{kind}")


# --- compaction -------------------------------------------------------------------------


def compact(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    name: str | None = None,
    file_rows: int = FILE_ROWS,
    most_loads: int = MOST_LOADS,
    at: dt.datetime | None = None,
) -> Compaction:
    """Write the loads of fewer than ``file_rows`` rows together, in files of about that size.

    Only their folders are read; large loads are left alone, so a row is rewritten until its load is
    large and no more. Nothing is shuffled: a task reads whole small files one after the other. If
    the rows written are not as many as the log says, or the job ends early, the table stays as it
    is. Loads may be published meanwhile; compactions of one table follow each other. The smallest
    ``most_loads`` are taken, and the next call goes on. A single small load is left as it is.
    """
    at = at or dt.datetime.now(dt.timezone.utc)
    small = visible_loads(spark, path).where(F.col("rows") < file_rows)
    chosen = small.orderBy("rows", "load").limit(most_loads).collect()
    if len(chosen) < 2:
        return Compaction()
    expected = sum(r["rows"] for r in chosen)
    load = f"compact-{uuid.uuid4().hex}"
    folder, files = f"{path}/rows/load={load}", max(1, -(-expected // file_rows))
    lines = spark.createDataFrame([(load, r["load"], expected, at) for r in chosen], COMPACTIONS)
    try:
        seen = Observation()
        rows = spark.read.schema(schema).parquet(*[f"{path}/rows/load={r['load']}" for r in chosen])
        rows = rows.observe(seen, F.count(F.lit(1)).alias("rows")).coalesce(files)
        rows.write.option("maxRecordsPerFile", file_rows).parquet(folder)
        written = seen.get["rows"]
        if written != expected:
            raise RuntimeError(f"{written} rows written, {expected} expected: the loads were changed")
        add_load(spark, name, load)
        lines.coalesce(1).write.mode("append").parquet(f"{path}/compactions")
    except Exception:
        discard(spark, folder)
        raise
    refresh(spark, name)
    return Compaction(load, len(chosen), written, files)


def remove_replaced(
    spark: SparkSession, path: str, before: dt.datetime, name: str | None = None
) -> int:
    """Remove the folders of loads that a compaction earlier than ``before`` stands for.

    Readers that began before that compaction must have ended. Returns the number of folders.
    """
    old = log(spark, path, "compactions", COMPACTIONS).where(F.col("compacted_at") < F.lit(before))
    removed = 0
    # Names only, a part at a time; the work is the file system's.
    for row in old.select("replaced").distinct().toLocalIterator():
        folder = f"{path}/rows/load={row['replaced']}"
        if name:
            spark.sql(
                f"ALTER TABLE {quoted(f'{name}__rows')} DROP IF EXISTS PARTITION (load = '{row['replaced']}')"
            )
        if matches(spark, folder):
            discard(spark, folder)
            removed += 1
    refresh(spark, name)
    return removed
