"""Catalog tables: create, append, truncate-and-load, upsert."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayloom.operators import upsert
from wayloom.operators.lattice import conform, same, widened
from wayloom.session import discard, matches, scratch_path, stage


@dataclass(frozen=True)
class LoadResult:
    """Outcome of a load. ``status`` is ``loaded``, ``empty`` or ``failed``."""

    status: str
    rows_in: int = 0
    rows_total: int | None = None
    inserted: int = 0
    updated: int = 0
    rejected: int = 0
    error: str | None = None

    @property
    def ok(self) -> bool:
        return self.status == "loaded"


def ensure_database(spark: SparkSession, database: str, location: str | None = None) -> None:
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {quoted(database)}{where}")


def ensure_table(spark: SparkSession, table: str, schema: T.StructType) -> None:
    """Create ``database.table`` with the declared columns unless it exists."""
    if "." in table:
        ensure_database(spark, table.rsplit(".", 1)[0])
    if not spark.catalog.tableExists(table):
        columns = ", ".join(
            f"`{f.name}` {f.dataType.simpleString()}" + ("" if f.nullable else " NOT NULL")
            for f in schema.fields
        )
        spark.sql(f"CREATE TABLE IF NOT EXISTS {quoted(table)} ({columns}) USING parquet")


def quoted(name: str) -> str:
    return ".".join(f"`{part}`" for part in name.split("."))


def _counted(table: DataFrame) -> tuple[DataFrame, Observation]:
    """Count rows while they are written, not in a second scan."""
    seen = Observation()
    return table.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def _loaded(
    spark: SparkSession, name: str, written: int, report_total: bool, **counts: int
) -> LoadResult:
    total = spark.table(name).count() if report_total else None
    status = "loaded" if written else "empty"
    return LoadResult(status, rows_in=written, rows_total=total, **counts)


def reported(load: Callable[..., LoadResult]) -> Callable[..., LoadResult]:
    """A load that fails says so in its result: the flow reports it and goes on.

    Source rows that contradict each other are the caller's to mend and are raised.
    """

    @wraps(load)
    def run(*args, **options) -> LoadResult:
        try:
            return load(*args, **options)
        except upsert.DuplicateSourceKey:
            raise
        except Exception as error:
            return LoadResult("failed", error=str(error))

    return run


@reported
def append(
    table: DataFrame, name: str, schema: T.StructType, report_total: bool = True
) -> LoadResult:
    """Append in the declared schema; an empty input adds nothing and is reported as such.

    ``report_total`` counts the table afterwards. That reads no data, but one footer per file:
    leave it out for frequent loads into a table of very many files.
    """
    spark = table.sparkSession
    ensure_table(spark, name, schema)
    rows, seen = _counted(conform(table, schema))
    rows.write.mode("append").insertInto(name)
    written = seen.get["rows"]
    return _loaded(spark, name, written, report_total, inserted=written)


@reported
def append_autodetect(table: DataFrame, name: str, report_total: bool = True) -> LoadResult:
    """Append by column name, the table's schema following the rows.

    Columns the table does not have yet are added to it. Where a column's values need a wider type
    (``lattice.wider``) the table is rewritten to it first; types that do not go together fail the
    load, with nothing written. Narrower values are stored in the table's type.
    """
    spark = table.sparkSession
    if table.isEmpty():
        return LoadResult("empty")
    ensure_table(spark, name, table.schema)
    have = spark.table(name).schema
    schema = widened(have, table.schema)
    # What cannot be stored is found before the table is touched.
    rows = conform(table, schema)
    if not all(same(new.dataType, old.dataType) for new, old in zip(schema.fields, have.fields)):
        rewrite(spark, name, schema)
    elif len(schema) > len(have):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields[len(have) :])
        spark.sql(f"ALTER TABLE {quoted(name)} ADD COLUMNS ({columns})")
    rows, seen = _counted(rows)
    rows.write.mode("append").insertInto(name)
    written = seen.get["rows"]
    return _loaded(spark, name, written, report_total, inserted=written)


def rewrite(spark: SparkSession, name: str, schema: T.StructType) -> None:
    """Give a table a wider schema: its rows are written anew and the new table takes its name.

    The old table is there until the new one is complete; if the names cannot be changed it stays.
    All rows are read and written once. A value that the wider type does not hold exactly (a long
    beyond 2^53 as a double) fails the rewrite and leaves the table as it was.
    """
    former = table_location(spark, name)
    folder = _beside(former)
    mark = folder[-12:]
    database, dot, plain = name.rpartition(".")
    fresh, aside = (f"{database}{dot}{plain}__{kind}_{mark}" for kind in ("new", "old"))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    external = spark.catalog.getTable(name).tableType == "EXTERNAL"
    try:
        conform(spark.table(name), schema).write.parquet(folder)
        spark.sql(f"CREATE TABLE {quoted(fresh)} ({columns}) USING parquet LOCATION '{folder}'")
        spark.sql(f"ALTER TABLE {quoted(name)} RENAME TO {quoted(aside)}")
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {quoted(fresh)}")
        discard(spark, folder)
        raise
    try:
        spark.sql(f"ALTER TABLE {quoted(fresh)} RENAME TO {quoted(name)}")
    except Exception:
        spark.sql(f"ALTER TABLE {quoted(aside)} RENAME TO {quoted(name)}")
        spark.sql(f"DROP TABLE IF EXISTS {quoted(fresh)}")
        discard(spark, folder)
        raise
    spark.sql(f"DROP TABLE {quoted(aside)}")
    if external:
        discard(spark, former)
    spark.catalog.refreshTable(name)


@reported
def append_new_keys(
    table: DataFrame, name: str, schema: T.StructType, key: str
) -> LoadResult:
    """Append only rows whose key the table does not hold yet, the first one of each key."""
    spark = table.sparkSession
    ensure_table(spark, name, schema)
    order = [F.col(c) for c in table.columns if c != key]
    folders = [scratch_path(spark, f"append-{part}") for part in ("batch", "fresh")]
    try:
        folded = stage(
            table.groupBy(key)
            .agg(F.min_by(F.struct(*table.columns), F.struct(*order)).alias("r"))
            .select("r.*"),
            path=folders[0],
        )
        # The keys found again are no more than the batch has, so a small batch leaves the table
        # where it is: it is broadcast against the table's key column.
        known = spark.table(name).select(key).join(folded.select(key), key, "left_semi").distinct()
        fresh = folded.join(known, key, "left_anti").select(*table.columns)
        # The table is read to decide what to append to it: settle the rows first.
        return append(stage(fresh, path=folders[1]), name, schema)
    finally:
        for folder in folders:
            discard(spark, folder)


@reported
def truncate_and_load(table: DataFrame, name: str, schema: T.StructType) -> LoadResult:
    """Replace the whole content, by a new state beside the old one: a load that fails changes nothing."""
    spark = table.sparkSession
    ensure_table(spark, name, schema)
    former = table_location(spark, name)
    folder = _beside(former)
    try:
        rows, seen = _counted(conform(table, schema))
        rows.write.parquet(folder)
        written = seen.get["rows"]
        _point_at(spark, name, former, folder)
    except Exception:
        discard(spark, folder)
        raise
    discard(spark, former)
    return LoadResult("loaded", written, rows_total=written, inserted=written)


def _beside(location: str) -> str:
    """A fresh folder for another state of the table that lies at ``location``."""
    return f"{re.sub('__[0-9a-f]{12}$', '', location)}__{uuid.uuid4().hex[:12]}"


def _point_at(spark: SparkSession, name: str, former: str, folder: str) -> None:
    """Make ``folder`` the table's state, unless another writer has changed the table meanwhile."""
    if table_location(spark, name) != former:
        raise RuntimeError(f"{name} was changed by another writer")
    spark.sql(f"ALTER TABLE {quoted(name)} SET LOCATION '{folder}'")
    spark.catalog.refreshTable(name)


def table_location(spark: SparkSession, name: str) -> str:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {quoted(name)}").where("col_name = 'Location'")
    return rows.first()["data_type"]


@reported
def merge_into(
    source: DataFrame,
    name: str,
    schema: T.StructType,
    keys: Sequence[str],
    change_test: str = "ansi",
    ignore: Sequence[str] = (),
    keep_previous: bool = False,
) -> LoadResult:
    """Upsert into a catalog table.

    The new state is written beside the old one and the table is pointed at it in one catalog
    change, so readers see all of the upsert or none and a lost job leaves the table as it was.
    If no row changes nothing is written. If another writer has moved the table meanwhile, the
    upsert fails and leaves that writer's state. The folder of the former state is removed unless
    ``keep_previous`` leaves it to readers that still use it.
    """
    spark = source.sparkSession
    staged, folder = scratch_path(spark, "merge"), None
    try:
        ensure_table(spark, name, schema)
        # Read by the check and by three branches of the merge: computed once.
        rows = stage(conform(source, schema), path=staged)
        rows_in = rows.count()
        if not rows_in:
            return LoadResult("empty", rows_total=spark.table(name).count())
        former = table_location(spark, name)
        target = spark.table(name)
        upsert.check_unique_matches(target, rows, keys)
        merged = upsert.merge(target, rows, keys, change_test, ignore, with_status=True)
        status = F.col(upsert.STATUS)
        if merged.where(status != "kept").isEmpty():
            return LoadResult("loaded", rows_in=rows_in, rows_total=target.count())
        seen = Observation()
        observed = merged.observe(
            seen,
            F.count(F.lit(1)).alias("total"),
            F.count_if(status == "updated").alias("updated"),
            F.count_if(status == "inserted").alias("inserted"),
        )
        folder = _beside(former)
        observed.drop(upsert.STATUS).write.parquet(folder)
        counts = seen.get
        _point_at(spark, name, former, folder)
        # From here on the new folder is the table's.
        folder = None if keep_previous else former
        return LoadResult(
            "loaded",
            rows_in=rows_in,
            rows_total=counts["total"],
            inserted=counts["inserted"],
            updated=counts["updated"],
        )
    finally:
        for unused in (staged, folder):
            if unused:
                discard(spark, unused)


BUCKET = "bucket"
DEFAULT_BUCKETS = 1024


def bucket_count(spark: SparkSession, path: str, wanted: int | None) -> int:
    """The number of folders a table was made with; kept with the table from the first write on.

    Another number would look for keys in the wrong folders and is refused.
    """
    kept = f"{path}/_buckets"
    if matches(spark, kept):
        found = spark.read.parquet(kept).first()["buckets"]
        if wanted not in (None, found):
            raise ValueError(f"{path} has {found} buckets, not {wanted}")
        return found
    wanted = wanted or DEFAULT_BUCKETS
    spark.range(1).select(F.lit(wanted).alias("buckets")).coalesce(1).write.parquet(kept)
    return wanted


@reported
def merge_into_buckets(
    source: DataFrame,
    path: str,
    schema: T.StructType,
    keys: Sequence[str],
    buckets: int | None = None,
    change_test: str = "ansi",
    ignore: Sequence[str] = (),
) -> LoadResult:
    """Upsert into parquet folders by key hash: work grows with the touched folders, not with
    the table.

    Only folders that hold a source key are read and only those with a change are replaced, each
    when the whole job has succeeded. ``buckets`` is chosen with the first batch. For tables where
    a batch touches nearly every folder, or where readers must see all of an upsert at once,
    :func:`merge_into` is the better choice. Read the table with :func:`read_buckets`.
    """
    spark = source.sparkSession
    staged, result = scratch_path(spark, "merge"), scratch_path(spark, "merged")
    try:
        count = bucket_count(spark, path, buckets)
        bucket = F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(count)).cast("int")
        rows = stage(conform(source, schema).withColumn(BUCKET, bucket), path=staged)
        rows_in = rows.count()
        if not rows_in:
            return LoadResult("empty")
        # At most ``buckets`` numbers, named in the filter so that the other folders are not listed.
        touched = [r[BUCKET] for r in rows.select(BUCKET).distinct().collect()]
        target = read_buckets(spark, path, schema).where(F.col(BUCKET).isin(touched))
        upsert.check_unique_matches(target, rows, [*keys, BUCKET])
        merged = upsert.merge(
            target, rows, [*keys, BUCKET], change_test, ignore, with_status=True
        )
        status = F.col(upsert.STATUS)
        # Settled before the folders it was read from are replaced.
        merged = stage(merged, path=result)
        counts = (
            merged.groupBy(BUCKET)
            .agg(
                F.count_if(status == "updated").alias("updated"),
                F.count_if(status == "inserted").alias("inserted"),
            )
            .where("updated + inserted > 0")
            .collect()
        )
        changed = [r[BUCKET] for r in counts]
        if changed:
            (
                merged.where(F.col(BUCKET).isin(changed))
                .drop(upsert.STATUS)
                .hint("rebalance", BUCKET)
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy(BUCKET)
                .parquet(path)
            )
        return LoadResult(
            "loaded",
            rows_in=rows_in,
            inserted=sum(r["inserted"] for r in counts),
            updated=sum(r["updated"] for r in counts),
        )
    finally:
        for folder in (staged, result):
            discard(spark, folder)


def read_buckets(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a table kept by :func:`merge_into_buckets`, with the ``bucket`` column; an
    empty table if nothing was written yet."""
    full = T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])
    if not matches(spark, path):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(path)
