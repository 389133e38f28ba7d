"""CSV, JSON and page sources with file lineage."""

from __future__ import annotations

import csv
import re
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayloom.schemas import FORECAST_PAYLOAD, PAGE, TRIPS_RAW
from wayloom.session import matches

TRIP_FILES = "*travel_data_*.csv"


def source_file() -> Column:
    """Base name of the file a row came from.

    Spark writes a CSV "file" as a folder of part files; then the folder's name counts.
    """
    return base_name(_decoded(F.col("_metadata.file_path")))


def _decoded(path: Column) -> Column:
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.when(F.contains(path, F.lit("%")), decoded).otherwise(path)


def _whole_file(path: Column) -> Column:
    """The path, that of the folder if it is one of its parts."""
    return F.regexp_replace(path, r"(\.[A-Za-z0-9]+)/part-[^/]*$", "$1")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(_whole_file(path), "/"), -1)


# The words that usual CSV readers take for a missing value.
MISSING_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

#: Quotes are doubled inside quotes, and white space belongs to the value.
CSV_OPTIONS = {
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType = TRIPS_RAW,
    lineage: str | None = None,
    missing: tuple[str, ...] = MISSING_WORDS,
    multi_line: bool = True,
) -> DataFrame:
    """CSV with header rows, the declared columns taken by name.

    Files may order their columns differently, lack some (NULL) or have more (left out). Values in
    ``missing`` are NULL, and so is text that is not of a declared number or date type. Quoted
    values may hold quotes and line ends; with ``multi_line`` off, a value may not hold line ends
    and a large file is split over tasks, with it on a file (not a folder of parts) is one task.
    ``lineage`` names a column for the source file. Paths that match nothing give an empty table.

    Headers are looked up by :func:`csv_headers`, in a number of jobs that does not depend on the
    number of files; files that share a header are read together.
    """
    groups: dict[tuple[str, ...], list[str]] = {}
    for file, header in csv_headers(spark, [path] if isinstance(path, str) else path):
        groups.setdefault(header, []).append(file)
    tables = [
        _of_header(spark, header, paths, schema, lineage, missing, multi_line)
        for header, paths in groups.items()
    ]
    if not tables:
        table = spark.createDataFrame([], schema)
        return table.withColumn(lineage, F.lit(None).cast("string")) if lineage else table
    return reduce(DataFrame.unionByName, tables)


#: Up to here files are opened one by one for their header, which reads no more than that of them.
FEW_FILES = 8


def csv_headers(spark: SparkSession, paths: list[str]) -> list[tuple[str, tuple[str, ...]]]:
    """Each file with its column names, in order of path; files without a line are left out.

    A folder of part files is one file, whose first part with contents tells the header. One job
    lists the files and, if they are many, one more takes the first line of each in tasks. A header
    that goes on over a line end is read again by itself.
    """
    paths, found = _listed(spark, paths)
    if found is None:
        return []
    files = found.where("length > 0").groupBy(_whole_file(F.col("path")).alias("file")).agg(
        F.min("path").alias("first"), F.count("*").alias("parts")
    )
    files = files.collect()
    first = {r["first"]: r["file"] for r in files}
    if len(first) <= FEW_FILES:
        headers = {part: _header(spark, part) for part in first}
    else:
        # Without folders of parts the paths as given are quicker to list.
        whole = all(r["parts"] == 1 for r in files)
        lines = {r["path"]: r["line"] for r in _first_lines(spark, paths if whole else list(first)).collect()}
        headers = {}
        for part in first:
            line = lines.get(_one_slash(part), "")
            # An open quote or signs that the path is spelt in another way: ask the reader itself.
            plain = line and line.count('"') % 2 == 0
            headers[part] = tuple(next(csv.reader([line]))) if plain else _header(spark, part)
    return sorted((first[part], header) for part, header in headers.items() if header)


def _first_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(path, line)``: the first line of each file that is not empty."""
    lines = spark.read.option("recursiveFileLookup", True).text(paths).select(
        _decoded(F.col("_metadata.file_path")).alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.ltrim(F.col("value"), F.lit("\ufeff")).alias("line"),
        F.monotonically_increasing_id().alias("at"),
    )
    lines = lines.where("start = 0 AND line <> ''")
    path = F.regexp_replace("path", "^([a-z0-9]+:)/+", "$1/")
    return lines.groupBy(path.alias("path")).agg(F.min_by("line", "at").alias("line"))


def _one_slash(path: str) -> str:
    """A path whose scheme is followed by one slash, as some of Spark's readers write it."""
    return re.sub("^([a-z0-9]+:)/+", r"\1/", path)


def _listed(spark: SparkSession, paths: list[str]) -> tuple[list[str], DataFrame | None]:
    """The paths and patterns that find anything, and the files below them; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    try:
        return paths, reader.load(paths)
    except AnalysisException:
        paths = [p for p in paths if matches(spark, p)]
        return paths, reader.load(paths) if paths else None


def _header(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Column names of a file, empty if it has no line."""
    reader = spark.read.options(**CSV_OPTIONS).option("multiLine", True).option("header", False)
    first = reader.csv(path).head()
    return tuple(x or "" for x in first) if first else ()


def _of_header(
    spark: SparkSession,
    header: tuple[str, ...],
    paths: list[str],
    schema: T.StructType,
    lineage: str | None,
    missing: tuple[str, ...],
    multi_line: bool,
) -> DataFrame:
    """The files that share one header, which fixes where each column stands."""
    placed = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(header))])
    reader = spark.read.schema(placed).options(**CSV_OPTIONS).option("header", True)
    table = reader.option("multiLine", multi_line).csv(paths)
    columns = []
    for field in schema.fields:
        value = F.lit(None).cast("string")
        if field.name in header:
            value = F.col(f"_{header.index(field.name)}")
            value = F.when(~value.isin(*missing), value)
        if not isinstance(field.dataType, T.StringType):
            value = value.try_cast(field.dataType)
        columns.append(value.alias(field.name))
    return table.select(*columns, *([source_file().alias(lineage)] if lineage else []))


def list_files(spark: SparkSession, folder: str, pattern: str = TRIP_FILES) -> DataFrame:
    """``(path, name, parts, bytes, modified)`` of the matching files; contents are not read."""
    if not matches(spark, f"{folder}/{pattern}"):
        return spark.createDataFrame(
            [], "path string, name string, parts long, bytes long, modified timestamp"
        )
    found = spark.read.format("binaryFile").load(f"{folder}/{pattern}")
    # A folder of part files is one file here.
    return found.groupBy(_whole_file(F.col("path")).alias("path"), base_name(F.col("path")).alias("name")).agg(
        F.count("*").alias("parts"),
        F.sum("length").alias("bytes"),
        F.max("modificationTime").alias("modified"),
    )


def latest_file(
    spark: SparkSession, folder: str, pattern: str = TRIP_FILES, by: str = "date"
) -> str | None:
    """Path of the newest file, None if there is none.

    ``by="date"`` takes the ``yyyyMMdd`` in the name, the name deciding among equals;
    ``by="name"`` takes the last name. A maximum over the listing, not a sort, and only the
    winner is opened afterwards.
    """
    files = list_files(spark, folder, pattern)
    stamp = F.regexp_extract("name", r"([0-9]{8})(?:_[0-9]{6})?(?:_cleaned)?\.[^.]*$", 1)
    rank = {"date": F.struct(stamp, F.col("name")), "name": F.struct("name")}[by]
    return files.agg(F.max_by("path", rank).alias("path")).first()["path"]


def read_latest(
    spark: SparkSession,
    folder: str,
    pattern: str = TRIP_FILES,
    schema: T.StructType = TRIPS_RAW,
    by: str = "date",
    lineage: str | None = None,
) -> DataFrame:
    """Rows of the newest file only; an empty table if there is no file."""
    newest = latest_file(spark, folder, pattern, by)
    return read_csv(spark, newest or f"{folder}/{pattern}", schema, lineage)


def read_payloads(spark: SparkSession, path: str, schema: T.StructType = FORECAST_PAYLOAD) -> DataFrame:
    """Nested forecast payloads, one JSON object per line, plain or gzip."""
    return spark.read.schema(schema).json(path)


def read_pages(spark: SparkSession, path: str, schema: T.StructType = PAGE) -> DataFrame:
    """Raw page records, one JSON object per line."""
    return spark.read.schema(schema).json(path)
