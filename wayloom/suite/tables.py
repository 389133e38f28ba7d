"""Files, archives, appends, upserts and incremental pickup on the given tables."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayloom.operators import quality, upsert
from wayloom.session import scratch_path, set_times, stage
from wayloom.sinks import files as file_sinks
from wayloom.sinks import loads
from wayloom.sinks import tables as table_sinks
from wayloom.sources import files as sources
from wayloom.streaming import pickup
from wayloom.sources import reference_lists as lists
from wayloom.suite import inputs
from wayloom.suite.inputs import table
from wayloom.suite.weather import SQL_DAYS

NOW = dt.datetime(2024, 1, 5, 12, 0, tzinfo=dt.timezone.utc)


def _fresh_database(spark: SparkSession) -> str:
    name = f"wayloom_{uuid.uuid4().hex[:10]}"
    table_sinks.ensure_database(spark, name, location=scratch_path(spark, name))
    return name


# --- files ------------------------------------------------------------------------------


def csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part")
    base = scratch_path(spark, "csv")
    path = file_sinks.write_csv(parts, base, file_sinks.dated_name("part_data", NOW))
    return sources.read_csv(spark, path, parts.schema, lineage="source_file")


SQL_CSV_ROUNDTRIP = "SELECT *, 'part_data_20240105.csv' AS source_file FROM part"


def latest_file(spark: SparkSession, folder: str) -> DataFrame:
    """Customers written in one file per market segment; the newest by date is read back.

    The plain name sorts last but carries the oldest date.
    """
    customer = table(spark, folder, "customer")
    names = {
        "AUTOMOBILE": "raw_travel_data_20240103.csv",
        "BUILDING": "faker_travel_data_20240104.csv",
        "FURNITURE": "travel_data_20240101.csv",
        "HOUSEHOLD": "raw_travel_data_20240104.csv",
        "MACHINERY": "raw_travel_data_20240102.csv",
    }
    base = scratch_path(spark, "daily")
    for segment, name in names.items():
        file_sinks.write_csv(customer.where(F.col("c_mktsegment") == segment), base, name)
    return sources.read_latest(spark, base, schema=customer.schema, lineage="source_file")


SQL_LATEST_FILE = """
SELECT *, 'raw_travel_data_20240104.csv' AS source_file FROM customer
WHERE c_mktsegment = 'HOUSEHOLD'"""


def incremental_pickup(spark: SparkSession, folder: str) -> DataFrame:
    """All trips as one file per order status, picked up in two runs and a third that finds
    nothing new."""
    base = scratch_path(spark, "pickup")
    trips = inputs.raw_trips(spark, folder)
    dated = F.regexp_extract("Start date", "unknown", 0) == ""
    trips = trips.withColumn("Start date", F.when(dated, F.col("Start date")))
    groups = {
        "travel_data_20240101.csv": F.col("Traveler gender") == "Male",
        "travel_data_20240102.csv": F.col("Traveler gender") == "Female",
        "raw_travel_data_20240103.csv": F.col("Traveler gender").isNull(),
    }

    def run() -> None:
        pickup.pick_up_trips(
            spark, f"{base}/in", f"{base}/table", ingested_at=NOW
        )

    names = list(groups)
    for name in names[:2]:
        file_sinks.write_csv(trips.where(groups[name]), f"{base}/in", name)
    run()
    file_sinks.write_csv(trips.where(groups[names[2]]), f"{base}/in", names[2])
    run()
    run()
    loaded = pickup.loaded_trips(spark, f"{base}/table")
    return loaded.select(
        "Trip_ID",
        "Destination",
        "Start_date",
        "End_date",
        "Duration_days",
        "Traveler_gender",
        "Accommodation_cost",
        "Transportation_cost",
        "Source_file",
    )


SQL_PICKUP = f"""
SELECT o_orderkey AS Trip_ID, n_name AS Destination, {inputs.SQL_START} AS Start_date,
       {inputs.SQL_END} AS End_date, CAST({inputs.SQL_DURATION} AS BIGINT) AS Duration_days,
       {inputs.SQL_GENDER} AS Traveler_gender,
       {inputs.sql_amount("o_totalprice")} AS Accommodation_cost,
       {inputs.sql_amount("c_acctbal")} AS Transportation_cost,
       CASE o_orderstatus WHEN 'O' THEN 'travel_data_20240101.csv'
            WHEN 'F' THEN 'travel_data_20240102.csv'
            ELSE 'raw_travel_data_20240103.csv' END AS Source_file
{inputs.SQL_TRIPS_FROM}"""


def pickup_withholds(spark: SparkSession, folder: str) -> DataFrame:
    """The same files with their unreadable dates left in: which ones are withheld."""
    base = scratch_path(spark, "withhold")
    trips = inputs.raw_trips(spark, folder)
    readable = F.col("Start date") != "unknown"
    file_sinks.write_csv(trips.where(readable), f"{base}/in", "travel_data_20240101.csv")
    file_sinks.write_csv(trips.where(~readable), f"{base}/in", "travel_data_20240102.csv")
    pickup.pick_up_trips(spark, f"{base}/in", f"{base}/table")
    loaded = pickup.loaded_trips(spark, f"{base}/table").agg(F.count("*").alias("rows"))
    log = pickup.file_log(spark, f"{base}/table")
    return log.select("Source_file", "rows", "loaded").unionByName(
        loaded.select(F.lit("table").alias("Source_file"), "rows", F.lit(True).alias("loaded"))
    )


SQL_WITHHOLDS = f"""
WITH t AS (SELECT o_orderpriority = '2-HIGH' AS bad {inputs.SQL_TRIPS_FROM})
SELECT 'travel_data_2024010' || (1 + CAST(bad AS INTEGER)) || '.csv' AS Source_file,
       count(*) AS rows, NOT bad AS loaded FROM t GROUP BY bad
UNION ALL SELECT 'table', count(*), true FROM t WHERE NOT bad"""


PICKED = ("Trip_ID", "Destination", "Accommodation_cost", "Source_file")


def _dated_trips(spark: SparkSession, folder: str) -> DataFrame:
    """Trips whose dates can all be read."""
    trips = inputs.raw_trips(spark, folder)
    return trips.withColumn(
        "Start date", F.when(F.col("Start date") != "unknown", F.col("Start date"))
    )


def pickup_late_file(spark: SparkSession, folder: str) -> DataFrame:
    """A file that arrives with a time two years before the ones loaded already."""
    base = scratch_path(spark, "late")
    trips = _dated_trips(spark, folder)
    early = F.col("Traveler gender") == "Female"
    file_sinks.write_csv(trips.where(~early | early.isNull()), f"{base}/in", "travel_data_20240102.csv")
    pickup.pick_up_trips(spark, f"{base}/in", f"{base}/table")
    path = file_sinks.write_csv(trips.where(early), f"{base}/in", "travel_data_20220102.csv")
    set_times(spark, path, dt.datetime(2022, 1, 2, tzinfo=dt.timezone.utc))
    pickup.pick_up_trips(spark, f"{base}/in", f"{base}/table")
    return pickup.loaded_trips(spark, f"{base}/table").select(*PICKED)


def _sql_picked(names: str) -> str:
    return f"""
SELECT o_orderkey AS Trip_ID, n_name AS Destination,
       {inputs.sql_amount("o_totalprice")} AS Accommodation_cost, {names} AS Source_file
{inputs.SQL_TRIPS_FROM}"""


SQL_PICKUP_LATE = _sql_picked(
    "CASE WHEN o_orderstatus = 'F' THEN 'travel_data_20220102.csv' ELSE 'travel_data_20240102.csv' END"
)


def pickup_many_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Files of many parts: one with a single bad row in one part is withheld whole."""
    base = scratch_path(spark, "parts")
    trips = _dated_trips(spark, folder).repartition(40, "Trip ID")
    first = F.col("Trip ID").cast("bigint") == trips.agg(F.min(F.col("Trip ID").cast("bigint"))).scalar()
    spoilt = trips.withColumn("Start date", F.when(first, "soon").otherwise(F.col("Start date")))
    file_sinks.write_csv(spoilt, f"{base}/in", "travel_data_20240101.csv")
    file_sinks.write_csv(trips, f"{base}/in", "travel_data_20240102.csv")
    pickup.pick_up_trips(spark, f"{base}/in", f"{base}/table")
    loaded = pickup.loaded_trips(spark, f"{base}/table").groupBy("Source_file").agg(
        F.count("*").alias("loaded_rows")
    )
    log = pickup.file_log(spark, f"{base}/table")
    return log.select("Source_file", "rows", "malformed_rows", "loaded").join(loaded, "Source_file", "left")


SQL_PICKUP_PARTS = f"""
WITH t AS (SELECT count(*) AS rows {inputs.SQL_TRIPS_FROM})
SELECT 'travel_data_20240101.csv' AS Source_file, rows, CAST(1 AS BIGINT) AS malformed_rows,
       false AS loaded, CAST(NULL AS BIGINT) AS loaded_rows FROM t
UNION ALL SELECT 'travel_data_20240102.csv', rows, 0, true, rows FROM t"""


def pickup_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Files taken three at a time: what each batch published, and all rows once."""
    base = scratch_path(spark, "batches")
    trips = _dated_trips(spark, folder)
    for k in range(7):
        chosen = trips.where(F.col("Trip ID").cast("bigint") % 7 == k)
        file_sinks.write_csv(chosen, f"{base}/in", f"travel_data_2024010{k + 1}.csv")
    for _ in range(2):
        pickup.pick_up_trips(spark, f"{base}/in", f"{base}/table", batch_files=3)
    log = pickup.file_log(spark, f"{base}/table").groupBy("load").agg(
        F.concat_ws(" ", F.sort_array(F.collect_list("Source_file"))).alias("files"),
        F.sum("rows").alias("rows"),
    )
    loaded = pickup.loaded_trips(spark, f"{base}/table").groupBy("Source_file").agg(F.count("*").alias("n"))
    return log.select("files", "rows").unionByName(
        loaded.select(F.col("Source_file").alias("files"), F.col("n").alias("rows"))
    )


SQL_PICKUP_BATCHES = f"""
WITH t AS (SELECT o_orderkey % 7 AS k, count(*) AS n {inputs.SQL_TRIPS_FROM} GROUP BY 1),
named AS (SELECT 'travel_data_2024010' || (k + 1) || '.csv' AS file, n, CAST(k AS INTEGER) // 3 AS batch FROM t)
SELECT string_agg(file, ' ' ORDER BY file) AS files, CAST(sum(n) AS BIGINT) AS rows FROM named GROUP BY batch
UNION ALL SELECT file, n FROM named"""


def pickup_retry(spark: SparkSession, folder: str) -> DataFrame:
    """A withheld file is tried again when it has been corrected in place."""
    base = scratch_path(spark, "retry")
    trips = inputs.raw_trips(spark, folder)
    file_sinks.write_csv(trips, f"{base}/in", "travel_data_20240101.csv")
    pickup.pick_up_trips(spark, f"{base}/in", f"{base}/table")
    file_sinks.write_csv(_dated_trips(spark, folder), f"{base}/in", "travel_data_20240101.csv")
    for _ in range(2):
        pickup.pick_up_trips(spark, f"{base}/in", f"{base}/table")
    return pickup.loaded_trips(spark, f"{base}/table").select(*PICKED)


SQL_PICKUP_RETRY = _sql_picked("'travel_data_20240101.csv'")


def pickup_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Rows without an id, from a file loaded with gaps, as they were read."""
    base = scratch_path(spark, "rejects")
    trips = _dated_trips(spark, folder)
    known = F.col("Traveler gender") != "Female"
    trips = trips.withColumn("Trip ID", F.when(known | known.isNull(), F.col("Trip ID")))
    file_sinks.write_csv(trips, f"{base}/in", "travel_data_20240101.csv")
    pickup.pick_up_trips(spark, f"{base}/in", f"{base}/table", on_error="null")
    rejected = pickup.rejected_trips(spark, f"{base}/table")
    loaded = pickup.loaded_trips(spark, f"{base}/table")
    return (
        rejected.groupBy("Destination")
        .agg(F.count("*").alias("rows"))
        .withColumn("kind", F.lit("rejected"))
        .unionByName(
            loaded.groupBy("Destination").agg(F.count("*").alias("rows")).withColumn("kind", F.lit("loaded"))
        )
    )


SQL_PICKUP_REJECTS = f"""
SELECT n_name AS Destination, count(*) AS rows,
       CASE WHEN o_orderstatus = 'F' THEN 'rejected' ELSE 'loaded' END AS kind
{inputs.SQL_TRIPS_FROM} GROUP BY ALL"""


def csv_messy(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts with quotes, commas and line ends, in two files that order their columns
    differently; one lacks a column and has another one more."""
    documents = table(spark, folder, "documents")
    quoted = F.concat(F.lit('He said ""hi"", "ok",\n'), F.col("text"), F.lit(' "'))
    messy = documents.withColumn("text", quoted)
    english = F.col("lang") == "en"
    base = scratch_path(spark, "messy")
    file_sinks.write_csv(messy.where(english), base, "a.csv")
    other = messy.where(~english).select("n_chars", "text", F.lit("x").alias("more"), "lang", "doc_id")
    file_sinks.write_csv(other, base, "b.csv")
    back = sources.read_csv(spark, f"{base}/*.csv", documents.schema, lineage="file")
    return back.select("doc_id", F.md5("text").alias("digest"), "lang", "source", "n_chars", "file")


SQL_CSV_MESSY = """
SELECT doc_id, md5('He said ""hi"", "ok",' || chr(10) || text || ' "') AS digest, lang,
       CASE WHEN lang = 'en' THEN source END AS source, n_chars,
       CASE WHEN lang = 'en' THEN 'a.csv' ELSE 'b.csv' END AS file
FROM documents"""


def csv_missing_words(spark: SparkSession, folder: str) -> DataFrame:
    """Words for a missing value in text and number columns."""
    part = table(spark, folder, "part")
    words = F.array(*[F.lit(w) for w in sources.MISSING_WORDS], F.lit("none"), F.lit("N.A."))
    word = F.element_at(words, (F.col("p_partkey") % F.size(words) + 1).cast("int"))
    odd = F.col("p_size") % 2 == 1
    messy = part.select(
        "p_partkey",
        F.when(odd, word).otherwise(F.col("p_name")).alias("p_name"),
        F.when(odd, word).otherwise(F.col("p_retailprice").cast("string")).alias("p_retailprice"),
    )
    path = file_sinks.write_csv(messy, scratch_path(spark, "words"), "part.csv")
    schema = T.StructType([f for f in part.schema.fields if f.name in messy.columns])
    return sources.read_csv(spark, path, schema)


SQL_CSV_WORDS = f"""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name
       WHEN p_partkey % {len(sources.MISSING_WORDS) + 2} = {len(sources.MISSING_WORDS)} THEN 'none'
       WHEN p_partkey % {len(sources.MISSING_WORDS) + 2} = {len(sources.MISSING_WORDS) + 1} THEN 'N.A.'
       END AS p_name, CASE WHEN p_size % 2 = 0 THEN p_retailprice END AS p_retailprice
FROM part"""


def csv_many_files(spark: SparkSession, folder: str) -> DataFrame:
    """Two thousand small files under three headers: other order, a column too few, one too many."""
    orders = table(spark, folder, "orders")
    base = scratch_path(spark, "files")
    names = orders.columns
    shapes = {"plain": names, "turned": names[::-1], "short": names[:-1]}
    for k, (shape, columns) in enumerate(shapes.items()):
        rows = orders.where(F.col("o_orderkey") % 3 == k).select(*columns).repartition(FILES_PER_SHAPE, "o_orderkey")
        if shape == "turned":
            rows = rows.withColumn("extra, one", F.lit("x"))
        rows.write.options(**sources.CSV_OPTIONS).option("header", True).csv(f"{base}/{shape}")
    read = sources.read_csv(spark, f"{base}/*", orders.schema)
    return read.withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


FILES_PER_SHAPE = 667
SQL_CSV_MANY_FILES = """
SELECT * REPLACE (CAST(o_orderdate AS VARCHAR) AS o_orderdate,
  CASE WHEN o_orderkey % 3 <> 2 THEN o_orderpriority END AS o_orderpriority) FROM orders"""


def clean_latest(spark: SparkSession, folder: str) -> DataFrame:
    """The newest of two trip files, cleaned to a file and read back."""
    from wayloom.plans import flows

    base = scratch_path(spark, "clean")
    trips = _dated_trips(spark, folder)
    male = F.col("Traveler gender") == "Male"
    file_sinks.write_csv(trips.where(male), f"{base}/raw", "travel_data_20240101.csv")
    file_sinks.write_csv(trips.where(~male | male.isNull()), f"{base}/raw", "raw_travel_data_20240102.csv")
    path = flows.clean_latest(spark, f"{base}/raw", f"{base}/clean")
    back = sources.read_csv(spark, path, lineage="file")
    return back.select(
        F.col("Trip ID").cast("bigint").alias("trip"),
        F.col("Start date").alias("start_date"),
        F.col("Traveler gender").alias("gender"),
        F.col("Accommodation cost").cast("double").alias("cost"),
        "file",
    )


SQL_CLEAN_LATEST = f"""
SELECT o_orderkey AS trip, CAST({inputs.SQL_START} AS VARCHAR) AS start_date,
       {inputs.SQL_GENDER} AS gender, {inputs.sql_amount("o_totalprice")} AS cost,
       'raw_travel_data_20240102_cleaned.csv' AS file
{inputs.SQL_TRIPS_FROM} WHERE o_orderstatus <> 'O'"""


def json_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Events archived in folders by date, read back with the date parts as columns."""
    events = table(spark, folder, "events")
    path = scratch_path(spark, "archive")
    file_sinks.archive_partitioned(events, path, "ts")
    kept = T.StructType(
        [
            *[f for f in events.schema.fields if f.name != "ts"],
            *[T.StructField(n, T.StringType()) for n in ("year", "month", "day")],
        ]
    )
    back = spark.read.schema(kept).json(path)
    return back.groupBy("year", "month", "day", "event_type").agg(
        F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("value")
    )


SQL_JSON_ARCHIVE = """
SELECT strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month, strftime(ts, '%d') AS day,
       event_type, count(*) AS events, round(sum(value), 2) AS value
FROM events GROUP BY ALL"""


def gzip_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Whole document texts through a gzip JSON archive."""
    documents = table(spark, folder, "documents")
    path = file_sinks.archive_payloads(documents, scratch_path(spark, "gzip"), NOW)
    back = spark.read.schema(documents.schema).json(path)
    return back.select("doc_id", F.md5("text").alias("digest"), "lang", "n_chars")


SQL_GZIP_ARCHIVE = "SELECT doc_id, md5(text) AS digest, lang, n_chars FROM documents"


def page_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Raw pages and their fetch headers through the dated archive."""
    pages = _pages(spark, folder)
    path = file_sinks.archive_raw_pages(pages, scratch_path(spark, "wiki"), NOW)
    back = sources.read_pages(
        spark, path, T.StructType([*pages.schema.fields, T.StructField("slug", T.StringType())])
    )
    return back.select(
        "url",
        "slug",
        "status_code",
        F.col("headers")["Content-Type"].alias("content_type"),
        F.md5("content").alias("digest"),
        F.regexp_extract(F.input_file_name(), "(raw/wiki/[0-9/]+/[^/]+)/", 1).alias("archive"),
    )


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as fetched records; German ones failed, French ones came without a body."""
    lang = F.regexp_extract("html", '<html lang="([a-z]+)"', 1)
    return table(spark, folder, "pages").select(
        F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("destination_name"),
        "url",
        F.when(lang == "de", 404).otherwise(200).alias("status_code"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html")).alias("headers"),
        F.when(lang != "fr", F.col("html")).alias("content"),
        F.lit("utf-8").alias("encoding"),
    )


SQL_LANG = "regexp_extract(html, '<html lang=\"([a-z]+)\"', 1)"
SQL_PAGE_ARCHIVE = f"""
SELECT url, 'Page_' || page_id AS slug,
       CASE WHEN {SQL_LANG} = 'de' THEN 404 ELSE 200 END AS status_code,
       'text/html' AS content_type, CASE WHEN {SQL_LANG} <> 'fr' THEN md5(html) END AS digest,
       'raw/wiki/2024/01/05/20240105_120000.json' AS archive
FROM pages"""


def fetch_status(spark: SparkSession, folder: str) -> DataFrame:
    pages = _pages(spark, folder)
    failed = quality.failed_fetches(pages).select(
        F.lit("failed page").alias("status"), F.lit(1).cast("bigint").alias("pages"),
        F.col("destination_name").alias("page"),
    )
    return quality.fetch_summary(pages).withColumn("page", F.lit("")).unionByName(failed)


SQL_FETCH_STATUS = f"""
WITH p AS (SELECT page_id, {SQL_LANG} IN ('de', 'fr') AS bad FROM pages)
SELECT CASE WHEN bad THEN 'failed' ELSE 'succeeded' END AS status, count(*) AS pages, '' AS page
FROM p GROUP BY bad
UNION ALL SELECT 'failed page', 1, 'Page ' || page_id FROM p WHERE bad"""


# --- appends ----------------------------------------------------------------------------


def append_fixed(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers appended twice in the declared schema, an empty input in between."""
    supplier = table(spark, folder, "supplier")
    name = f"{_fresh_database(spark)}.supplier"
    in_debt = F.col("s_acctbal") < 0
    table_sinks.append(supplier.where(in_debt), name, supplier.schema)
    table_sinks.append(supplier.where(F.lit(False)), name, supplier.schema)
    table_sinks.append(supplier.where(~in_debt).drop("s_nationkey"), name, supplier.schema)
    return spark.table(name)


SQL_APPEND_FIXED = """
SELECT s_suppkey, s_name, CASE WHEN s_acctbal < 0 THEN s_nationkey END AS s_nationkey, s_acctbal
FROM supplier"""


def append_autodetect(spark: SparkSession, folder: str) -> DataFrame:
    """The second batch brings a column the table does not have."""
    customer = table(spark, folder, "customer")
    name = f"{_fresh_database(spark)}.customer"
    builders = F.col("c_mktsegment") == "BUILDING"
    table_sinks.append_autodetect(customer.where(builders), name)
    more = customer.where(~builders).withColumn("rating", F.lit("good")).drop("c_name")
    table_sinks.append_autodetect(more, name)
    return spark.table(name)


SQL_APPEND_AUTODETECT = """
SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name END AS c_name, c_nationkey,
       c_acctbal, c_mktsegment, CASE WHEN c_mktsegment <> 'BUILDING' THEN 'good' END AS rating
FROM customer"""


def append_widening(spark: SparkSession, folder: str) -> DataFrame:
    """Batches that need wider types than the table has, and one that goes with none of them."""
    orders = table(spark, folder, "orders")
    name = f"{_fresh_database(spark)}.orders"
    keys = F.col("o_orderkey")
    first = orders.select(
        keys.alias("id"), F.col("o_totalprice").cast("int").alias("price"), F.to_date("o_orderdate").alias("seen")
    )
    table_sinks.append_autodetect(first.where(F.col("id") % 3 == 0), name)
    exact = orders.select(
        keys.alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").cast("timestamp").alias("seen")
    )
    table_sinks.append_autodetect(exact.where(F.col("id") % 3 == 1), name)
    text = orders.select(keys.alias("id"), F.col("o_orderstatus").alias("price"))
    refused = table_sinks.append_autodetect(text.where(F.col("id") % 3 == 2), name)
    rows = spark.table(name).select("id", "price", F.date_format("seen", "yyyy-MM-dd").alias("seen"))
    return rows.withColumn("refused", F.lit(f"{refused.status}: {refused.error}"))


SQL_APPEND_WIDENING = """
SELECT o_orderkey AS id,
       CASE WHEN o_orderkey % 3 = 0 THEN trunc(o_totalprice) ELSE o_totalprice END AS price,
       strftime(o_orderdate, '%Y-%m-%d') AS seen,
       'failed: column price: string into double' AS refused
FROM orders WHERE o_orderkey % 3 < 2"""


def truncate_load(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    name = f"{_fresh_database(spark)}.part"
    table_sinks.truncate_and_load(part, name, part.schema)
    dearer = part.withColumn("p_retailprice", F.col("p_retailprice") * 2)
    table_sinks.truncate_and_load(dearer, name, part.schema)
    return spark.table(name)


SQL_TRUNCATE_LOAD = """
SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice * 2 AS p_retailprice FROM part"""


def append_new_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Customers seen in finished orders, then in all orders: each is stored once."""
    orders = table(spark, folder, "orders")
    name = f"{_fresh_database(spark)}.seen"
    seen = orders.select(F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status"))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in seen.schema.fields])
    table_sinks.append_new_keys(seen.where(F.col("status") == "P"), name, schema, "customer")
    table_sinks.append_new_keys(seen, name, schema, "customer")
    return spark.table(name)


SQL_APPEND_NEW_KEYS = """
SELECT o_custkey AS customer,
       CASE WHEN bool_or(o_orderstatus = 'P') THEN 'P' ELSE min(o_orderstatus) END AS status
FROM orders GROUP BY 1"""


# --- upsert -----------------------------------------------------------------------------

CUT = dt.datetime(1998, 7, 1)


def _state(orders: DataFrame, late: bool) -> DataFrame:
    """Per customer what is known from the orders before the cut, or from the ones since.

    Staged, because both sides of an upsert are read by several of its branches.
    """
    recent = F.col("o_orderdate") >= F.lit(CUT).cast("timestamp_ntz")
    return stage(
        orders.where(recent if late else ~recent)
        .groupBy(F.col("o_custkey").alias("customer"))
        .agg(
            F.max("o_totalprice").alias("top_price"),
            # A note exists only for urgent orders, so it appears and vanishes.
            F.max(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderkey"))).alias("note"),
            F.max(F.col("o_orderdate").cast("date")).alias("last_day"),
        )
    )


SQL_STATE = """
SELECT o_custkey AS customer, max(o_totalprice) AS top_price,
       max(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey END) AS note,
       CAST(max(o_orderdate) AS DATE) AS last_day
FROM orders WHERE o_orderdate {} TIMESTAMP '1998-07-01' GROUP BY 1"""


def merge_upsert(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    target, source = _state(orders, late=False), _state(orders, late=True)
    return upsert.merge(target, source, ["customer"], with_status=True)


def _sql_merge(changed: str) -> str:
    return f"""
WITH t AS ({SQL_STATE.format("<")}), s AS ({SQL_STATE.format(">=")}),
j AS (SELECT t.customer AS tc, s.customer AS sc, t.top_price AS tp, s.top_price AS sp,
             t.note AS tn, s.note AS sn, t.last_day AS td, s.last_day AS sd,
             coalesce({changed}, false) AS changed
      FROM t FULL JOIN s ON t.customer = s.customer)
SELECT coalesce(tc, sc) AS customer,
       CASE WHEN tc IS NULL OR changed THEN sp ELSE tp END AS top_price,
       CASE WHEN tc IS NULL OR changed THEN sn ELSE tn END AS note,
       CASE WHEN tc IS NULL OR changed THEN sd ELSE td END AS last_day,
       CASE WHEN tc IS NULL THEN 'inserted' WHEN changed THEN 'updated' ELSE 'kept' END
            AS _merge_status
FROM j"""


SQL_MERGE_UPSERT = _sql_merge(
    "t.top_price <> s.top_price OR t.note <> s.note OR t.last_day <> s.last_day"
)


def merge_null_safe(spark: SparkSession, folder: str) -> DataFrame:
    """Only a note that appears, vanishes or differs makes a change."""
    orders = table(spark, folder, "orders")
    return upsert.merge(
        _state(orders, late=False),
        _state(orders, late=True),
        ["customer"],
        change_test="null_safe",
        ignore=["top_price", "last_day"],
        with_status=True,
    )


SQL_MERGE_NULL_SAFE = _sql_merge(
    "t.customer IS NOT NULL AND s.customer IS NOT NULL AND t.note IS DISTINCT FROM s.note"
)


def merge_ansi_notes(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the three-valued test: a note that appears is no change by itself."""
    orders = table(spark, folder, "orders")
    return upsert.merge(
        _state(orders, late=False),
        _state(orders, late=True),
        ["customer"],
        ignore=["top_price", "last_day"],
        with_status=True,
    )


def merge_null_key(spark: SparkSession, folder: str) -> DataFrame:
    """Customers in debt have no key: kept in the target, inserted from the source."""
    customer = table(spark, folder, "customer")
    key = F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("name")
    target = customer.select(key, "c_acctbal", "c_mktsegment")
    source = customer.select(key, (F.col("c_acctbal") + 1).alias("c_acctbal"), "c_mktsegment")
    return upsert.merge(target, source, ["name"]).withColumn(
        "c_acctbal", F.round("c_acctbal", 2)
    )


SQL_MERGE_NULL_KEY = """
SELECT CASE WHEN c_acctbal >= 0 THEN c_name END AS name, round(c_acctbal + 1, 2) AS c_acctbal,
       c_mktsegment FROM customer
UNION ALL SELECT NULL, round(c_acctbal, 2), c_mktsegment FROM customer WHERE c_acctbal < 0"""


def merge_into_table(spark: SparkSession, folder: str) -> DataFrame:
    """The upsert through a catalog table, twice: the second run changes nothing."""
    orders = table(spark, folder, "orders")
    target, source = _state(orders, late=False), _state(orders, late=True)
    name = f"{_fresh_database(spark)}.customer_state"
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in target.schema.fields])
    table_sinks.append(target, name, schema)
    table_sinks.merge_into(source, name, schema, ["customer"])
    table_sinks.merge_into(source, name, schema, ["customer"])
    return spark.table(name)


SQL_MERGE_INTO_TABLE = f"SELECT * EXCLUDE (_merge_status) FROM ({SQL_MERGE_UPSERT})"


def merge_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """The same upsert into folders by key hash, the second run again changing nothing."""
    orders = table(spark, folder, "orders")
    target, source = _state(orders, late=False), _state(orders, late=True)
    path = scratch_path(spark, "buckets")
    for batch in (target, source, source):
        table_sinks.merge_into_buckets(batch, path, target.schema, ["customer"], buckets=16)
    return table_sinks.read_buckets(spark, path, target.schema).drop(table_sinks.BUCKET)


def run_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of a pickup run over all trips, without its clock times."""
    from wayloom.plans import flows

    base = scratch_path(spark, "run")
    trips = inputs.raw_trips(spark, folder)
    readable = F.col("Start date") != "unknown"
    file_sinks.write_csv(trips.where(readable), f"{base}/in", "travel_data_20240101.csv")
    file_sinks.write_csv(trips.where(~readable), f"{base}/in", "travel_data_20240102.csv")
    result = flows.run_trips(
        spark, f"{base}/in", f"{base}/table", generate=False, now=NOW
    )
    return flows.trip_metrics(spark, result, NOW).select(
        "flow", "files_generated", "files_ingested", "files_total", "rows_in", "rows_out", "success"
    )


SQL_RUN_METRICS = f"""
SELECT 'trips' AS flow, CAST(0 AS BIGINT) AS files_generated, CAST(1 AS BIGINT) AS files_ingested,
       CAST(2 AS BIGINT) AS files_total, count(*) AS rows_in,
       count(*) FILTER (o_orderpriority <> '2-HIGH') AS rows_out, false AS success
{inputs.SQL_TRIPS_FROM}"""


def metrics_history(spark: SparkSession, folder: str) -> DataFrame:
    """What two runs appended to the metrics table, beside the rows that they loaded."""
    from wayloom.plans import flows

    base, name = scratch_path(spark, "history"), f"{_fresh_database(spark)}.runs"
    trips = _dated_trips(spark, folder)
    even = F.col("Trip ID").cast("bigint") % 2 == 0
    for day, chosen in ((5, even), (6, ~even)):
        file_sinks.write_csv(trips.where(chosen), f"{base}/in", f"travel_data_2024010{day}.csv")
        now = dt.datetime(2024, 1, day, 12, tzinfo=dt.timezone.utc)
        flows.run_trips(spark, f"{base}/in", f"{base}/table", generate=False, now=now, metrics_table=name)
    loaded = pickup.loaded_trips(spark, f"{base}/table").groupBy("Source_file").agg(F.count("*").alias("stored"))
    day = F.regexp_extract("Source_file", "([0-9]{8})", 1)
    loaded = loaded.select(day.alias("day"), "stored")
    runs = spark.table(name).withColumn("day", F.date_format("timestamp", "yyyyMMdd"))
    return runs.join(loaded, "day").select("day", "flow", "files_ingested", "rows_in", "rows_out", "stored", "success")


SQL_METRICS_HISTORY = f"""
SELECT CASE WHEN o_orderkey % 2 = 0 THEN '20240105' ELSE '20240106' END AS day, 'trips' AS flow,
       CAST(1 AS BIGINT) AS files_ingested, count(*) AS rows_in, count(*) AS rows_out, count(*) AS stored,
       true AS success
{inputs.SQL_TRIPS_FROM} GROUP BY 1"""


def _loaded_table(spark: SparkSession, folder: str) -> tuple[str, str]:
    """Path and name of a table of all trips: files of four days, a load each, compacted after
    three of them and again at the end, with the loads of before removed."""
    base, name = scratch_path(spark, "named"), f"{_fresh_database(spark)}.trips"
    trips = _dated_trips(spark, folder)
    for day in range(4):
        chosen = F.col("Trip ID").cast("bigint") % 4 == day
        file_sinks.write_csv(trips.where(chosen), f"{base}/in", f"travel_data_2024010{day + 1}.csv")
        pickup.pick_up_trips(spark, f"{base}/in", f"{base}/table", ingested_at=NOW, table=name)
        if day >= 2:
            pickup.compact_trips(spark, f"{base}/table", name)
    later = dt.datetime.now(dt.timezone.utc) + dt.timedelta(days=1)
    loads.remove_replaced(spark, f"{base}/table", later, name)
    return f"{base}/table", name


def trips_table(spark: SparkSession, folder: str) -> DataFrame:
    """Sums of the trips by file, read by the table's name in the catalog."""
    _, name = _loaded_table(spark, folder)
    return spark.sql(
        f"""SELECT Source_file, Traveler_gender, count(*) AS trips, count(DISTINCT Trip_ID) AS ids,
                   sum(Duration_days) AS days, CAST(min(Start_date) AS STRING) AS first_start,
                   CAST(max(End_date) AS STRING) AS last_end
            FROM {name} GROUP BY Source_file, Traveler_gender"""
    )


SQL_TRIPS_TABLE = f"""
SELECT 'travel_data_2024010' || CAST(o_orderkey % 4 + 1 AS VARCHAR) || '.csv' AS Source_file,
       {inputs.SQL_GENDER} AS Traveler_gender, count(*) AS trips, count(DISTINCT o_orderkey) AS ids,
       CAST(sum({inputs.SQL_DURATION}) AS BIGINT) AS days, CAST(min({inputs.SQL_START}) AS VARCHAR) AS first_start,
       CAST(max({inputs.SQL_END}) AS VARCHAR) AS last_end
{inputs.SQL_TRIPS_FROM} GROUP BY 1, 2"""


def trips_compaction(spark: SparkSession, folder: str) -> DataFrame:
    """What the compactions of that table say they wrote, and the rows found in its one load."""
    path, _ = _loaded_table(spark, folder)
    compactions = loads.log(spark, path, "compactions", loads.COMPACTIONS)
    found = compactions.groupBy("load").agg(F.count("*").alias("loads_replaced"), F.max("rows").alias("rows"))
    stored = spark.read.parquet(f"{path}/rows").groupBy("load").agg(F.count("*").alias("stored"))
    return found.join(stored, "load", "left").select("loads_replaced", "rows", "stored")


SQL_TRIPS_COMPACTION = f"""
SELECT CAST(3 AS BIGINT) AS loads_replaced, count(*) AS rows, CAST(NULL AS BIGINT) AS stored
{inputs.SQL_TRIPS_FROM} WHERE o_orderkey % 4 < 3
UNION ALL
SELECT CAST(2 AS BIGINT), count(*), count(*) {inputs.SQL_TRIPS_FROM}"""


def load_reports(spark: SparkSession, folder: str) -> DataFrame:
    """What each kind of load says it did, as rows."""
    customer = table(spark, folder, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    base, name = _fresh_database(spark), "customer"
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in customer.schema.fields])
    building = F.col("c_mktsegment") == "BUILDING"
    richer = customer.withColumn("c_acctbal", F.col("c_acctbal") + 1)
    loads = {
        "append": table_sinks.append(customer.where(building), f"{base}.{name}", schema),
        "append nothing": table_sinks.append(customer.where("false"), f"{base}.{name}", schema),
        "merge": table_sinks.merge_into(richer, f"{base}.{name}", schema, ["c_custkey"]),
        "merge again": table_sinks.merge_into(richer, f"{base}.{name}", schema, ["c_custkey"]),
        "append new": table_sinks.append_new_keys(customer, f"{base}.{name}", schema, "c_custkey"),
        "replace": table_sinks.truncate_and_load(customer, f"{base}.{name}", schema),
        "fail": table_sinks.append(
            customer.withColumn("c_custkey", F.lit("x")), f"{base}.{name}", schema
        ),
    }
    rows = [
        (step, r.status, r.rows_in, r.rows_total, r.inserted, r.updated) for step, r in loads.items()
    ]
    return spark.createDataFrame(
        rows,
        "step string, status string, rows_in long, rows_total long, inserted long, updated long",
    )


SQL_LOAD_REPORTS = """
WITH c AS (SELECT count(*) AS n, count(*) FILTER (c_mktsegment = 'BUILDING') AS b FROM customer)
SELECT 'append' AS step, 'loaded' AS status, b AS rows_in, b AS rows_total, b AS inserted,
       CAST(0 AS BIGINT) AS updated FROM c
UNION ALL SELECT 'append nothing', 'empty', 0, b, 0, 0 FROM c
UNION ALL SELECT 'merge', 'loaded', n, n, n - b, b FROM c
UNION ALL SELECT 'merge again', 'loaded', n, n, 0, 0 FROM c
UNION ALL SELECT 'append new', 'empty', 0, n, 0, 0 FROM c
UNION ALL SELECT 'replace', 'loaded', n, n, n, 0 FROM c
UNION ALL SELECT 'fail', 'failed', 0, NULL, 0, 0 FROM c"""


def reference_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Nations that the lists of nationalities and destinations know by the start of a value."""
    nations = table(spark, folder, "nation").select("n_name", F.substring("n_name", 1, 4).alias("start"))
    listed = lists.trip_categories(spark).select(
        "category", "value", F.upper(F.substring("value", 1, 4)).alias("start")
    )
    counts = nations.join(listed, "start").groupBy("category").agg(F.count("*").alias("matches"))
    totals = lists.trip_categories(spark).groupBy("category").agg(F.count("*").alias("listed"))
    return totals.join(counts, "category", "left").na.fill(0, ["matches"])


def _sql_listed() -> str:
    values = {
        "destination": lists.TRIP_DESTINATIONS,
        "accommodation": lists.ACCOMMODATION_TYPES,
        "transportation": lists.TRANSPORTATION_TYPES,
        "nationality": lists.NATIONALITIES,
    }
    text = ", ".join(
        "('{}', '{}')".format(k, v.replace("'", "''")) for k, items in values.items() for v in items
    )
    return f"(VALUES {text}) AS l(category, value)"


SQL_REFERENCE_LISTS = f"""
SELECT category, count(DISTINCT value) AS listed,
       count(n_name) AS matches
FROM {_sql_listed()} LEFT JOIN nation ON upper(substr(value, 1, 4)) = substr(n_name, 1, 4)
GROUP BY 1"""


def listed_trips(spark: SparkSession, folder: str) -> DataFrame:
    """How many trips go to each listed place, by all six lists and the first letters of a name."""
    places = lists.destinations(spark).select(F.lit("sight").alias("category"), F.col("destination_name").alias("value"))
    towns = lists.locations(spark)
    listed = places.unionByName(lists.trip_categories(spark)).unionByName(
        towns.select(F.lit("town").alias("category"), F.concat_ws(", ", "country", "city").alias("value"))
    )
    listed = listed.withColumn("start", F.upper(F.substring("value", 1, 3)))
    # Trips are counted by place before they meet the lists.
    trips = inputs.raw_trips(spark, folder).groupBy("Destination").agg(F.count("*").alias("n"))
    trips = trips.withColumn("start", F.upper(F.substring("Destination", 1, 3)))
    found = listed.join(trips, "start", "left").groupBy("category", "value")
    return found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("trips"))


def _sql_all_lists() -> str:
    rows = [("sight", x) for x in lists.TRAVEL_DESTINATIONS]
    rows += [("town", f"{country}, {city}") for city, country, *_ in lists.LOCATIONS]
    text = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in rows)
    return f"(SELECT * FROM {_sql_listed()} UNION ALL SELECT * FROM (VALUES {text}) AS m(category, value))"


SQL_LISTED_TRIPS = f"""
WITH t AS (SELECT upper(substr(n_name, 1, 3)) AS start, count(*) AS n {inputs.SQL_TRIPS_FROM} GROUP BY n_name)
SELECT category, value, CAST(coalesce(sum(n), 0) AS BIGINT) AS trips
FROM {_sql_all_lists()} LEFT JOIN t ON upper(substr(value, 1, 3)) = start
GROUP BY category, value"""


def processed_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Records in the processed archive, read back: non-ASCII text and missing values survive."""
    records = table(spark, folder, "documents").select(
        F.concat(F.lit("D"), F.col("doc_id")).alias("destination_name"),
        F.when(F.col("lang") != "en", F.col("text")).alias("description"),
        F.struct(F.col("doc_id").cast("double").alias("latitude")).alias("coordinates"),
        F.lit(NOW).alias("ingestion_timestamp"),
    )
    path = file_sinks.archive_records(records, scratch_path(spark, "processed"), NOW)
    back = spark.read.schema(
        "destination_name string, description string, coordinates struct<latitude: double>, "
        "ingestion_timestamp string"
    ).json(path)
    return back.select(
        "destination_name",
        F.md5("description").alias("digest"),
        "coordinates.latitude",
        "ingestion_timestamp",
        F.regexp_extract(F.input_file_name(), "(processed/wiki/[^/]+)/", 1).alias("archive"),
    )


SQL_PROCESSED_ARCHIVE = """
SELECT 'D' || doc_id AS destination_name, CASE WHEN lang <> 'en' THEN md5(text) END AS digest,
       CAST(doc_id AS DOUBLE) AS latitude, '2024-01-05 12:00:00' AS ingestion_timestamp,
       'processed/wiki/destinations_20240105_120000.json' AS archive
FROM documents"""


def flow_trips(spark: SparkSession, folder: str) -> DataFrame:
    """The trips flow with generation: all orders from a file, and a batch made from them."""
    from wayloom.plans import flows

    base = scratch_path(spark, "flow-trips")
    trips = _dated_trips(spark, folder)
    file_sinks.write_csv(trips, f"{base}/in", "travel_data_20240101.csv")
    result = flows.run_trips(
        spark, f"{base}/in", f"{base}/table", sample=trips, method="tiered", now=NOW, n=50
    )
    metrics = flows.trip_metrics(spark, result, NOW).select(
        "flow", "generation_method", "files_generated", "files_ingested", "rows_in", "rows_out", "success"
    )
    ids = pickup.loaded_trips(spark, f"{base}/table").agg(
        F.min("Trip_ID").alias("first_id"), F.max("Trip_ID").alias("last_id")
    )
    return metrics.select(
        "*", ids.select("first_id").scalar().alias("first_id"), ids.select("last_id").scalar().alias("last_id")
    )


SQL_FLOW_TRIPS = f"""
SELECT 'trips' AS flow, 'tiered' AS generation_method, CAST(1 AS BIGINT) AS files_generated,
       CAST(2 AS BIGINT) AS files_ingested, count(*) + 50 AS rows_in, count(*) + 50 AS rows_out,
       true AS success, min(o_orderkey) AS first_id, max(o_orderkey) + 50 AS last_id
{inputs.SQL_TRIPS_FROM}"""


def flow_destinations(spark: SparkSession, folder: str) -> DataFrame:
    """The destinations flow over one page for each customer, run twice with other stamps."""
    from wayloom.plans import flows
    from wayloom.suite.pages import wiki_pages

    base, name = scratch_path(spark, "flow-wiki"), f"{_fresh_database(spark)}.destinations"
    pages = wiki_pages(spark, folder)
    failed = F.regexp_extract("destination_name", "([0-9]+)", 1).cast("int") % 50 == 0
    pages = pages.select(
        "destination_name",
        F.concat(F.lit("http://x/"), F.col("destination_name")).alias("url"),
        F.when(failed, 500).otherwise(200).alias("status_code"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html")).alias("headers"),
        "content",
        F.lit("utf-8").alias("encoding"),
    )
    for day in (0, 1):
        flows.run_destinations(spark, pages, base, name, now=NOW + dt.timedelta(days=day))
    return spark.table(name).select(
        "destination_name",
        "country",
        "population_count",
        "attractions_count",
        F.date_format("ingestion_timestamp", "yyyy-MM-dd").alias("day"),
    )


SQL_FLOW_DESTINATIONS = """
SELECT c_name AS destination_name, n_name AS country,
       CASE WHEN c_mktsegment <> 'FURNITURE' THEN c_custkey * 7919 + 1 END AS population_count,
       CAST(CASE WHEN c_mktsegment = 'MACHINERY' THEN 2 ELSE 5 END AS BIGINT) AS attractions_count,
       '2024-01-06' AS day
FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE CAST(regexp_extract(c_name, '([0-9]+)', 1) AS INTEGER) % 50 <> 0"""


def flow_weather(spark: SparkSession, folder: str) -> DataFrame:
    """The weather flow over one payload for each order: its report beside the table's rows."""
    from wayloom.plans import flows
    from wayloom.suite import weather as w

    base, name = scratch_path(spark, "flow-weather"), f"{_fresh_database(spark)}.weather"
    payloads = w.payloads(spark, folder)
    result = flows.run_weather(spark, payloads, base, name, payloads, w.DAYS, NOW)
    archived = sources.read_payloads(spark, result.steps["archive"]).count()
    stored = spark.table(name).agg(F.count("*").alias("rows"), F.round(F.sum("rain"), 2).alias("rain"))
    return stored.select(
        F.lit(result.success).alias("success"),
        F.lit(result.steps["expected_rows"]).cast("long").alias("expected"),
        F.lit(result.steps["coverage_pct"]).alias("coverage_pct"),
        F.lit(archived).cast("long").alias("archived"),
        "rows",
        "rain",
    )


QUERIES = {
    "load_reports": load_reports,
    "reference_lists": reference_lists,
    "listed_trips": listed_trips,
    "processed_archive": processed_archive,
    "flow_trips": flow_trips,
    "flow_destinations": flow_destinations,
    "flow_weather": flow_weather,
    "csv_roundtrip": csv_roundtrip,
    "latest_file": latest_file,
    "incremental_pickup": incremental_pickup,
    "pickup_withholds": pickup_withholds,
    "pickup_late_file": pickup_late_file,
    "pickup_many_parts": pickup_many_parts,
    "pickup_batches": pickup_batches,
    "pickup_retry": pickup_retry,
    "pickup_rejects": pickup_rejects,
    "csv_messy": csv_messy,
    "csv_missing_words": csv_missing_words,
    "csv_many_files": csv_many_files,
    "clean_latest": clean_latest,
    "json_archive": json_archive,
    "gzip_archive": gzip_archive,
    "page_archive": page_archive,
    "fetch_status": fetch_status,
    "append_fixed": append_fixed,
    "append_autodetect": append_autodetect,
    "append_widening": append_widening,
    "append_new_keys": append_new_keys,
    "truncate_load": truncate_load,
    "merge_upsert": merge_upsert,
    "merge_null_safe": merge_null_safe,
    "merge_ansi_notes": merge_ansi_notes,
    "merge_null_key": merge_null_key,
    "merge_into_table": merge_into_table,
    "merge_buckets": merge_buckets,
    "run_metrics": run_metrics,
    "metrics_history": metrics_history,
    "trips_table": trips_table,
    "trips_compaction": trips_compaction,
}
ORACLES = {
    "load_reports": SQL_LOAD_REPORTS,
    "reference_lists": SQL_REFERENCE_LISTS,
    "listed_trips": SQL_LISTED_TRIPS,
    "processed_archive": SQL_PROCESSED_ARCHIVE,
    "flow_trips": SQL_FLOW_TRIPS,
    "flow_destinations": SQL_FLOW_DESTINATIONS,
    "flow_weather": f"""
WITH d AS ({SQL_DAYS})
SELECT true AS success, (SELECT count(*) FROM orders) * 3 AS expected,
       round(100.0 * count(*) / ((SELECT count(*) FROM orders) * 3), 2) AS coverage_pct,
       (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') AS archived, count(*) AS rows,
       round(sum(CASE WHEN cheap THEN 0.0::DOUBLE ELSE 3.5::DOUBLE END), 2) AS rain
FROM d""",
    "csv_roundtrip": SQL_CSV_ROUNDTRIP,
    "latest_file": SQL_LATEST_FILE,
    "incremental_pickup": SQL_PICKUP,
    "pickup_withholds": SQL_WITHHOLDS,
    "pickup_late_file": SQL_PICKUP_LATE,
    "pickup_many_parts": SQL_PICKUP_PARTS,
    "pickup_batches": SQL_PICKUP_BATCHES,
    "pickup_retry": SQL_PICKUP_RETRY,
    "pickup_rejects": SQL_PICKUP_REJECTS,
    "csv_messy": SQL_CSV_MESSY,
    "csv_missing_words": SQL_CSV_WORDS,
    "csv_many_files": SQL_CSV_MANY_FILES,
    "clean_latest": SQL_CLEAN_LATEST,
    "json_archive": SQL_JSON_ARCHIVE,
    "gzip_archive": SQL_GZIP_ARCHIVE,
    "page_archive": SQL_PAGE_ARCHIVE,
    "fetch_status": SQL_FETCH_STATUS,
    "append_fixed": SQL_APPEND_FIXED,
    "append_autodetect": SQL_APPEND_AUTODETECT,
    "append_widening": SQL_APPEND_WIDENING,
    "append_new_keys": SQL_APPEND_NEW_KEYS,
    "truncate_load": SQL_TRUNCATE_LOAD,
    "merge_upsert": SQL_MERGE_UPSERT,
    "merge_null_safe": SQL_MERGE_NULL_SAFE,
    "merge_ansi_notes": _sql_merge("t.note <> s.note"),
    "merge_null_key": SQL_MERGE_NULL_KEY,
    "merge_into_table": SQL_MERGE_INTO_TABLE,
    "merge_buckets": SQL_MERGE_INTO_TABLE,
    "run_metrics": SQL_RUN_METRICS,
    "metrics_history": SQL_METRICS_HISTORY,
    "trips_table": SQL_TRIPS_TABLE,
    "trips_compaction": SQL_TRIPS_COMPACTION,
}
