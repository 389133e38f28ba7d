"""Parsing, cleaning, validation and duplicate removal on the given tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.functions import parse
from wayloom.functions.classify import description_from_text, keyword_class, name_from_text
from wayloom.operators import clean, dedup, validate
from wayloom.plans.trips import clean_trips, to_warehouse
from wayloom.session import spread
from wayloom.suite import inputs
from wayloom.suite.inputs import cores, table

STAMP = dt.datetime(2024, 1, 5, 12, 0, tzinfo=dt.timezone.utc)


def clean_currency(spark: SparkSession, folder: str) -> DataFrame:
    written = table(spark, folder, "orders").select(
        "o_orderkey", inputs.amount_text("o_totalprice").alias("cost_text")
    )
    return written.select(
        "*",
        parse.parse_currency(F.col("cost_text")).alias("amount"),
        F.when(
            ~parse.is_blank(F.col("cost_text")), parse.currency_style(F.col("cost_text"))
        ).alias("style"),
    )


SQL_CLEAN_CURRENCY = f"""
SELECT o_orderkey, {inputs.sql_amount_text("o_totalprice")} AS cost_text,
       {inputs.sql_amount("o_totalprice")} AS amount,
       CASE WHEN o_orderstatus = 'P' AND o_orderpriority IN ('5-LOW', '4-NOT SPECIFIED') THEN NULL
            WHEN o_orderpriority = '1-URGENT' AND o_totalprice >= 1000 THEN '$NUM_WITH_COMMAS'
            WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN '$NUM'
            WHEN o_orderpriority = '3-MEDIUM' THEN 'NUM_USD' ELSE 'NUM' END AS style
FROM orders"""


def coerce_number(spark: SparkSession, folder: str) -> DataFrame:
    value = F.col("value").cast("string")
    kind = F.col("event_type")
    text = (
        F.when(kind == "click", value)
        .when(kind == "view", F.concat(F.lit("  +"), value, F.lit(" ")))
        .when(kind == "error", F.concat(value, F.lit("d")))
        .when(kind == "purchase", "nan")
        .otherwise(F.concat(F.lit("1_"), value))
    )
    written = table(spark, folder, "events").select("event_id", text.alias("text"))
    number = parse.parse_number(F.col("text"))
    return written.select(
        "event_id", number.alias("number"), clean.or_default(number, 7.0).alias("or_default")
    )


SQL_COERCE_NUMBER = """
SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN value END AS number,
       CASE WHEN event_type IN ('click', 'view') THEN value ELSE 7.0 END AS or_default
FROM events"""


def parse_dates(spark: SparkSession, folder: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    status = F.col("o_orderstatus")
    text = (
        F.when(status == "F", parse.format_iso_date(day))
        .when(status == "O", parse.format_us_date(day))
        .otherwise(F.date_format(day, "yyyy/MM/dd"))
    )
    written = table(spark, folder, "orders").select("o_orderkey", "o_custkey", text.alias("text"))
    parsed = parse.parse_date(F.col("text"))
    length = F.pmod("o_custkey", F.lit(30))
    return written.select(
        "o_orderkey",
        "text",
        parsed.alias("day"),
        parse.format_us_date(parse.end_date(parsed, length)).alias("last_day"),
    )


SQL_PARSE_DATES = """
SELECT o_orderkey,
       CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%Y-%m-%d')
            WHEN 'O' THEN strftime(o_orderdate, '%-m/%-d/%Y')
            ELSE strftime(o_orderdate, '%Y/%m/%d') END AS text,
       CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS day,
       CASE WHEN o_orderstatus <> 'P' THEN strftime(
            CAST(o_orderdate AS DATE) + CAST(o_custkey % 30 AS INTEGER), '%-m/%-d/%Y')
            END AS last_day
FROM orders"""


def cleaned_trips(spark: SparkSession, folder: str) -> DataFrame:
    return clean_trips(inputs.raw_trips(spark, folder))


SQL_CLEAN_TRIPS = f"""
SELECT CAST(o_orderkey AS VARCHAR) AS "Trip ID", n_name AS "Destination",
       strftime({inputs.SQL_START}, '%Y-%m-%d') AS "Start date",
       strftime({inputs.SQL_END}, '%Y-%m-%d') AS "End date",
       CAST({inputs.SQL_DURATION} AS DOUBLE) AS "Duration (days)",
       c_name AS "Traveler name", CAST({inputs.SQL_AGE} AS DOUBLE) AS "Traveler age",
       {inputs.SQL_GENDER} AS "Traveler gender",
       {inputs.SQL_NATIONALITY} AS "Traveler nationality",
       {inputs.SQL_ACCOMMODATION} AS "Accommodation type",
       {inputs.sql_amount("o_totalprice")} AS "Accommodation cost",
       c_mktsegment AS "Transportation type",
       {inputs.sql_amount("c_acctbal")} AS "Transportation cost"
{inputs.SQL_TRIPS_FROM}"""


def warehouse_trips(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = clean_trips(inputs.raw_trips(spark, folder))
    shaped = to_warehouse(cleaned, F.lit(STAMP), F.lit("travel_data_20240105.csv"))
    stamp = F.date_format("Ingestion_timestamp", "yyyy-MM-dd HH:mm:ss")
    return shaped.withColumn("Ingestion_timestamp", stamp)


SQL_TO_WAREHOUSE = f"""
SELECT o_orderkey AS Trip_ID, n_name AS Destination, {inputs.SQL_START} AS Start_date,
       {inputs.SQL_END} AS End_date, CAST({inputs.SQL_DURATION} AS BIGINT) AS Duration_days,
       c_name AS Traveler_name, CAST({inputs.SQL_AGE} AS BIGINT) AS Traveler_age,
       {inputs.SQL_GENDER} AS Traveler_gender,
       {inputs.SQL_NATIONALITY} AS Traveler_nationality,
       {inputs.SQL_ACCOMMODATION} AS Accommodation_type,
       {inputs.sql_amount("o_totalprice")} AS Accommodation_cost,
       c_mktsegment AS Transportation_type,
       {inputs.sql_amount("c_acctbal")} AS Transportation_cost,
       '2024-01-05 12:00:00' AS Ingestion_timestamp, 'travel_data_20240105.csv' AS Source_file
{inputs.SQL_TRIPS_FROM}"""


def trip_costs(spark: SparkSession, folder: str) -> DataFrame:
    """Messy trips cleaned, shaped for the warehouse and summed up per kind of stay."""
    trips = to_warehouse(clean_trips(inputs.raw_trips(spark, folder)), F.lit(STAMP))
    return trips.groupBy("Accommodation_type", "Traveler_gender").agg(
        F.count("*").alias("trips"),
        F.round(F.avg("Accommodation_cost"), 2).alias("avg_cost"),
        F.round(F.avg("Duration_days"), 4).alias("avg_days"),
        F.count("Start_date").alias("dated"),
    )


SQL_TRIP_COSTS = f"""
SELECT Accommodation_type, Traveler_gender, count(*) AS trips, round(avg(cost), 2) AS avg_cost,
       round(avg(days), 4) AS avg_days, count(start_day) AS dated
FROM (SELECT {inputs.SQL_ACCOMMODATION} AS Accommodation_type,
             {inputs.SQL_GENDER} AS Traveler_gender, {inputs.SQL_DURATION} AS days,
             {inputs.sql_amount("o_totalprice")} AS cost, {inputs.SQL_START} AS start_day
      {inputs.SQL_TRIPS_FROM})
GROUP BY 1, 2"""


def fill_defaults(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    gaps = table(spark, folder, "events").select(
        *[
            F.when(kind != "error", F.col(c)).alias(c)
            for c in ("event_id", "user_id", "event_type")
        ],
        F.when(~kind.isin("error", "view"), F.col("value")).alias("value"),
        F.when(~kind.isin("error", "click"), F.col("props")).alias("props"),
    )
    kept = clean.drop_empty_rows(gaps)
    return clean.drop_columns(
        clean.fill_constants(kept, {"props": "Unknown", "value": 0.0}), "user_id", "absent"
    )


SQL_FILL_DEFAULTS = """
SELECT event_id, event_type, CASE WHEN event_type = 'view' THEN 0.0 ELSE value END AS value,
       CASE WHEN event_type = 'click' THEN 'Unknown' ELSE props END AS props
FROM events WHERE event_type <> 'error'"""


def range_check(spark: SparkSession, folder: str) -> DataFrame:
    """Balances read as coordinates: how many are valid places, and rejects per nation."""
    places = table(spark, folder, "customer").select(
        "c_nationkey",
        (F.col("c_acctbal") / 50).alias("latitude"),
        (F.col("c_acctbal") / 25).alias("longitude"),
    )
    valid, rejected = clean.split_by(
        places, clean.valid_location(F.col("latitude"), F.col("longitude"))
    )
    marked = valid.withColumn("verdict", F.lit("valid")).unionByName(
        rejected.withColumn("verdict", F.lit("rejected"))
    )
    return marked.groupBy("c_nationkey", "verdict").agg(F.count("*").alias("places"))


SQL_RANGE_CHECK = """
SELECT c_nationkey, CASE WHEN c_acctbal / 50 BETWEEN -90 AND 90
            AND c_acctbal / 25 BETWEEN -180 AND 180 THEN 'valid' ELSE 'rejected' END AS verdict,
       count(*) AS places
FROM customer GROUP BY 1, 2"""

PART_RULES = {
    "p_name": ("STRING", "REQUIRED"),
    "p_brand": ("INTEGER", "NULLABLE"),
    "p_size": ("FLOAT", "NULLABLE"),
    "p_type": ("RECORD", "NULLABLE"),
    "p_tags": ("STRING", "REPEATED"),
    "p_owner": ("STRING", "REQUIRED"),
}


def validate_records(spark: SparkSession, folder: str) -> DataFrame:
    small = F.col("p_size") <= 10
    records = table(spark, folder, "part").select(
        "p_partkey",
        F.when(~small, F.col("p_name")).otherwise("").alias("p_name"),
        F.when(small, F.regexp_extract("p_brand", "([0-9]+)$", 1))
        .otherwise(F.col("p_brand"))
        .alias("p_brand"),
        F.col("p_size").cast("string").alias("p_size"),
        F.when(F.col("p_type") == "PROMO", F.col("p_type")).alias("p_type"),
        F.split("p_name", " ").alias("p_tags"),
    )
    broken = validate.violations(records, PART_RULES)
    return records.select("p_partkey", F.array_join(broken, "; ").alias("violations"))


SQL_VALIDATE_RECORDS = """
SELECT p_partkey, concat_ws('; ',
       CASE WHEN p_size <= 10 THEN 'p_name: missing' ELSE 'p_brand: not INTEGER' END,
       CASE WHEN p_type = 'PROMO' THEN 'p_type: not RECORD' END,
       'p_owner: missing') AS violations
FROM part"""


NESTED_RULES = {
    "maker": (
        "RECORD",
        "REQUIRED",
        {"name": ("STRING", "REQUIRED"), "code": ("INTEGER", "NULLABLE"), "owner": ("STRING", "REQUIRED")},
    ),
    "sizes": ("INTEGER", "REPEATED"),
    "variants": ("RECORD", "REPEATED", {"name": ("STRING", "REQUIRED"), "size": ("FLOAT", "NULLABLE")}),
}


def validate_nested(spark: SparkSession, folder: str) -> DataFrame:
    """Rules that reach into records, elements of arrays, and records in arrays."""
    size, even = F.col("p_size").cast("string"), F.col("p_size") % 2 == 0
    records = table(spark, folder, "part").select(
        "p_partkey",
        F.struct(F.when(F.col("p_size") > 10, F.col("p_name")).alias("name"), F.col("p_brand").alias("code")).alias("maker"),
        F.array(size, F.col("p_type"), F.when(~even, size)).alias("sizes"),
        F.array(
            F.struct(F.col("p_name").alias("name"), size.alias("size")),
            F.struct(F.when(even, F.col("p_name")).alias("name"), F.col("p_type").alias("size")),
        ).alias("variants"),
    )
    broken = validate.violations(records, NESTED_RULES)
    return records.select("p_partkey", F.array_join(broken, "; ").alias("violations"))


SQL_VALIDATE_NESTED = """
SELECT p_partkey, concat_ws('; ',
       CASE WHEN p_size <= 10 THEN 'maker.name: missing' END, 'maker.code: not INTEGER', 'maker.owner: missing',
       'sizes[1]: not INTEGER', CASE WHEN p_size % 2 = 0 THEN 'sizes[2]: missing' END,
       CASE WHEN p_size % 2 = 1 THEN 'variants[1].name: missing' END, 'variants[1].size: not FLOAT') AS violations
FROM part"""


def dedup_keep_first(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").withColumn(
        "p_name",
        F.when(F.col("p_size") > 25, F.upper("p_name")).otherwise(F.col("p_name")),
    )
    return dedup.keep_first(parts, [F.lower("p_name")], [F.col("p_partkey")])


SQL_DEDUP_KEEP_FIRST = """
SELECT p_partkey, CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END AS p_name, p_brand,
       p_type, p_size, p_retailprice
FROM part QUALIFY row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) = 1"""

WORD_CLASSES = (
    ("ring", ("ring", "bolt")),
    ("gear", ("gear", "GEAR", "anvil")),
    ("colour", ("red", "blue", "green")),
)


def keyword_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Part names by the given rules, whole document texts by the attraction rules."""
    parts = table(spark, folder, "part").select(
        F.lit("part").alias("origin"), keyword_class(F.col("p_name"), WORD_CLASSES, "other").alias("class")
    )
    texts = table(spark, folder, "documents").select(
        F.lit("document").alias("origin"), keyword_class(F.col("text")).alias("class")
    )
    return parts.unionByName(texts).groupBy("origin", "class").agg(F.count("*").alias("rows"))


def _sql_class(text: str, classes, default: str) -> str:
    whens = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({text}), '{k}')" for k in keys) + f" THEN '{label}'"
        for label, keys in classes
    )
    return f"CASE {whens} ELSE '{default}' END"


# Written out here and not taken from the library, so that the two can disagree.
SQL_ATTRACTIONS = _sql_class(
    "text",
    (
        ("museum", ("museum", "gallery", "exhibition")),
        ("palace", ("palace", "castle", "mansion", "estate")),
        ("park", ("park", "garden", "botanical")),
        ("religious", ("cathedral", "church", "temple", "mosque", "shrine", "chapel")),
        ("monument", ("monument", "memorial", "statue")),
        ("building", ("tower", "skyscraper", "building", "center", "centre")),
        ("square", ("square", "plaza", "piazza")),
        ("theatre", ("theater", "theatre", "opera")),
        ("bridge", ("bridge", "tunnel")),
        ("zoo", ("zoo", "aquarium")),
        ("beach", ("beach", "coast", "shore")),
        ("market", ("market", "bazaar", "shopping")),
    ),
    "landmark",
)
SQL_KEYWORD_CLASS = f"""
SELECT origin, class, count(*) AS rows FROM (
    SELECT 'part' AS origin, {_sql_class("p_name", WORD_CLASSES, "other")} AS class FROM part
    UNION ALL SELECT 'document', {SQL_ATTRACTIONS} FROM documents)
GROUP BY 1, 2"""


def names_and_descriptions(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of every document as a list entry: its name, and what is left of it."""
    lines = spread(table(spark, folder, "documents"), cores(spark)).select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    )
    text = parse.strip(F.col("line"))
    named = lines.select(
        "doc_id", "line_no", "line", parse.drop_citations(name_from_text(text)).alias("name")
    )
    return named.select(
        "doc_id",
        "line_no",
        "name",
        description_from_text(F.col("line"), F.col("name")).alias("description"),
    )


# Blanks in the texts are spaces and line ends only.
SQL_NAMES = r"""
WITH docs AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, CAST(unnest(range(len(parts))) AS INTEGER) AS line_no, unnest(parts) AS line FROM docs),
texts AS (SELECT *, trim(line, WS) AS t FROM lines),
words AS (SELECT *, list_filter(regexp_split_to_array(t, '[[:space:]]+'), lambda w: w <> '') AS ws,
                 instr(t, ':') AS colon, instr(t, ' - ') AS dash FROM texts),
names AS (SELECT doc_id, line_no, line, regexp_replace(
    CASE WHEN colon > 1 THEN trim(substr(t, 1, colon - 1), WS)
         WHEN dash > 1 THEN trim(substr(t, 1, dash - 1), WS)
         WHEN len(ws) <= 5 THEN t
         ELSE array_to_string(ws[1:least(5, greatest(3, len(ws) // 3))], ' ') END,
    '\[[0-9]+\]', '', 'g') AS name FROM words),
cut AS (SELECT *, instr(line, name) AS p FROM names)
SELECT doc_id, line_no, name, ltrim(regexp_replace(trim(
    CASE WHEN p > 0 THEN substr(line, 1, p - 1) || substr(line, p + length(name)) ELSE line END, WS),
    '\[[0-9]+\]', '', 'g'), ':-–— ') AS description
FROM cut""".replace("WS", "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)")

QUERIES = {
    "clean_currency": clean_currency,
    "coerce_number": coerce_number,
    "parse_dates": parse_dates,
    "clean_trips": cleaned_trips,
    "to_warehouse": warehouse_trips,
    "trip_costs": trip_costs,
    "fill_defaults": fill_defaults,
    "range_check": range_check,
    "validate_records": validate_records,
    "validate_nested": validate_nested,
    "dedup_keep_first": dedup_keep_first,
    "keyword_class": keyword_classes,
    "name_and_description": names_and_descriptions,
}
ORACLES = {
    "clean_currency": SQL_CLEAN_CURRENCY,
    "coerce_number": SQL_COERCE_NUMBER,
    "parse_dates": SQL_PARSE_DATES,
    "clean_trips": SQL_CLEAN_TRIPS,
    "to_warehouse": SQL_TO_WAREHOUSE,
    "trip_costs": SQL_TRIP_COSTS,
    "fill_defaults": SQL_FILL_DEFAULTS,
    "range_check": SQL_RANGE_CHECK,
    "validate_records": SQL_VALIDATE_RECORDS,
    "validate_nested": SQL_VALIDATE_NESTED,
    "dedup_keep_first": SQL_DEDUP_KEEP_FIRST,
    "keyword_class": SQL_KEYWORD_CLASS,
    "name_and_description": SQL_NAMES,
}
