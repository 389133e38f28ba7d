"""Profiles of the given tables, and rows synthesised from them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.functions import parse
from wayloom.operators import profile, synth
from wayloom.sources import reference_lists as lists
from wayloom.suite import inputs
from wayloom.suite.inputs import table

AS_OF = dt.date(2024, 1, 5)
SEED = 7


def profile_distinct(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "part").withColumn(
        "p_name", F.when(F.col("p_size") > 5, F.col("p_name"))
    )
    return profile.distinct_values(names, "p_name")


SQL_DISTINCT = "SELECT DISTINCT p_name AS value FROM part WHERE p_size > 5"


def profile_frequency(spark: SparkSession, folder: str) -> DataFrame:
    counted = profile.frequencies(table(spark, folder, "lineitem"), "l_quantity")
    return counted.withColumn("probability", F.round("probability", 9))


SQL_FREQUENCY = """
SELECT l_quantity AS value, count(*) AS count,
       round(count(*) / (SELECT count(l_quantity) FROM lineitem), 9) AS probability
FROM lineitem GROUP BY 1"""


def profile_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes in ten bins of five from 0; the largest size, 50, closes the last bin."""
    bins = profile.histogram(table(spark, folder, "part"), "p_size", 0, 5, 10)
    return bins.select("bin", "lo", "hi", "count", F.round("probability", 9).alias("probability"))


SQL_HISTOGRAM = """
WITH b AS (SELECT CASE WHEN p_size = 50 THEN 9 ELSE p_size // 5 END AS bin
           FROM part WHERE p_size BETWEEN 0 AND 50),
t AS (SELECT CAST(range AS INTEGER) AS bin FROM range(10))
SELECT t.bin, t.bin * 5 AS lo, t.bin * 5 + 5 AS hi, count(b.bin) AS count,
       round(count(b.bin) / (SELECT count(*) FROM b), 9) AS probability
FROM t LEFT JOIN b ON t.bin = b.bin GROUP BY t.bin"""


def profile_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    """Minimum, quartiles and maximum, exact, of prices and discounts."""
    marks = (0.0, 0.25, 0.5, 0.75, 1.0)
    rows = []
    for name, column in (("orders", "o_totalprice"), ("lineitem", "l_discount")):
        found = profile.quantiles(table(spark, folder, name), column, marks)
        rows += [(column, p, round(v, 6)) for p, v in zip(marks, found)]
    return spark.createDataFrame(rows, "column string, p double, value double")


# A quantile needs a constant in SQL, so each mark is written out.
SQL_QUANTILES = " UNION ALL ".join(
    f"""SELECT '{column}' AS "column", CAST({p} AS DOUBLE) AS p,
        round(quantile_cont({column}, {p}), 6) AS value FROM {name}"""
    for name, column in (("orders", "o_totalprice"), ("lineitem", "l_discount"))
    for p in (0.0, 0.25, 0.5, 0.75, 1.0)
)


def profile_styles(spark: SparkSession, folder: str) -> DataFrame:
    texts = inputs.raw_trips(spark, folder)
    counted = profile.style_frequencies(texts, ("Accommodation cost", "Transportation cost"))
    return counted.withColumn("probability", F.round("probability", 9))


SQL_STYLES = f"""
WITH texts AS (
    SELECT {inputs.sql_amount_text("o_totalprice")} AS t {inputs.SQL_TRIPS_FROM}
    UNION ALL SELECT {inputs.sql_amount_text("c_acctbal")} {inputs.SQL_TRIPS_FROM}),
styles AS (SELECT CASE WHEN contains(t, '$') AND contains(t, ',') THEN '$NUM_WITH_COMMAS'
    WHEN contains(t, '$') THEN '$NUM' WHEN contains(t, 'USD') THEN 'NUM_USD' ELSE 'NUM' END AS style
    FROM texts WHERE t IS NOT NULL)
SELECT style, count(*) AS count, round(count(*) / (SELECT count(*) FROM styles), 9) AS probability
FROM styles GROUP BY 1"""


def next_key(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    empty = orders.where(F.col("o_orderkey").isNull())
    return (
        profile.next_key(orders, "o_orderkey")
        .withColumn("source", F.lit("orders"))
        .unionByName(profile.next_key(empty, "o_orderkey").withColumn("source", F.lit("none")))
    )


SQL_NEXT_KEY = """
SELECT 'orders' AS source, max(o_orderkey) + 1 AS next_key FROM orders
UNION ALL SELECT 'none', CAST(1000 AS BIGINT)"""


def value_index(spark: SparkSession, folder: str) -> DataFrame:
    return profile.indexed_values(profile.distinct_values(table(spark, folder, "customer"), "c_name"))


SQL_VALUE_INDEX = """
SELECT value, row_number() OVER (ORDER BY md5(value), value) - 1 AS index
FROM (SELECT DISTINCT c_name AS value FROM customer)"""


def rounded_tens(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        "o_orderkey",
        parse.round_to_tens(F.floor("o_totalprice").cast("double")).alias("tens"),
    )


SQL_ROUNDED_TENS = """
SELECT o_orderkey, round_even(floor(o_totalprice) / 10, 0) * 10 AS tens FROM orders"""


# --- synthesis --------------------------------------------------------------------------

# As many rows as there are orders.


def _batch_size(spark: SparkSession, folder: str) -> int:
    return table(spark, folder, "orders").count()


def synth_trips(spark: SparkSession, folder: str) -> DataFrame:
    profiled = synth.profile_trips(inputs.raw_trips(spark, folder), parse_costs=True)
    n = _batch_size(spark, folder)
    rows = synth.synthesize(spark, profiled, AS_OF, n, SEED)
    return _plain(rows.withColumns({c: F.round(c, 2) for c in synth.COST_COLUMNS}))


def synth_raw(spark: SparkSession, folder: str) -> DataFrame:
    profiled = synth.profile_trips(inputs.raw_trips(spark, folder))
    return _plain(synth.synthesize_raw(spark, profiled, AS_OF, _batch_size(spark, folder), SEED))


def synth_tiered(spark: SparkSession, folder: str) -> DataFrame:
    first = profile.next_key(table(spark, folder, "orders"), "o_orderkey").first()["next_key"]
    return _plain(synth.synthesize_tiered(spark, AS_OF, first, _batch_size(spark, folder), SEED))


def _plain(rows: DataFrame) -> DataFrame:
    return rows.toDF(*[c.replace(" ", "_").replace("(", "").replace(")", "") for c in rows.columns])


def _u(field: str) -> str:
    return (
        f"(CAST(('0x' || substr(md5(concat_ws('|', CAST(id AS VARCHAR), '{field}', '{SEED}')), 1, 12))"
        " AS BIGINT) / 281474976710656.0::DOUBLE)"
    )


def _int(u: str, low: int, high: int) -> str:
    return f"CAST(floor({u} * {high - low + 1}) + {low} AS INTEGER)"


SQL_START_DAY = f"""CASE WHEN {_u("is_past")} < 0.3
    THEN DATE '2024-01-05' - {_int(_u("days_back"), 1, 180)}
    ELSE DATE '2024-01-05' + {_int(_u("days_ahead"), 1, 180)} END"""
SQL_GENDER = f"CASE WHEN {_u('gender')} < 0.5 THEN 'Male' ELSE 'Female' END"


def _sql_value(column: str, sql: str) -> str:
    """Lookup table of one sampled column, by dense index."""
    return f"""(SELECT v, row_number() OVER (ORDER BY md5(v), v) - 1 AS idx, count(*) OVER () AS k
        FROM (SELECT DISTINCT {sql} AS v {inputs.SQL_TRIPS_FROM}) WHERE v IS NOT NULL)"""


_SAMPLED = {
    "Destination": "n_name",
    "Traveler name": "c_name",
    "Traveler nationality": "nullif(c_mktsegment, 'BUILDING')",
    "Accommodation type": "nullif(o_orderpriority, '5-LOW')",
    "Transportation type": "c_mktsegment",
}


def _sql_profiled(durations: str, costs: str) -> str:
    """Rows drawn from the profile; ``durations`` and the cost columns differ by variant."""
    lookups = ", ".join(
        f"t{i} AS {_sql_value(name, sql)}" for i, (name, sql) in enumerate(_SAMPLED.items())
    )
    joins = " ".join(
        f"JOIN t{i} ON t{i}.idx = CAST(floor({_u(name)} * t{i}.k) AS BIGINT)"
        for i, name in enumerate(_SAMPLED)
    )
    return f"""
WITH ids AS (SELECT range AS id FROM range(
        (SELECT max(o_orderkey) + 1 FROM orders),
        (SELECT max(o_orderkey) + 1 + count(*) FROM orders))),
dur AS (SELECT v, sum(c) OVER w - c AS lo, sum(c) OVER w AS hi, sum(c) OVER () AS n
        FROM (SELECT {durations} AS v, count(*) AS c {inputs.SQL_TRIPS_FROM} GROUP BY 1)
        WHERE v IS NOT NULL WINDOW w AS (ORDER BY md5(CAST(v AS VARCHAR)), v ROWS UNBOUNDED PRECEDING)),
{lookups},
ages AS (SELECT CASE WHEN a = 68 THEN 63 ELSE 18 + 5 * ((a - 18) // 5) END AS lo, count(*) AS c
         FROM (SELECT {inputs.SQL_AGE} AS a {inputs.SQL_TRIPS_FROM})
         WHERE a BETWEEN 18 AND 68 GROUP BY 1),
bins AS (SELECT lo, sum(c) OVER (ORDER BY lo) / sum(c) OVER () AS upto FROM ages)
{costs}
SELECT id AS Trip_ID, t0.v AS Destination, strftime({SQL_START_DAY}, '%-m/%-d/%Y') AS Start_date,
       strftime({SQL_START_DAY} + dur.v, '%-m/%-d/%Y') AS End_date, dur.v AS Duration_days,
       t1.v AS Traveler_name,
       (SELECT min(lo) FROM bins WHERE upto > {_u("age_bin")} OR upto = 1)
            + {_int(_u("age_in_bin"), 0, 4)} AS Traveler_age,
       {SQL_GENDER} AS Traveler_gender, t2.v AS Traveler_nationality,
       t3.v AS Accommodation_type, COST(Accommodation cost) AS Accommodation_cost,
       t4.v AS Transportation_type, COST(Transportation cost) AS Transportation_cost
FROM ids JOIN dur ON floor({_u("duration")} * dur.n) >= lo AND floor({_u("duration")} * dur.n) < hi
{joins} JOINCOST"""


def _banded(name: str, alias: str) -> str:
    band, inside = _u(f"{name} band"), _u(f"{name} in band")
    cases = " ".join(
        f"WHEN {band} < {upto} THEN {alias}.q{i} + ({alias}.q{i + 1} - {alias}.q{i}) * {inside}"
        for i, upto in enumerate(("0.2::DOUBLE", "0.5::DOUBLE", "0.8::DOUBLE", "2"))
    )
    return f"round(round_even(CASE {cases} END / 10, 0) * 10, 2)"


def _marks(sql: str) -> str:
    q = ", ".join(f"quantile_cont(c, {p}) AS q{i}" for i, p in enumerate((0.0, 0.25, 0.5, 0.75, 1.0)))
    return f"(SELECT {q} FROM (SELECT {sql} AS c {inputs.SQL_TRIPS_FROM}))"


SQL_SYNTH_TRIPS = (
    _sql_profiled(
        inputs.SQL_DURATION,
        f""", acc AS {_marks(inputs.sql_amount("o_totalprice"))},
        tra AS {_marks(inputs.sql_amount("c_acctbal"))}""",
    )
    .replace("COST(Accommodation cost)", _banded("Accommodation cost", "acc"))
    .replace("COST(Transportation cost)", _banded("Transportation cost", "tra"))
    .replace("JOINCOST", "CROSS JOIN acc CROSS JOIN tra")
)


def _styled_raw(name: str) -> str:
    amount = f"(round_even(({_u(name)} * 2950.0::DOUBLE + 50) / 10, 0) * 10)"
    style = f"(SELECT min_by(style, style) FROM sty WHERE upto > {_u(f'{name} style')} OR upto = 1)"
    return f"""CASE {style} WHEN '$NUM_WITH_COMMAS' THEN '$' || format('{{:,.1f}}', {amount})
        WHEN '$NUM' THEN '$' || CAST({amount} AS VARCHAR)
        WHEN 'NUM_USD' THEN CAST({amount} AS VARCHAR) || ' USD' ELSE CAST({amount} AS VARCHAR) END"""


SQL_SYNTH_RAW = (
    _sql_profiled(
        "CASE WHEN o_orderstatus = 'F' THEN c_nationkey END",
        f""", sty AS (SELECT style, sum(count) OVER (ORDER BY style) / sum(count) OVER () AS upto
        FROM ({SQL_STYLES}))""",
    )
    .replace("COST(Accommodation cost)", _styled_raw("Accommodation cost"))
    .replace("COST(Transportation cost)", _styled_raw("Transportation cost"))
    .replace("JOINCOST", "")
)



def _list(name: str, values) -> str:
    quoted = ", ".join(f"'{v}'" for v in values)
    return f"([{quoted}])[CAST(floor({_u(name)} * {len(values)}) AS INTEGER) + 1]"


def _tiered(name: str, tiers) -> str:
    tier, style = _u(f"{name} tier"), _u(f"{name} style")
    cases = " ".join(
        f"WHEN {tier} < {upto} THEN {_int(_u(f'{name} in tier'), low, high)}"
        for upto, low, high in tiers
    )
    amount = f"(CASE {cases} END)"
    return f"""CASE WHEN {style} < 0.3::DOUBLE THEN CAST({amount} AS VARCHAR)
        WHEN {style} < 0.6::DOUBLE THEN '$' || {amount}
        WHEN {style} < 0.8::DOUBLE THEN '$' || format('{{:,}}', {amount}) ELSE {amount} || ' USD' END"""


SQL_SYNTH_TIERED = f"""
WITH ids AS (SELECT range AS id FROM range(
        (SELECT max(o_orderkey) + 1 FROM orders),
        (SELECT max(o_orderkey) + 1 + count(*) FROM orders)))
SELECT id AS Trip_ID, {_list("Destination", lists.TRIP_DESTINATIONS)} AS Destination,
       strftime({SQL_START_DAY}, '%-m/%-d/%Y') AS Start_date,
       strftime({SQL_START_DAY} + {_int(_u("duration"), 3, 14)}, '%-m/%-d/%Y') AS End_date,
       {_int(_u("duration"), 3, 14)} AS Duration_days,
       CASE WHEN {_u("gender")} < 0.5 THEN {_list("given name", lists.MALE_NAMES)}
            ELSE {_list("given name", lists.FEMALE_NAMES)} END
            || ' ' || {_list("family name", lists.FAMILY_NAMES)} AS Traveler_name,
       {_int(_u("age"), 18, 75)} AS Traveler_age, {SQL_GENDER} AS Traveler_gender,
       {_list("Traveler nationality", lists.NATIONALITIES)} AS Traveler_nationality,
       {_list("Accommodation type", lists.ACCOMMODATION_TYPES)} AS Accommodation_type,
       {_tiered("Accommodation cost", (("0.2::DOUBLE", 200, 500), ("0.7::DOUBLE", 500, 1200),
                ("0.9::DOUBLE", 1200, 2000), ("2", 2000, 5000)))} AS Accommodation_cost,
       {_list("Transportation type", lists.TRANSPORTATION_TYPES)} AS Transportation_type,
       {_tiered("Transportation cost", (("0.1::DOUBLE", 50, 200), ("0.4::DOUBLE", 200, 500),
                ("0.9::DOUBLE", 500, 1000), ("2", 1000, 2000)))} AS Transportation_cost
FROM ids"""

QUERIES = {
    "profile_distinct": profile_distinct,
    "profile_frequency": profile_frequency,
    "profile_histogram": profile_histogram,
    "profile_quantiles": profile_quantiles,
    "profile_styles": profile_styles,
    "next_key": next_key,
    "value_index": value_index,
    "rounded_tens": rounded_tens,
    "synth_trips": synth_trips,
    "synth_raw": synth_raw,
    "synth_tiered": synth_tiered,
}
ORACLES = {
    "profile_distinct": SQL_DISTINCT,
    "profile_frequency": SQL_FREQUENCY,
    "profile_histogram": SQL_HISTOGRAM,
    "profile_quantiles": SQL_QUANTILES,
    "profile_styles": SQL_STYLES,
    "next_key": SQL_NEXT_KEY,
    "value_index": SQL_VALUE_INDEX,
    "rounded_tens": SQL_ROUNDED_TENS,
    "synth_trips": SQL_SYNTH_TRIPS,
    "synth_raw": SQL_SYNTH_RAW,
    "synth_tiered": SQL_SYNTH_TIERED,
}
