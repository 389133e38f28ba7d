"""Messy inputs that Spark derives from the given tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.functions.parse import (
    STYLE_DOLLAR,
    STYLE_DOLLAR_COMMAS,
    STYLE_PLAIN,
    STYLE_USD,
    format_currency,
    format_iso_date,
    format_us_date,
)
from wayloom.session import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cores(spark: SparkSession) -> int:
    """The number that the queries give to ``spread``: the given tables are single files of one
    row group, which a scan cannot split."""
    return spark.sparkContext.defaultParallelism


# --- ways to write an amount, by order priority -----------------------------------------


def priority_style() -> Column:
    p = F.col("o_orderpriority")
    return (
        F.when(p == "1-URGENT", STYLE_DOLLAR_COMMAS)
        .when(p == "2-HIGH", STYLE_DOLLAR)
        .when(p == "3-MEDIUM", STYLE_USD)
        .otherwise(STYLE_PLAIN)
    )


def amount_text(amount: str) -> Column:
    """Amount in the priority's style; orders in process with a low priority have a gap."""
    p, pending = F.col("o_orderpriority"), F.col("o_orderstatus") == "P"
    return (
        F.when(pending & (p == "5-LOW"), F.lit(None).cast("string"))
        .when(pending & (p == "4-NOT SPECIFIED"), " ")
        .otherwise(_styled(F.col(amount), priority_style()))
    )


def _styled(amount: Column, style: Column) -> Column:
    return format_currency(amount, style, decimals=2)


def sql_amount_text(amount: str) -> str:
    return f"""CASE
        WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN NULL
        WHEN o_orderstatus = 'P' AND o_orderpriority = '4-NOT SPECIFIED' THEN ' '
        WHEN o_orderpriority = '1-URGENT' THEN '$' || format('{{:,.2f}}', {amount})
        WHEN o_orderpriority = '2-HIGH' THEN '$' || CAST({amount} AS VARCHAR)
        WHEN o_orderpriority = '3-MEDIUM' THEN CAST({amount} AS VARCHAR) || ' USD'
        ELSE CAST({amount} AS VARCHAR) END"""


def sql_amount(amount: str) -> str:
    return f"""CASE WHEN o_orderstatus = 'P' AND o_orderpriority IN ('5-LOW', '4-NOT SPECIFIED')
        THEN NULL ELSE {amount} END"""


# --- orders as raw trips ----------------------------------------------------------------


def raw_trips(spark: SparkSession, folder: str) -> DataFrame:
    """Every order as a trip the way a hand-kept CSV would hold it."""
    orders = spread(table(spark, folder, "orders"), cores(spark))
    customer = table(spark, folder, "customer")
    nation = table(spark, folder, "nation")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(
        nation, customer.c_nationkey == nation.n_nationkey
    )
    day = F.col("o_orderdate").cast("date")
    status, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    segment, stay = F.col("c_mktsegment"), F.col("c_nationkey")
    return joined.select(
        F.col("o_orderkey").cast("string").alias("Trip ID"),
        F.col("n_name").alias("Destination"),
        F.when(p == "1-URGENT", format_iso_date(day))
        .when(p == "2-HIGH", "unknown")
        .otherwise(format_us_date(day))
        .alias("Start date"),
        format_us_date(F.date_add(day, stay)).alias("End date"),
        F.when(status == "F", stay.cast("string"))
        .when(status == "O", F.concat(stay.cast("string"), F.lit("d")))
        .alias("Duration (days)"),
        F.col("c_name").alias("Traveler name"),
        F.when(segment == "FURNITURE", "n/a")
        .otherwise((stay * 2 + 18).cast("string"))
        .alias("Traveler age"),
        F.when(status == "F", "Female").when(status == "O", "Male").alias("Traveler gender"),
        F.nullif(segment, F.lit("BUILDING")).alias("Traveler nationality"),
        F.nullif(p, F.lit("5-LOW")).alias("Accommodation type"),
        amount_text("o_totalprice").alias("Accommodation cost"),
        segment.alias("Transportation type"),
        amount_text("c_acctbal").alias("Transportation cost"),
    )


SQL_TRIPS_FROM = """
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""
SQL_START = """CASE WHEN o_orderpriority = '2-HIGH' THEN NULL ELSE CAST(o_orderdate AS DATE) END"""
SQL_END = "CAST(CAST(o_orderdate AS DATE) + CAST(c_nationkey AS INTEGER) AS DATE)"
SQL_DURATION = "CASE WHEN o_orderstatus = 'F' THEN c_nationkey ELSE 7 END"
SQL_AGE = "CASE WHEN c_mktsegment = 'FURNITURE' THEN NULL ELSE c_nationkey * 2 + 18 END"
SQL_GENDER = "CASE o_orderstatus WHEN 'F' THEN 'Female' WHEN 'O' THEN 'Male' ELSE 'Unknown' END"
SQL_NATIONALITY = "coalesce(nullif(c_mktsegment, 'BUILDING'), 'Unknown')"
SQL_ACCOMMODATION = "coalesce(nullif(o_orderpriority, '5-LOW'), 'Unknown')"
