"""What several of the operators need: free column names, empty texts, staged results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/pages.parquet")


def whole(text: str) -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def free(table: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of the table has them, whatever its case."""
    taken, found = {c.lower() for c in table.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
