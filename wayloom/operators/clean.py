"""Column and row clean-up shared by the flows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rename_columns(table: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename by map; names that are not there are ignored."""
    return table.withColumnsRenamed(dict(names))


def drop_columns(table: DataFrame, *names: str) -> DataFrame:
    """Drop columns; names that are not there are ignored."""
    return table.drop(*names)


def drop_empty_rows(table: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Remove rows in which every value (of ``columns``, if given) is missing."""
    return table.na.drop("all", subset=list(columns) if columns else None)


def fill_constants(table: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Replace missing values by one constant per column."""
    return table.na.fill(dict(defaults))


def or_default(value: Column, default: object) -> Column:
    """``value`` or the default where it is missing."""
    return F.coalesce(value, F.lit(default))


def split_by(table: DataFrame, passes: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass and rows that do not; an undecided test counts as not passed."""
    verdict = F.coalesce(passes, F.lit(False))
    return table.where(verdict), table.where(~verdict)


# Limits of a location and of the number of forecast days.
LATITUDE_RANGE = (-90.0, 90.0)
LONGITUDE_RANGE = (-180.0, 180.0)
FORECAST_DAYS_RANGE = (1, 7)


def in_range(value: Column, limits: tuple[float, float]) -> Column:
    return value.between(F.lit(limits[0]), F.lit(limits[1]))


def valid_location(latitude: Column, longitude: Column) -> Column:
    return in_range(latitude, LATITUDE_RANGE) & in_range(longitude, LONGITUDE_RANGE)
