"""Validation of records against declared field rules."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayloom.functions.parse import parse_integer, parse_number

_SCALARS = {
    "INTEGER": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "FLOAT": (T.NumericType,),
    "BOOLEAN": (T.BooleanType,),
    "DATE": (T.DateType,),
    "TIMESTAMP": (T.TimestampType, T.TimestampNTZType, T.DateType),
}


def violations(table: DataFrame, rules: Mapping[str, tuple]) -> Column:
    """Array with one message per broken rule, empty for a valid record.

    A rule is ``field: (type, mode)``. REQUIRED needs a value (text must not be empty), REPEATED an
    array, and any value that is present must be of the type or castable to it. A field the table
    lacks counts as missing in every row.

    The elements of a REPEATED field are looked at one by one, if their column can be of the type at
    all, and must not be NULL. A RECORD may
    have rules of its own, ``field: ("RECORD", mode, rules)``, for each record that is there.
    Messages begin with the path, counted from 0: ``attractions[3].name: missing``.
    """
    found = {field.name: (F.col(f"`{field.name}`"), field.dataType) for field in table.schema.fields}
    return _messages(found, rules, F.lit(""))


def _messages(found: Mapping[str, tuple[Column, T.DataType]], rules: Mapping[str, tuple], above: Column) -> Column:
    """What is wrong with the fields of one record whose path is ``above``."""
    parts = [F.array().cast("array<string>")]
    for field, rule in rules.items():
        kind, mode = rule[:2]
        nested = rule[2] if len(rule) > 2 else {}
        path = F.concat(above, F.lit(field))
        if field not in found:
            if mode == "REQUIRED":
                parts.append(F.array(F.concat(path, F.lit(": missing"))))
            continue
        value, held = found[field]
        if mode == "REPEATED":
            parts.append(_repeated(value, held, kind, nested, path))
            continue
        element = held.elementType if isinstance(held, T.ArrayType) else held
        wrong = _wrong_type(value, element, kind)
        if isinstance(held, T.ArrayType):
            wrong = value.isNotNull() & F.exists(value, lambda x: _wrong_type(x, element, kind))
        checks = [F.when(wrong, F.concat(path, F.lit(f": not {kind}")))]
        if mode == "REQUIRED":
            checks.insert(0, F.when(_absent(value, held), F.concat(path, F.lit(": missing"))))
        parts.append(F.array_compact(F.array(*checks)))
        parts.append(_inside(value, held, kind, nested, path))
    return F.concat(*parts)


def _absent(value: Column, held: T.DataType) -> Column:
    return value.isNull() | (value == "") if isinstance(held, T.StringType) else value.isNull()


def _repeated(value: Column, held: T.DataType, kind: str, nested: Mapping[str, tuple], path: Column) -> Column:
    nothing = F.array().cast("array<string>")
    if not isinstance(held, T.ArrayType):
        return F.when(value.isNotNull(), F.array(F.concat(path, F.lit(": not repeated")))).otherwise(nothing)
    if not _can_hold(held.elementType, kind):
        return F.when(value.isNotNull(), F.array(F.concat(path, F.lit(f": not {kind}")))).otherwise(nothing)

    def of_element(x: Column, at: Column) -> Column:
        here = F.concat(path, F.lit("["), at.cast("string"), F.lit("]"))
        own = F.when(x.isNull(), F.concat(here, F.lit(": missing"))).when(
            _wrong_type(x, held.elementType, kind), F.concat(here, F.lit(f": not {kind}"))
        )
        return F.concat(F.array_compact(F.array(own)), _inside(x, held.elementType, kind, nested, here))

    return F.coalesce(F.flatten(F.transform(value, of_element)), nothing)


def _inside(value: Column, held: T.DataType, kind: str, nested: Mapping[str, tuple], path: Column) -> Column:
    """What is wrong inside a record, if it is one and is there."""
    nothing = F.array().cast("array<string>")
    if not (nested and kind == "RECORD" and isinstance(held, T.StructType)):
        return nothing
    fields = {f.name: (value.getField(f.name), f.dataType) for f in held.fields}
    return F.when(value.isNotNull(), _messages(fields, nested, F.concat(path, F.lit(".")))).otherwise(nothing)


def _can_hold(found: T.DataType, kind: str) -> bool:
    """Whether values of a column's type can be of the kind at all; text can be of any scalar one."""
    if kind == "RECORD":
        return isinstance(found, (T.StructType, T.MapType))
    return isinstance(found, T.StringType) or (kind != "STRING" and isinstance(found, _SCALARS[kind]))


def _wrong_type(value: Column, found: T.DataType, kind: str) -> Column:
    if not _can_hold(found, kind):
        return value.isNotNull()
    if kind in ("RECORD", "STRING") or isinstance(found, _SCALARS[kind]):
        return F.lit(False)
    parsed = {
        "INTEGER": lambda: parse_integer(value),
        "FLOAT": lambda: parse_number(value),
        "BOOLEAN": lambda: value.try_cast("boolean"),
        "DATE": lambda: value.try_cast("date"),
        "TIMESTAMP": lambda: value.try_cast("timestamp"),
    }[kind]()
    return value.isNotNull() & parsed.isNull()


def split_valid(
    table: DataFrame, rules: Mapping[str, tuple]
) -> tuple[DataFrame, DataFrame]:
    """Valid records as they came, and rejected ones with their ``violations``."""
    checked = table.withColumn("violations", violations(table, rules))
    return (
        checked.where(F.size("violations") == 0).drop("violations"),
        checked.where(F.size("violations") > 0),
    )
