"""Types that go together, casts that lose nothing, tables that grow wider."""

import datetime as dt
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayloom.operators.lattice import conform, wider, widened
from wayloom.sinks import tables


def kind(text):
    return T.StructType.fromDDL(f"x {text}")["x"].dataType


@pytest.mark.parametrize(
    "one, other, expected",
    [
        ("tinyint", "int", "int"),
        ("bigint", "int", "bigint"),
        ("bigint", "double", "double"),
        ("int", "float", "double"),
        ("smallint", "float", "float"),
        ("int", "decimal(5,2)", "decimal(12,2)"),
        ("decimal(38,0)", "decimal(10,10)", "double"),
        ("date", "timestamp", "timestamp"),
        ("timestamp_ntz", "date", "timestamp_ntz"),
        ("timestamp_ntz", "timestamp", None),
        ("void", "string", "string"),
        ("string", "int", None),
        ("boolean", "int", None),
        ("date", "bigint", None),
        ("array<int>", "array<double>", "array<double>"),
        ("array<int>", "array<string>", None),
        ("map<string,int>", "map<string,bigint>", "map<string,bigint>"),
        ("struct<a:int,b:string>", "struct<B:string,a:double,c:date>", "struct<a:double,b:string,c:date>"),
        ("struct<a:int>", "int", None),
    ],
)
def test_wider(spark, one, other, expected):
    for a, b in ((one, other), (other, one)):
        found = wider(kind(a), kind(b))
        if expected is None or not expected.startswith("struct"):
            assert (found and found.simpleString()) == expected
    assert (wider(kind(one), kind(other)) is None) == (expected is None)
    if expected:
        assert wider(kind(one), kind(other)).simpleString() == expected


def conformed(spark, value, found, wanted):
    frame = spark.createDataFrame([(value,)], f"x {found}")
    return conform(frame, T.StructType.fromDDL(f"x {wanted}")).first()["x"]


@pytest.mark.parametrize(
    "value, found, wanted, expected",
    [
        (2.0, "double", "int", 2),
        (7, "bigint", "tinyint", 7),
        ("12", "string", "bigint", 12),
        (5, "int", "string", "5"),
        (None, "string", "int", None),
        (float("nan"), "double", "float", float("nan")),
        (2**53, "bigint", "double", float(2**53)),
        (Decimal("1.50"), "decimal(9,2)", "decimal(5,1)", Decimal("1.5")),
        (dt.datetime(2024, 1, 5), "timestamp", "date", dt.date(2024, 1, 5)),
        ([1, None], "array<int>", "array<double>", [1.0, None]),
        (({"a": 1},), "struct<m:map<string,int>>", "struct<m:map<string,bigint>,n:date>", ({"a": 1}, None)),
    ],
)
def test_values_that_fit(spark, value, found, wanted, expected):
    got = conformed(spark, value, found, wanted)
    assert got == expected or (got != got and expected != expected)


@pytest.mark.parametrize(
    "value, found, wanted",
    [
        (2.5, "double", "int"),
        (300, "int", "tinyint"),
        (1e300, "double", "bigint"),
        (float("nan"), "double", "int"),
        ("2.5", "string", "int"),
        ("soon", "string", "date"),
        (2**53 + 1, "bigint", "double"),
        (2**24 + 1, "int", "float"),
        (Decimal("1.55"), "decimal(9,2)", "decimal(5,1)"),
        (dt.datetime(2024, 1, 5, 1), "timestamp", "date"),
        ([2**53 + 1], "array<bigint>", "array<double>"),
    ],
)
def test_values_that_do_not_fit_fail_by_name(spark, value, found, wanted):
    with pytest.raises(Exception, match=r"column x(\[\])?: .* would change"):
        conformed(spark, value, found, wanted)


def test_nested_types_that_do_not_go_together(spark):
    with pytest.raises(TypeError, match="column x: array<string> into array<int>"):
        conformed(spark, ["1"], "array<string>", "array<int>")
    with pytest.raises(TypeError, match="column b: string into int; column c: int into string"):
        widened(T.StructType.fromDDL("a int, b int, c string"), T.StructType.fromDDL("A bigint, b string, C int"))


def rows(spark, name):
    return sorted(map(tuple, spark.table(name).collect()), key=str)


@pytest.fixture
def name(spark):
    tables.ensure_database(spark, "lattice")
    found = f"lattice.t_{os.urandom(4).hex()}"
    yield found
    spark.sql(f"DROP TABLE IF EXISTS {found}")


def test_a_table_grows_wider(spark, name):
    """Managed first, then beside its former place; appends and upserts go on as before."""
    assert tables.append_autodetect(spark.createDataFrame([(1, 1)], "id int, v int"), name).ok
    first = tables.table_location(spark, name)
    assert tables.append_autodetect(spark.createDataFrame([(2, 2.5)], "id int, v double"), name).ok
    assert spark.table(name).schema.simpleString() == "struct<id:int,v:double>"
    assert rows(spark, name) == [(1, 1.0), (2, 2.5)]
    wide = spark.createDataFrame([(3 * 10**9, 3, dt.date(2024, 1, 5))], "ID bigint, v int, day date")
    assert tables.append_autodetect(wide, name).rows_total == 3
    later = spark.createDataFrame([(4, dt.datetime(2024, 1, 5, 6))], "id int, day timestamp")
    assert tables.append_autodetect(later, name).ok
    assert spark.table(name).schema.simpleString() == "struct<id:bigint,v:double,day:timestamp>"
    assert [r[:2] for r in rows(spark, name)] == [(1, 1.0), (2, 2.5), (3 * 10**9, 3.0), (4, None)]
    place = tables.table_location(spark, name).removeprefix("file:")
    around = [f for f in os.listdir(os.path.dirname(place)) if f.startswith(name.split(".")[1])]
    assert around == [os.path.basename(place)] and place != first.removeprefix("file:")
    merged = tables.merge_into(spark.createDataFrame([(1, 9)], "id int, v int"), name, spark.table(name).schema, ["id"])
    assert merged.updated == 1 and (1, 9.0, None) in rows(spark, name)
    assert spark.sql("SHOW TABLES IN lattice").where(F.col("tableName").contains("__")).isEmpty()


def test_what_does_not_go_together_writes_nothing(spark, name):
    tables.append_autodetect(spark.createDataFrame([(1, 2**53 + 1)], "id int, v bigint"), name)
    before = rows(spark, name), spark.table(name).schema, tables.table_location(spark, name)
    text = tables.append_autodetect(spark.createDataFrame([(2, "two")], "id int, v string"), name)
    assert text.status == "failed" and "column v: string into bigint" in text.error
    loss = tables.append_autodetect(spark.createDataFrame([(2, 0.5)], "id int, v double"), name)
    assert loss.status == "failed" and "would change 9007199254740993" in loss.error
    fixed = tables.append(spark.createDataFrame([(2, 2.5)], "id int, v double"), name, before[1])
    assert fixed.status == "failed" and "column v: double to bigint would change 2.5" in fixed.error
    whole = tables.truncate_and_load(spark.createDataFrame([(2, 2.5)], "id int, v double"), name, before[1])
    merge = tables.merge_into(spark.createDataFrame([(1, 2.5)], "id int, v double"), name, before[1], ["id"])
    assert whole.status == merge.status == "failed"
    assert (rows(spark, name), spark.table(name).schema, tables.table_location(spark, name)) == before
    assert spark.sql("SHOW TABLES IN lattice").where(F.col("tableName").contains("__")).isEmpty()
