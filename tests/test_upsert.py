import os

import pytest
from pyspark.sql import functions as F

from wayloom.operators import upsert
from wayloom.operators.dedup import keep_first
from wayloom.schemas import DESTINATIONS_TABLE
from wayloom.session import listing, shared_dir
from wayloom.sinks import tables

SCHEMA = "k string, a int, b int"


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_change_tests(spark):
    target = spark.createDataFrame(
        [("same", 1, 1), ("new", 1, None), ("gone", 1, 2), ("both", 1, None), ("other", 1, 1)], SCHEMA
    )
    source = spark.createDataFrame(
        [("same", 1, 1), ("new", 1, 5), ("gone", 1, None), ("both", 2, 6), ("extra", 9, None)], SCHEMA
    )
    ansi = upsert.merge(target, source, ["k"], with_status=True)
    assert rows(ansi) == sorted(
        [
            ("same", 1, 1, "kept"),
            ("new", 1, None, "kept"),
            ("gone", 1, 2, "kept"),
            ("both", 2, 6, "updated"),
            ("other", 1, 1, "kept"),
            ("extra", 9, None, "inserted"),
        ],
        key=str,
    )
    safe = upsert.merge(target, source, ["k"], change_test="null_safe", with_status=True)
    assert {r["k"]: r[upsert.STATUS] for r in safe.collect()} == {
        "same": "kept",
        "new": "updated",
        "gone": "updated",
        "both": "updated",
        "other": "kept",
        "extra": "inserted",
    }
    ignoring = upsert.merge(target, source, ["k"], ignore=["a"], with_status=True)
    assert {r["k"] for r in ignoring.where("_merge_status = 'updated'").collect()} == set()


def test_null_keys_and_idempotence(spark):
    target = spark.createDataFrame([("x", 1, 1), (None, 2, 2)], SCHEMA)
    source = spark.createDataFrame([("x", 5, 5), (None, 2, 2), ("y", 1, 1)], SCHEMA)
    once = upsert.merge(target, source, ["k"])
    assert rows(once) == sorted(
        [("x", 5, 5), (None, 2, 2), (None, 2, 2), ("y", 1, 1)], key=str
    )
    keyed = source.where("k is not null")
    assert rows(upsert.merge(once, keyed, ["k"])) == rows(once)


def test_several_keys_and_hot_target_key(spark):
    target = spark.range(3000).select(
        F.when(F.col("id") < 1000, 0).otherwise(F.col("id")).alias("k"),
        F.lit("z").alias("k2"),
        F.lit(1).alias("v"),
    )
    source = spark.createDataFrame([(0, "z", 7), (5000, "z", 8), (0, "q", 9)], "k long, k2 string, v int")
    counts = upsert.merge(target, source, ["k", "k2"], with_status=True).groupBy("_merge_status").count()
    assert dict(map(tuple, counts.collect())) == {"updated": 1000, "kept": 2000, "inserted": 2}


def test_duplicate_source_rows(spark):
    target = spark.createDataFrame([("x", 1, 1)], SCHEMA)
    clash = spark.createDataFrame([("x", 2, 2), ("x", 3, 3)], SCHEMA)
    with pytest.raises(upsert.DuplicateSourceKey):
        upsert.check_unique_matches(target, clash, ["k"])
    harmless = spark.createDataFrame([("y", 2, 2), ("y", 3, 3)], SCHEMA)
    upsert.check_unique_matches(target, harmless, ["k"])
    assert upsert.merge(target, harmless, ["k"]).count() == 3


def destination(spark, *values):
    return spark.createDataFrame(list(values), "destination_name string, population_count long, country string")


def test_merge_into_a_table(spark):
    name = "travel.destinations"
    spark.sql("DROP TABLE IF EXISTS travel.destinations")
    first = destination(spark, ("Paris", 2161000, "France"), ("London", 8982000, "UK"))
    result = tables.merge_into(first, name, DESTINATIONS_TABLE, ["destination_name"])
    assert (result.status, result.inserted, result.updated, result.rows_total) == ("loaded", 2, 0, 2)
    again = tables.merge_into(first, name, DESTINATIONS_TABLE, ["destination_name"])
    assert (again.inserted, again.updated, again.rows_total) == (0, 0, 2)
    more = destination(spark, ("Paris", 2100000, "France"), ("Rome", None, "Italy"))
    result = tables.merge_into(more, name, DESTINATIONS_TABLE, ["destination_name"])
    assert (result.inserted, result.updated, result.rows_total) == (1, 1, 3)
    stored = spark.table(name)
    assert stored.schema.names == DESTINATIONS_TABLE.names
    assert dict(map(tuple, stored.select("destination_name", "population_count").collect())) == {
        "Paris": 2100000,
        "London": 8982000,
        "Rome": None,
    }
    empty = tables.merge_into(more.where("false"), name, DESTINATIONS_TABLE, ["destination_name"])
    assert empty.status == "empty" and empty.rows_total == 3
    here = tables.table_location(spark, name).removeprefix("file:")
    beside = [f for f in os.listdir(os.path.dirname(here)) if f.startswith("destinations")]
    assert beside == [os.path.basename(here)]
    appended = tables.append(destination(spark, ("Oslo", 1, "Norway")), name, DESTINATIONS_TABLE)
    assert appended.rows_total == 4


def test_appends(spark):
    spark.sql("DROP TABLE IF EXISTS travel.plain")
    first = spark.createDataFrame([(1, "a")], "id int, x string")
    assert tables.append_autodetect(first, "travel.plain").status == "loaded"
    wider = spark.createDataFrame([(2.5, 2)], "y double, id int")
    assert tables.append_autodetect(wider, "travel.plain").rows_total == 2
    assert tables.append_autodetect(first.where("false"), "travel.plain").status == "empty"
    assert rows(spark.table("travel.plain")) == [(1, "a", None), (2, None, 2.5)]
    replaced = tables.truncate_and_load(first, "travel.plain", spark.table("travel.plain").schema)
    assert replaced.rows_total == 1 and rows(spark.table("travel.plain")) == [(1, "a", None)]
    nothing = tables.append(first.where("false"), "travel.plain", spark.table("travel.plain").schema)
    assert nothing.status == "empty" and nothing.rows_total == 1
    bad = spark.createDataFrame([("x",)], "id string")
    failed = tables.append(bad, "travel.plain", spark.table("travel.plain").schema)
    assert failed.status == "failed" and failed.error
    assert spark.table("travel.plain").count() == 1


def test_new_keys_only(spark):
    spark.sql("DROP TABLE IF EXISTS travel.keyed")
    frame = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "k string, v int")
    tables.append_new_keys(frame, "travel.keyed", frame.schema, "k")
    more = spark.createDataFrame([("b", 0), ("c", 4)], "k string, v int")
    tables.append_new_keys(more, "travel.keyed", frame.schema, "k")
    assert rows(spark.table("travel.keyed")) == [("a", 1), ("b", 3), ("c", 4)]


def test_keep_first(spark):
    frame = spark.createDataFrame([(3, "A"), (1, "b"), (2, "a"), (4, "B"), (5, None)], "i int, n string")
    kept = keep_first(frame, [F.lower("n")], [F.col("i")])
    assert rows(kept) == [(1, "b"), (2, "a"), (5, None)]


def test_merge_into_buckets(spark, tmp_path):
    path = str(tmp_path / "buckets")
    schema = spark.createDataFrame([], SCHEMA).schema

    def load(*values):
        frame = spark.createDataFrame(list(values), SCHEMA)
        return tables.merge_into_buckets(frame, path, schema, ["k"], buckets=8)

    def stored():
        return rows(tables.read_buckets(spark, path, schema).drop("bucket"))

    def written():
        return {f: f.stat().st_mtime_ns for f in (tmp_path / "buckets").rglob("*.parquet")}

    assert stored() == []
    result = load(*[(f"k{i}", i, None) for i in range(40)])
    assert (result.inserted, result.updated) == (40, 0)
    before = written()
    assert (load(("k1", 1, None)).updated, written()) == (0, before)
    result = load(("k1", 100, None), ("new", 1, 1))
    assert (result.inserted, result.updated) == (1, 1)
    # Two keys touch two folders at most; the files of the others are the same ones.
    kept = before.keys() & written().keys()
    assert len({f.parent for f in before} - {f.parent for f in kept}) <= 2 and len(kept) >= 5
    assert len(stored()) == 41 and ("k1", 100, None) in stored()
    assert load().status == "empty"
    with pytest.raises(upsert.DuplicateSourceKey):
        load(("k1", 1, 1), ("k1", 2, 2))


def folders(spark, name):
    here = tables.table_location(spark, name).removeprefix("file:")
    stem = os.path.basename(here).split("__")[0]
    return {f for f in os.listdir(os.path.dirname(here)) if f.startswith(stem)}, os.path.basename(here)


def test_a_failed_write_leaves_nothing(spark):
    spark.sql("DROP TABLE IF EXISTS travel.fragile")
    schema = spark.createDataFrame([], "k string, v double").schema
    good = spark.createDataFrame([("a", 1.0)], schema)
    assert tables.merge_into(good, "travel.fragile", schema, ["k"]).ok
    before = folders(spark, "travel.fragile")
    bad = good.withColumn("v", F.lit("no number"))
    result = tables.merge_into(bad, "travel.fragile", schema, ["k"])
    assert result.status == "failed" and result.error
    assert folders(spark, "travel.fragile") == before and rows(spark.table("travel.fragile")) == [("a", 1.0)]


def test_a_second_writer_is_noticed(spark, monkeypatch):
    spark.sql("DROP TABLE IF EXISTS travel.busy")
    schema = spark.createDataFrame([], "k string, v double").schema
    make = lambda *values: spark.createDataFrame(list(values), schema)
    assert tables.merge_into(make(("a", 1.0)), "travel.busy", schema, ["k"]).ok
    locate, calls = tables.table_location, []

    def meanwhile(*args):
        calls.append(args)
        if len(calls) == 2:
            monkeypatch.setattr(tables, "table_location", locate)
            assert tables.merge_into(make(("b", 2.0)), "travel.busy", schema, ["k"]).ok
        return locate(*args)

    monkeypatch.setattr(tables, "table_location", meanwhile)
    late = tables.merge_into(make(("c", 3.0)), "travel.busy", schema, ["k"])
    assert late.status == "failed" and "another writer" in late.error
    assert rows(spark.table("travel.busy")) == [("a", 1.0), ("b", 2.0)]
    found, current = folders(spark, "travel.busy")
    assert found == {current}


def test_the_number_of_buckets_is_kept(spark, tmp_path):
    path = str(tmp_path / "kept")
    frame = spark.createDataFrame([(f"k{i}", i, None) for i in range(50)], SCHEMA)
    schema = frame.schema
    assert tables.merge_into_buckets(frame, path, schema, ["k"], buckets=16).inserted == 50
    refused = tables.merge_into_buckets(frame, path, schema, ["k"], buckets=7)
    assert refused.status == "failed" and "16" in refused.error
    again = tables.merge_into_buckets(frame, path, schema, ["k"])
    assert (again.inserted, again.updated) == (0, 0)
    assert tables.read_buckets(spark, path, schema).count() == 50


def test_loads_leave_no_scratch_folders(spark, tmp_path):
    before = set(listing(spark, f"{shared_dir(spark)}/*"))
    spark.sql("DROP TABLE IF EXISTS travel.tidy")
    frame = spark.createDataFrame([("a", 1, None)], SCHEMA)
    tables.append_new_keys(frame, "travel.tidy", frame.schema, "k")
    tables.merge_into(frame, "travel.tidy", frame.schema, ["k"])
    tables.merge_into_buckets(frame.where("false"), str(tmp_path / "t"), frame.schema, ["k"])
    assert set(listing(spark, f"{shared_dir(spark)}/*")) == before
