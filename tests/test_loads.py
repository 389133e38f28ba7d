"""Published loads: their name in the catalog, compaction, removal."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from wayloom.plans import flows
from wayloom.schemas import TRIPS_RAW, TRIPS_TABLE
from wayloom.session import discard, matches
from wayloom.sinks import files as sinks
from wayloom.sinks import loads
from wayloom.streaming import pickup

LATER = dt.datetime(2100, 1, 1, tzinfo=dt.timezone.utc)


def write(spark, folder, day, ids):
    rows = [
        (str(i), "Rome", "1/5/2024", "2024-01-09", "7", "A", "30", None, None, "Hotel", "$1,200", None, " ")
        for i in ids
    ]
    sinks.write_csv(spark.createDataFrame(rows, TRIPS_RAW), folder, f"travel_data_202401{day:02d}.csv")


def ids(frame):
    return sorted(r["Trip_ID"] for r in frame.select("Trip_ID").collect())


@pytest.fixture
def place(tmp_path):
    return str(tmp_path / "in"), str(tmp_path / "table"), f"db_{uuid.uuid4().hex[:8]}.trips"


def load(spark, place, day, numbers, table=True):
    folder, path, name = place
    write(spark, folder, day, numbers)
    return pickup.pick_up_trips(spark, folder, path, table=name if table else None)


def test_name_in_the_catalog(spark, place):
    folder, path, name = place
    loads.register(spark, path, TRIPS_TABLE, name)
    assert spark.table(name).count() == 0
    assert [(f.name, f.dataType) for f in spark.table(name).schema] == [(f.name, f.dataType) for f in TRIPS_TABLE]
    load(spark, place, 1, [1, 2])
    assert ids(spark.table(name)) == [1, 2]
    load(spark, place, 2, [3], table=False)
    load(spark, place, 3, [4])
    assert ids(spark.table(name)) == ids(pickup.loaded_trips(spark, path)) == [1, 2, 3, 4]
    with pytest.raises(ValueError, match="is the table of"):
        loads.register(spark, f"{path}-other", TRIPS_TABLE, name)


def test_compaction_keeps_rows_and_running_readers(spark, place):
    folder, path, name = place
    for day in (1, 2, 3):
        load(spark, place, day, [day, 10 * day])
    before, named = pickup.loaded_trips(spark, path), spark.table(name)
    done = pickup.compact_trips(spark, path, name)
    assert (done.loads_replaced, done.rows, done.files) == (3, 6, 1)
    want = [1, 2, 3, 10, 20, 30]
    assert ids(before) == ids(named) == ids(spark.table(name)) == ids(pickup.loaded_trips(spark, path)) == want
    assert loads.visible_loads(spark, path).count() == 1
    # One load is nothing to compact; another one joins it, and files are not loaded again.
    assert pickup.compact_trips(spark, path, name).load is None
    assert load(spark, place, 4, [4]).files_total == 1
    assert pickup.compact_trips(spark, path, name).loads_replaced == 2
    assert loads.remove_replaced(spark, path, dt.datetime(2000, 1, 1, tzinfo=dt.timezone.utc), name) == 0
    assert loads.remove_replaced(spark, path, LATER, name) == 5
    assert loads.remove_replaced(spark, path, LATER, name) == 0
    assert ids(spark.table(name)) == ids(pickup.loaded_trips(spark, path)) == sorted([*want, 4])
    assert spark.sql(f"SHOW PARTITIONS {name}__rows").count() == 1


def test_large_loads_are_left_and_files_bounded(spark, place):
    folder, path, name = place
    load(spark, place, 1, range(10))
    for day in (2, 3, 4):
        load(spark, place, day, [100 * day + i for i in range(4)])
    done = pickup.compact_trips(spark, path, name, file_rows=8)
    assert (done.loads_replaced, done.rows, done.files) == (3, 12, 2)
    sizes = [r["rows"] for r in loads.visible_loads(spark, path).collect()]
    assert sorted(sizes) == [10, 12] and spark.table(name).count() == 22
    assert max(
        r["n"]
        for r in spark.read.parquet(f"{path}/rows/load={done.load}").groupBy(F.input_file_name()).agg(
            F.count("*").alias("n")
        ).collect()
    ) <= 8


def test_what_breaks_off_is_not_seen(spark, place, monkeypatch):
    folder, path, name = place
    load(spark, place, 1, [1])
    load(spark, place, 2, [2])
    with monkeypatch.context() as broken:
        def fail(*args):
            raise RuntimeError("lost")

        broken.setattr(loads, "add_load", fail)
        with pytest.raises(RuntimeError, match="lost"):
            pickup.compact_trips(spark, path, name)
    with monkeypatch.context() as broken:
        broken.setattr(pickup, "LOG", f"{pickup.LOG}, no_such_column long")
        with pytest.raises(Exception, match="no_such_column"):
            load(spark, place, 3, [3])
    assert spark.sql(f"SHOW PARTITIONS {name}__rows").count() == 3
    assert ids(spark.table(name)) == ids(pickup.loaded_trips(spark, path)) == [1, 2]
    # The load's rows are there and the catalog knows them, and still they do not count.
    assert pickup.pick_up_trips(spark, folder, path, table=name).rows_loaded == 1
    assert ids(spark.table(name)) == ids(pickup.loaded_trips(spark, path)) == [1, 2, 3]
    assert pickup.compact_trips(spark, path, name).loads_replaced == 3


def test_missing_rows_stop_a_compaction(spark, place):
    folder, path, name = place
    load(spark, place, 1, [1])
    load(spark, place, 2, [2])
    gone = loads.visible_loads(spark, path).first()["load"]
    for part in spark.read.parquet(f"{path}/rows/load={gone}").inputFiles():
        discard(spark, part)
    with pytest.raises(RuntimeError, match="1 rows written, 2 expected"):
        pickup.compact_trips(spark, path, name)
    assert not matches(spark, f"{path}/rows/load=compact-*")


def test_flow_names_its_table(spark, place):
    folder, path, name = place
    write(spark, folder, 1, [7])
    assert flows.run_trips(spark, folder, path, generate=False, table=name).success
    assert ids(spark.table(name)) == [7]


def test_nothing_to_compact(spark, place):
    assert pickup.compact_trips(spark, place[1]).loads_replaced == 0
