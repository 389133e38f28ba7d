import csv
import datetime as dt
import json

import fixtures_html as fx
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayloom.operators import quality, validate
from wayloom.operators.clean import split_by, valid_location
from wayloom.plans import flows, trips, weather
from wayloom.schemas import DESTINATION_RULES, FORECAST_PAYLOAD, PAGE, TRIPS_RAW, TRIPS_TABLE
from wayloom.session import listing, set_times, shared_dir
from wayloom.sinks import files as sinks
from wayloom.sources import files as sources
from wayloom.sources import reference_lists as lists
from wayloom.streaming import pickup

NOW = dt.datetime(2023, 1, 1, 12, 0, tzinfo=dt.timezone.utc)
GOOD = ("1", "Rome", "1/5/2024", "2024-01-09", "7d", "A", "30", None, None, "Hotel", "$1,200", None, " ")


def raw(spark, *rows):
    return spark.createDataFrame(list(rows), TRIPS_RAW)


# --- trips ------------------------------------------------------------------------------


def test_clean_and_shape(spark):
    cleaned = trips.clean_trips(raw(spark, GOOD, (None,) * 13))
    row = cleaned.first()
    assert cleaned.count() == 1
    assert row["Duration (days)"] == 7.0 and row["Traveler age"] == 30.0
    assert (row["Start date"], row["End date"]) == ("2024-01-05", "2024-01-09")
    assert (row["Accommodation cost"], row["Transportation cost"]) == (1200.0, None)
    assert row["Traveler gender"] == row["Transportation type"] == "Unknown"
    shaped = trips.to_warehouse(cleaned, F.lit(NOW), F.lit("f.csv"))
    assert [(f.name, f.dataType) for f in shaped.schema] == [(f.name, f.dataType) for f in TRIPS_TABLE]
    row = shaped.first()
    assert (row["Trip_ID"], row["Duration_days"], row["Source_file"]) == (1, 7, "f.csv")
    assert row["Start_date"] == dt.date(2024, 1, 5)


def with_cost(text, trip="2"):
    return (trip, *GOOD[1:10], text, *GOOD[11:])


def test_a_bad_cost_stops_cleaning_or_is_null(spark):
    frame = raw(spark, with_cost("N/A"))
    with pytest.raises(Exception, match="not an amount"):
        trips.clean_trips(frame).collect()
    assert trips.clean_trips(frame, "null").first()["Accommodation cost"] is None


def test_file_names_and_lineage(spark, tmp_path):
    assert sinks.dated_name("travel_data", NOW) == "travel_data_20230101.csv"
    assert sinks.dated_name("travel_data", NOW, True) == "travel_data_20230101_120000.csv"
    assert sinks.cleaned_name("/x/travel_data_20230101.csv") == "travel_data_20230101_cleaned.csv"
    folder = str(tmp_path)
    assert sources.latest_file(spark, folder) is None
    assert sources.read_latest(spark, folder, lineage="f").count() == 0
    for name in ("travel_data_20230101.csv", "raw_travel_data_20230203.csv", "faker_travel_data_20230202.csv"):
        sinks.write_csv(raw(spark, (name[:20], *GOOD[1:])), folder, name)
    (tmp_path / "travel_data_20230102 +x.csv").write_text(",".join(TRIPS_RAW.names) + "\n9" + "," * 12 + "\n")
    assert sources.latest_file(spark, folder).endswith("/raw_travel_data_20230203.csv")
    assert sources.latest_file(spark, folder, by="name").endswith("/travel_data_20230102 +x.csv")
    newest = sources.read_latest(spark, folder, lineage="f").collect()
    assert [r["f"] for r in newest] == ["raw_travel_data_20230203.csv"]
    every = sources.read_csv(spark, f"{folder}/*travel_data_*.csv", lineage="f")
    assert {r["f"] for r in every.collect()} == {
        "travel_data_20230101.csv",
        "raw_travel_data_20230203.csv",
        "faker_travel_data_20230202.csv",
        "travel_data_20230102 +x.csv",
    }


def run_pickup(spark, base, **options):
    return pickup.pick_up_trips(
        spark, f"{base}/in", f"{base}/table", ingested_at=NOW, **options
    )


def test_pickup_loads_each_file_once(spark, tmp_path):
    assert run_pickup(spark, tmp_path) == pickup.PickupResult()
    sinks.write_csv(raw(spark, GOOD), f"{tmp_path}/in", "travel_data_20240101.csv")
    assert run_pickup(spark, tmp_path) == pickup.PickupResult(1, 1, 1, 0)
    assert run_pickup(spark, tmp_path) == pickup.PickupResult()
    sinks.write_csv(raw(spark, with_cost("5 USD")), f"{tmp_path}/in", "raw_travel_data_20240102.csv")
    assert run_pickup(spark, tmp_path) == pickup.PickupResult(1, 1, 1, 0)
    rows = pickup.loaded_trips(spark, str(tmp_path / "table")).orderBy("Trip_ID").collect()
    assert [(r["Trip_ID"], r["Accommodation_cost"], r["Source_file"]) for r in rows] == [
        (1, 1200.0, "travel_data_20240101.csv"),
        (2, 5.0, "raw_travel_data_20240102.csv"),
    ]
    assert rows[0]["Ingestion_timestamp"].replace(tzinfo=dt.timezone.utc) == NOW


def test_a_malformed_file_is_withheld_alone(spark, tmp_path):
    sinks.write_csv(raw(spark, GOOD, with_cost("free")), f"{tmp_path}/in", "travel_data_20240101.csv")
    sinks.write_csv(raw(spark, with_cost("10", "3")), f"{tmp_path}/in", "travel_data_20240102.csv")
    assert run_pickup(spark, tmp_path) == pickup.PickupResult(2, 1, 1, 2)
    log = {r["Source_file"]: (r["malformed_rows"], r["loaded"]) for r in pickup.file_log(spark, f"{tmp_path}/table").collect()}
    assert log == {"travel_data_20240101.csv": (1, False), "travel_data_20240102.csv": (0, True)}


def test_a_withheld_file_is_tried_again(spark, tmp_path):
    sinks.write_csv(raw(spark, with_cost("free")), f"{tmp_path}/in", "travel_data_20240101.csv")
    for _ in range(2):
        assert run_pickup(spark, tmp_path) == pickup.PickupResult(1, 0, 0, 1)
    sinks.write_csv(raw(spark, with_cost("9")), f"{tmp_path}/in", "travel_data_20240101.csv")
    set_times(spark, f"{tmp_path}/in/travel_data_20240101.csv", NOW - dt.timedelta(days=900))
    assert run_pickup(spark, tmp_path) == pickup.PickupResult(1, 1, 1, 0)
    assert run_pickup(spark, tmp_path) == pickup.PickupResult()


def test_a_failed_run_leaves_nothing(spark, tmp_path, monkeypatch):
    sinks.write_csv(raw(spark, GOOD), f"{tmp_path}/in", "travel_data_20240101.csv")
    before = set(listing(spark, f"{shared_dir(spark)}/*"))
    with monkeypatch.context() as patch:
        patch.setattr(pickup, "LOG", "no_such_column long")
        with pytest.raises(Exception, match="no_such_column"):
            run_pickup(spark, tmp_path)
    assert pickup.loaded_trips(spark, f"{tmp_path}/table").count() == 0
    assert run_pickup(spark, tmp_path) == pickup.PickupResult(1, 1, 1, 0)
    assert pickup.loaded_trips(spark, f"{tmp_path}/table").count() == 1
    assert set(listing(spark, f"{shared_dir(spark)}/*")) == before


def test_a_run_that_breaks_keeps_the_batches_before(spark, tmp_path, monkeypatch):
    for k in range(7):
        cost = "free" if k == 1 else str(k)
        sinks.write_csv(raw(spark, with_cost(cost, str(k))), f"{tmp_path}/in", f"travel_data_2024010{k + 1}.csv")
    publish, loads = pickup._publish, []

    def breaks(rows, report, table_path, load, stamp):
        loads.append(load)
        if len(loads) == 3:
            raise RuntimeError("lost")
        return publish(rows, report, table_path, load, stamp)

    with monkeypatch.context() as patch:
        patch.setattr(pickup, "_publish", breaks)
        with pytest.raises(RuntimeError, match="lost"):
            run_pickup(spark, tmp_path, batch_files=2)
    ids = lambda: sorted(r["Trip_ID"] for r in pickup.loaded_trips(spark, f"{tmp_path}/table").collect())
    assert ids() == [0, 2, 3]
    # The withheld file is tried again, once in the run.
    assert run_pickup(spark, tmp_path, batch_files=2) == pickup.PickupResult(4, 3, 3, 1)
    assert ids() == [0, 2, 3, 4, 5, 6]
    assert run_pickup(spark, tmp_path, batch_files=1, multi_line=False) == pickup.PickupResult(1, 0, 0, 1)


def write_files(folder, number):
    heads = ['a,b,"c,d"', "b,a", '\ufeff"c,d",a,x', 'a,"b"']
    folder.mkdir()
    for k in range(number):
        head = heads[k % 4]
        line = ",".join([str(k)] * len(next(csv.reader([head]))))
        (folder / f"{k:05d} +é.csv").write_text(f"{head}\n{line}\n", encoding="utf-8")


def test_headers_of_many_files_take_the_same_jobs(spark, tmp_path):
    schema, jobs = "a string, b long, `c,d` string", []
    for number in (160, 400):
        write_files(tmp_path / str(number), number)
        spark.sparkContext.setJobGroup(f"csv-{number}", "headers")
        read = sources.read_csv(spark, str(tmp_path / str(number)), T.StructType.fromDDL(schema), lineage="f")
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"csv-{number}")))
        got = {r["f"]: r[:3] for r in read.collect()}
        assert got == {
            f"{k:05d} +é.csv": (str(k), None if k % 4 == 2 else k, str(k) if k % 4 in (0, 2) else None)
            for k in range(number)
        }
    # Spark lists up to 32 paths without a job; each of the four headers has more here.
    assert jobs[0] == jobs[1]


def test_odd_headers_among_many_files(spark, tmp_path):
    folder = tmp_path / "in"
    write_files(folder, 20)
    (folder / "empty.csv").write_text("")
    (folder / "blank.csv").write_text("\n\na,b\n1,2\n")
    (folder / "broken line.csv").write_text('a,"b\nq",b\n7,8,9\n')
    parts = folder / "parts.csv"
    parts.mkdir()
    (parts / "part-0.csv").write_text("")
    (parts / "part-1.csv").write_text("b,a\n5,6\n")
    (parts / "part-2.csv").write_text("b,a\n7,8\n")
    found = sources.read_csv(spark, [str(folder), f"{tmp_path}/none*"], T.StructType.fromDDL("a string, b long"), lineage="f")
    assert sorted(map(tuple, found.where("f NOT LIKE '0%'").collect())) == [
        ("1", 2, "blank.csv"),
        ("6", 5, "parts.csv"),
        ("7", 9, "broken line.csv"),
        ("8", 7, "parts.csv"),
    ]
    assert found.count() == 24
    assert sources.read_csv(spark, f"{tmp_path}/none/*.csv", T.StructType.fromDDL("a string")).count() == 0


def test_files_without_rows_are_logged(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "travel_data_20240101.csv").write_text("")
    (folder / "travel_data_20240102.csv").write_text(",".join(TRIPS_RAW.names) + "\n")
    # A file of no bytes is not there yet.
    assert run_pickup(spark, tmp_path) == pickup.PickupResult(1, 1, 0, 0)
    assert run_pickup(spark, tmp_path) == pickup.PickupResult()


def test_csv_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Destination,Trip ID,Traveler name,other\nParis,1,"He said ""hi"", ok",x\n')
    (tmp_path / "b.csv").write_text('Trip ID,Traveler name,Destination\n2,"two\nlines",N/A\n3,  c ,null\n')
    found = sources.read_csv(spark, str(tmp_path), lineage="file").orderBy("Trip ID").collect()
    assert [(r["Trip ID"], r["Destination"], r["Traveler name"], r["file"]) for r in found] == [
        ("1", "Paris", 'He said "hi", ok', "a.csv"),
        ("2", None, "two\nlines", "b.csv"),
        ("3", None, "  c ", "b.csv"),
    ]
    assert {r["Accommodation cost"] for r in found} == {None}


def test_clean_latest(spark, tmp_path):
    assert flows.clean_latest(spark, f"{tmp_path}/raw", f"{tmp_path}/clean") is None
    sinks.write_csv(raw(spark, GOOD), f"{tmp_path}/raw", "travel_data_20240101.csv")
    path = flows.clean_latest(spark, f"{tmp_path}/raw", f"{tmp_path}/clean")
    assert path.endswith("/clean/travel_data_20240101_cleaned.csv")
    assert sources.read_csv(spark, path).first()["Accommodation cost"] == "1200.0"


def test_tolerant_pickup(spark, tmp_path):
    sinks.write_csv(
        raw(spark, GOOD, with_cost("free"), with_cost("10", None)), f"{tmp_path}/in", "travel_data_20240101.csv"
    )
    assert run_pickup(spark, tmp_path, on_error="null") == pickup.PickupResult(1, 1, 2, 1)
    rows = pickup.loaded_trips(spark, f"{tmp_path}/table").collect()
    assert {r["Trip_ID"]: r["Accommodation_cost"] for r in rows} == {1: 1200.0, 2: None}
    aside = pickup.rejected_trips(spark, f"{tmp_path}/table").collect()
    assert [(r["Trip ID"], r["Accommodation cost"], r["Source_file"]) for r in aside] == [
        (None, "10", "travel_data_20240101.csv")
    ]


def test_trip_flow(spark, tmp_path):
    sample = raw(spark, *[(str(i), *GOOD[1:]) for i in range(1, 30)])
    places = (f"{tmp_path}/in", f"{tmp_path}/table")
    for method, first in (("distribution", 20), ("raw", 20), ("tiered", 20)):
        result = flows.run_trips(spark, *places, sample=sample, method=method, now=NOW)
        assert result.success, result.error
        assert result.steps["pickup"] == pickup.PickupResult(1, 1, first, 0)
    rows = pickup.loaded_trips(spark, places[1])
    assert rows.count() == 60 and rows.where("Accommodation_cost is null").count() == 0
    # The sample holds no transportation cost, so one kind of batch has none to draw from.
    assert rows.where("Transportation_cost is null").count() == 20
    metrics = flows.trip_metrics(spark, result, NOW).first()
    assert (metrics["files_generated"], metrics["files_ingested"], metrics["rows_out"]) == (1, 1, 20)
    failed = flows.run_trips(spark, *places, method="distribution", now=NOW)
    assert not failed.success and "sample" in failed.error


# --- destinations -----------------------------------------------------------------------


def test_destination_flow(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS travel.details")
    rows = [
        ("Lower Quandary", "u1", 200, {"Content-Type": "text/html"}, fx.FULL, "utf-8"),
        ("Empty", "u2", 200, {}, fx.EMPTY, "utf-8"),
        ("Missing", "u3", 404, {}, "Not Found", "utf-8"),
        ("Broken", "u4", None, None, None, None),
    ]
    pages = spark.createDataFrame(rows, PAGE)
    result = flows.run_destinations(spark, pages, str(tmp_path), "travel.details", now=NOW)
    assert result.success, result.error
    assert result.steps["fetch"] == {"succeeded": 2, "failed": 2}
    assert result.steps["load"].inserted == 2
    assert result.steps["raw_archive"].endswith("raw/wiki/2023/01/01/20230101_120000.json")
    assert {r[0] for r in quality.failed_fetches(pages).collect()} == {"Missing", "Broken"}
    raw_back = sources.read_pages(spark, result.steps["raw_archive"])
    assert raw_back.where("destination_name = 'Lower Quandary'").first()["content"] == fx.FULL
    slugs = spark.read.json(result.steps["raw_archive"]).select("slug")
    assert {r[0] for r in slugs.collect()} == {"Lower_Quandary", "Empty"}
    folder = tmp_path / "processed" / "wiki" / "destinations_20230101_120000.json"
    lines = [json.loads(l) for f in folder.glob("part-*") for l in f.read_text("utf-8").splitlines()]
    record = next(x for x in lines if x["destination_name"] == "Lower Quandary")
    assert record["timezone"] == "UTC+09:30" and record["ingestion_timestamp"] == "2023-01-01 12:00:00"
    stored = spark.table("travel.details").where("country = 'Vell Coast[2]'").first()
    assert stored["attractions_count"] == 3
    # A later fetch carries a new timestamp, and so updates every row.
    later = flows.run_destinations(
        spark, pages, str(tmp_path), "travel.details", now=NOW + dt.timedelta(days=1)
    )
    assert (later.steps["load"].updated, later.steps["load"].inserted) == (2, 0)


# --- weather ----------------------------------------------------------------------------


def day(dt_seconds, **changes):
    return {
        "dt": dt_seconds, "temp": {"max": 9.0, "min": 1.0, "day": 5.0, "night": 2.0},
        "feels_like": {"day": 4.0, "night": 0.0}, "humidity": 80.0, "wind_speed": 3.0,
        "weather": [{"main": "Rain", "description": "light", "icon": "10d"}],
        "pop": 0.5, "rain": 1.0, "uvi": 2.0, "clouds": 90.0,
        "sunrise": dt_seconds - 3600, "sunset": dt_seconds + 3600,
    } | changes


def payloads(spark):
    noon = 1672574400
    documents = [
        {"city": "Rome", "country": "IT", "latitude": 41.9, "longitude": 12.5, "response": {"daily": [
            day(noon), day(noon + 86400, pop=None, rain=None), day(noon + 2 * 86400)]}},
        {"city": "Oslo", "country": "NO", "latitude": 59.9, "longitude": 10.7, "response": {"daily": [
            day(noon, humidity=None, uvi=None)]}},
        {"city": "Bonn", "country": "DE", "latitude": 50.7, "longitude": 7.1, "response": {}},
        {"city": "Lima", "country": "PE", "latitude": -12.0, "longitude": -77.0, "response": {"daily": [
            day(noon), day(noon + 86400, weather=[]), day(noon + 2 * 86400)]}},
    ]
    frame = spark.createDataFrame([(json.dumps(d),) for d in documents], "payload string")
    return weather.parse_payloads(frame)


def test_forecast_rows(spark):
    rows = weather.forecast_rows(payloads(spark), 3, F.lit(NOW)).collect()
    assert sorted(r["logical_key"] for r in rows) == [
        "Lima|PE|2023-01-01", "Oslo|NO|2023-01-01",
        "Rome|IT|2023-01-01", "Rome|IT|2023-01-02", "Rome|IT|2023-01-03",
    ]
    second = next(r for r in rows if r["logical_key"] == "Rome|IT|2023-01-02")
    assert (second["precipitation_probability"], second["rain"], second["clouds"]) == (0.0, 0.0, 90.0)
    assert second["forecast_date"] == dt.date(2023, 1, 2)
    filled = dict(map(tuple, weather.filled_defaults(payloads(spark), 3).collect()))
    assert filled == {"precipitation_probability": 1, "rain": 1, "uvi": 1, "clouds": 0}
    missing = dict(map(tuple, quality.missing_pct(weather.forecast_rows(payloads(spark), 3)).collect()))
    assert missing["humidity"] == 20.0 and missing["max_temp"] == 0.0
    places = weather.location_completeness(payloads(spark), 2).collect()
    assert {(r["city"], r["available_days"], r["fetched_days"], r["missing_days"]) for r in places} == {
        ("Rome", 3, 2, 0), ("Oslo", 1, 1, 1), ("Lima", 3, 1, 1)}
    lost = weather.cut_days(payloads(spark), 3).collect()
    assert {(r["city"], r["day_no"], r["unusable"]) for r in lost} == {("Lima", 1, True), ("Lima", 2, False)}
    for days in (0, 8):
        with pytest.raises(ValueError, match="days"):
            weather.forecast_rows(payloads(spark), days)


def test_weather_flow(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS travel.weather")
    places = lists.locations(spark)
    result = flows.run_weather(spark, payloads(spark), str(tmp_path), "travel.weather", places, 2, NOW)
    assert result.success, result.error
    assert (result.steps["fetched_rows"], result.steps["expected_rows"]) == (4, 10)
    assert result.steps["coverage_pct"] == 40.0
    assert spark.table("travel.weather").count() == 4
    back = sources.read_payloads(spark, result.steps["archive"], FORECAST_PAYLOAD)
    assert back.count() == 3 and list((tmp_path / "weather_raw").rglob("*.json.gz"))
    nothing = payloads(spark).where("city = 'Bonn'")
    failed = flows.run_weather(spark, nothing, str(tmp_path), "travel.weather", places, 2, NOW)
    assert not failed.success and failed.steps["coverage_pct"] == 0.0
    assert sinks.archive_payloads(nothing.where("false"), str(tmp_path), NOW) is None


def test_utc_labels(spark):
    frame = spark.sql(
        "SELECT DATE'2023-01-02' AS forecast_date, TIMESTAMP_NTZ'2023-01-02 03:00:00' AS event_time, "
        "TIMESTAMP_NTZ'2023-01-02 03:00:00' AS sunrise"
    )
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            labelled = weather.label_utc(frame)
            row = labelled.select(F.unix_seconds("forecast_date"), F.unix_seconds("event_time")).first()
            assert tuple(row) == (1672617600, 1672628400)
            assert labelled.schema["sunrise"].dataType.typeName() == "timestamp_ntz"
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


# --- checks -----------------------------------------------------------------------------


def test_validation(spark):
    frame = spark.sql(
        """SELECT * FROM VALUES
        ('Paris', 'France', 'City', array('Eiffel'), 4.8D, '5000', named_struct('t', 15.5D), 'false', '2023-06-01T12:00:00Z'),
        ('', 'France', NULL, NULL, 4.8D, '5k', NULL, 'maybe', NULL)
        AS t(destination, country, description, attractions, rating, reviews_count, weather, has_beaches, updated_at)"""
    )
    good, bad = validate.split_valid(frame.drop("attractions"), DESTINATION_RULES)
    assert [r["destination"] for r in good.collect()] == ["Paris"]
    assert bad.first()["violations"] == [
        "destination: missing", "description: missing", "reviews_count: not INTEGER", "has_beaches: not BOOLEAN"]
    # Texts where records are declared are a violation of their own.
    found = frame.select(validate.violations(frame, DESTINATION_RULES).alias("v")).first()["v"]
    assert found == ["attractions: not RECORD"]
    missing = frame.drop("destination", "attractions")
    assert "destination: missing" in missing.select(validate.violations(missing, DESTINATION_RULES)).first()[0]


def test_ranges_and_grid(spark):
    frame = spark.createDataFrame([(90.0, 180.0), (90.1, 0.0), (0.0, None)], "lat double, lon double")
    valid, rejected = split_by(frame, valid_location(F.col("lat"), F.col("lon")))
    assert (valid.count(), rejected.count()) == (1, 2)
    grid = quality.expected_grid(lists.locations(spark).select("city"), F.lit(dt.date(2024, 1, 1)), F.lit(2))
    assert grid.count() == 10
    seen = spark.createDataFrame([("Paris", dt.date(2024, 1, 1))] * 3, "city string, day date")
    assert quality.missing_cells(grid, seen, ["city", "day"]).count() == 9
    assert lists.destinations(spark).count() == 15 and lists.trip_categories(spark).count() == 63


def test_every_run_leaves_a_line_in_the_metrics_table(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS metrics.runs")
    options = dict(generate=False, metrics_table="metrics.runs", now=NOW)
    for day, cost in ((1, "5"), (2, "free")):
        sinks.write_csv(raw(spark, with_cost(cost, str(day))), f"{tmp_path}/in", f"travel_data_2024010{day}.csv")
        done = flows.run_trips(spark, f"{tmp_path}/in", f"{tmp_path}/table", **options)
        assert done.steps["metrics"].ok
    flows.run_trips(spark, f"{tmp_path}/in", f"{tmp_path}/table", on_error="null", **options)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(flows, "pick_up_trips", lambda *a, **k: 1 / 0)
        assert not flows.run_trips(spark, f"{tmp_path}/in", f"{tmp_path}/table", **options).success
    kept = spark.table("metrics.runs").collect()
    found = sorted((r["files_total"], r["rows_in"], r["rows_out"], r["success"], bool(r["error"])) for r in kept)
    assert found == [(0, 0, 0, False, True), (1, 1, 0, False, False), (1, 1, 1, True, False), (1, 1, 1, True, False)]
    assert all(r["execution_time_seconds"] > 0 or r["error"] for r in kept)


def test_rules_reach_into_records_and_elements(spark):
    schema = (
        "tags array<string>, stops array<struct<name:string, days:array<string>, at:struct<lat:string>>>, "
        "place struct<name:string>, alone string"
    )
    inner = {"name": ("STRING", "REQUIRED"), "days": ("INTEGER", "REPEATED"), "at": ("RECORD", "REQUIRED", {"lat": ("FLOAT", "NULLABLE")})}
    rules = {
        "tags": ("INTEGER", "REPEATED"),
        "stops": ("RECORD", "REPEATED", inner),
        "place": ("RECORD", "NULLABLE", {"name": ("STRING", "REQUIRED"), "zip": ("STRING", "REQUIRED")}),
        "alone": ("STRING", "REPEATED"),
        "gone": ("RECORD", "REQUIRED", {"x": ("STRING", "REQUIRED")}),
    }
    data = [
        (["1", "2"], [("a", ["3"], ("1.5",)), ("b", [], ("2",))], ("p",), None),
        (["1", "x", None], [("", ["y", "4", None], None), None, ("c", None, ("north",))], None, "z"),
        (None, None, (None,), None),
    ]
    frame = spark.createDataFrame(data, schema).coalesce(1)
    found = [r[0] for r in frame.select(validate.violations(frame, rules)).collect()]
    assert found == [
        ["place.zip: missing", "gone: missing"],
        [
            "tags[1]: not INTEGER",
            "tags[2]: missing",
            "stops[0].name: missing",
            "stops[0].days[0]: not INTEGER",
            "stops[0].days[2]: missing",
            "stops[0].at: missing",
            "stops[1]: missing",
            "stops[2].at.lat: not FLOAT",
            "alone: not repeated",
            "gone: missing",
        ],
        ["place.name: missing", "place.zip: missing", "gone: missing"],
    ]
