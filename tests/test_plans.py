"""What the plans must and must not contain."""

import json
import random

import pytest
from pyspark.sql import functions as F

from wayloom.functions import html
from wayloom.operators import elements as el
from wayloom.operators import profile, quality, upsert
from wayloom.operators.dedup import keep_first
from wayloom.plans import destinations, trips, weather
from wayloom.suite import inputs, registry
from wayloom.suite.inputs import table

DATA = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    """Plans as they are when every side is too large to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def csv_trips(spark, tmp_path):
    path = str(tmp_path / "trips.csv")
    inputs.raw_trips(spark, DATA).write.option("header", True).csv(path)
    from wayloom.sources.files import read_csv

    return read_csv(spark, path)


def test_cleaning_is_one_stage_without_python(spark, tmp_path):
    found = plan(trips.to_warehouse(trips.clean_trips(csv_trips(spark, tmp_path))))
    assert "Exchange" not in found and "Python" not in found and found.count("FileScan") == 1


def test_unused_columns_are_not_read(spark):
    parsed = weather.parse_payloads(
        table(spark, DATA, "events").select("event_id", F.col("props").alias("payload"))
    )
    assert "ReadSchema: struct<event_id:bigint,props:string>" in plan(parsed)


def test_payloads_are_parsed_once_and_not_shuffled(spark, tmp_path):
    path = str(tmp_path / "payloads")
    table(spark, DATA, "events").select(F.col("props").alias("payload")).write.parquet(path)
    frame = weather.forecast_rows(weather.parse_payloads(spark.read.parquet(path)), 3)
    found = plan(frame)
    assert "Exchange" not in found
    assert found.count("from_json") == 1
    assert "Python" not in found


def test_forecast_lengths_parse_the_payloads_once(spark):
    found = plan(registry.queries()["forecast_lengths"](spark, DATA))
    assert "Scan parquet" in found and "from_json" not in found and "to_json" not in found


def test_cut_days_count_on_from_the_used_ones(spark):
    day = {"temp": {}, "feels_like": {}, "weather": [{}], "sunrise": 1, "sunset": 2}
    daily = [day | {"dt": 1}, day | {"dt": 2}, day, day | {"dt": 4}]
    texts = [json.dumps({"city": "A", "response": {"daily": d}}) for d in (daily, daily[:2], [], None)]
    rows = weather.parse_payloads(spark.createDataFrame([(t,) for t in texts], "payload string"))
    lost = weather.cut_days(rows, 4)
    assert [(r["city"], r["day_no"], r["unusable"], r["d"]["dt"]) for r in lost.collect()] == [
        ("A", 2, True, None),
        ("A", 3, False, 4),
    ]


def test_pages_never_need_a_shuffle(spark):
    found = plan(destinations.extract_destinations(table(spark, DATA, "pages"), "url", "html"))
    assert "Exchange" not in found
    assert found.count("ArrowEvalPython") == 1 and found.count("FileScan") == 1


def test_few_rules_walk_all_nodes_of_a_page(spark):
    pages = table(spark, DATA, "pages")
    frame = destinations.extract_destinations(pages, "url", "html")
    found = frame._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < found.count("filter(nodes#") <= 6


# The patterns as they were first written down: alternatives within one repeated group.
HIDDEN = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
TOKEN = (
    r"<(/?[a-zA-Z][^\s/>]*+)"
    r"((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>"
    r"((?:[^<]++|<(?![/a-zA-Z!?]))*+)"
)


def test_quick_patterns_find_what_the_plain_ones_do(spark):
    draw = random.Random(7)
    pieces = ["<", ">", "=", "/", "'", '"', " ", "\t", "\x0b", "\x85", "\xa0", "a", "Br", "<p", "</p>", "!", "?", "é"]
    pieces += ["<!--", "-->", "<script", "<SCRIPT>", "</Script >", "<style x>", "</style", "ſ", "s", "\n", "x='>'"]
    texts = [("".join(draw.choices(pieces, k=draw.randint(0, 25))),) for _ in range(4000)]
    frame = spark.createDataFrame(texts, "x string")
    x = F.col("x")
    differ = html.visible(x) != F.regexp_replace(x, HIDDEN, "")
    for group, name in enumerate(("tags", "attrs", "txts"), start=1):
        plain = F.regexp_extract_all(x, F.lit(TOKEN), F.lit(group))
        differ = differ | (html.token_parts(x)[name] != plain)
    assert frame.where(differ).collect() == []
    assert frame.where(F.size(html.token_parts(x)["tags"]) > 1).count() > 100


def test_element_operators_share_one_shuffle(spark):
    found = el.elements(table(spark, DATA, "pages"), ["page_id"], tags=["p", "a", "nav"])
    both = el.mark_inside(
        el.find_next(found, ["page_id"], F.col("tag") == "p", F.col("ord"), "next_p"),
        ["page_id"],
        F.col("tag") == "nav",
        "in_nav",
    )
    assert plan(both).count("Exchange") == 1


def test_upsert_does_not_shuffle_the_target_for_a_small_source(spark):
    orders = table(spark, DATA, "orders").withColumnRenamed("o_orderkey", "k")
    found = plan(upsert.merge(orders, orders.where("o_orderpriority = '1-URGENT'"), ["k"]))
    assert "SortMergeJoin" not in found and "Cartesian" not in found and "NestedLoop" not in found
    assert "LeftOuter" in found and "LeftSemi" in found and "LeftAnti" in found


def test_upsert_of_large_sides_hashes_on_the_key(spark, no_broadcast):
    orders = table(spark, DATA, "orders").withColumnRenamed("o_orderkey", "k")
    found = plan(upsert.merge(orders, orders, ["k"]))
    assert found.count("SortMergeJoin") == 3
    assert "Broadcast" not in found and "Cartesian" not in found and "FullOuter" not in found


def test_first_rows_are_combined_before_the_shuffle(spark):
    found = plan(keep_first(table(spark, DATA, "part"), [F.col("p_type")], [F.col("p_partkey")]))
    assert "partial_min_by" in found and "Window" not in found


def test_profiles_combine_before_the_shuffle(spark):
    found = plan(profile.frequencies(table(spark, DATA, "lineitem"), "l_quantity"))
    assert "partial_count" in found and "SinglePartition" not in found.split("Subquery")[0]


def test_grid_is_not_a_cross_join(spark, no_broadcast):
    users = table(spark, DATA, "events").select("user_id").distinct()
    grid = quality.expected_grid(users, F.current_date(), F.lit(3))
    seen = table(spark, DATA, "events").select("user_id", F.col("ts").cast("date").alias("day"))
    found = plan(quality.missing_cells(grid, seen, ["user_id", "day"]))
    assert "Cartesian" not in found and "NestedLoop" not in found and "LeftAnti" in found


def test_archived_days_are_pruned(spark, tmp_path):
    from wayloom.sinks.files import archive_partitioned

    path = archive_partitioned(table(spark, DATA, "events"), str(tmp_path / "archive"), "ts")
    back = spark.read.schema("event_id long, year string, month string, day string").json(path)
    found = plan(back.where("day = '15'"))
    assert "PartitionFilters: [isnotnull(day" in found
    files = back.where("day = '15'").select(F.input_file_name()).distinct().count()
    assert files == 1


LAZY = [
    "synth_trips",
    "synth_raw",
    "synth_tiered",
    "value_index",
    "merge_upsert",
    "merge_null_key",
    "page_links",
    "page_list_pairs",
    "destination_records",
    "explode_forecast",
    "dedup_keep_first",
    "trip_costs",
]


@pytest.mark.parametrize("name", LAZY)
def test_no_query_pairs_everything_with_everything(spark, no_broadcast, name):
    found = plan(registry.queries()[name](spark, DATA))
    assert "CartesianProduct" not in found and "BroadcastNestedLoopJoin" not in found
    # Only the table of bucket sizes is broadcast, whose rows are limited by its making.
    if not name.startswith("synth_") and name != "value_index":
        assert "BroadcastExchange" not in found
