import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayloom.operators import profile, synth
from wayloom.schemas import TRIP_COLUMNS, TRIPS_RAW

AS_OF = dt.date(2024, 1, 5)
MARKS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)


def normal_values():
    return np.random.default_rng(1).normal(100, 30, 6000)


def half_hot():
    values = normal_values()
    values[::3] = 120.0
    return values


@pytest.mark.parametrize(
    "values",
    [
        normal_values(),
        half_hot(),
        np.full(500, 3.0),
        np.array([1.0]),
        np.repeat([1.0, 2.0, 3.0], 900),
        np.concatenate([normal_values(), [1e300, -1e300]]),
        np.concatenate([normal_values(), [np.inf] * 100]),
    ],
    ids=["normal", "hot value", "constant", "single", "few values", "outliers", "infinite"],
)
@pytest.mark.parametrize("small", [50, 100_000])
def test_quantiles_are_exact(spark, monkeypatch, values, small):
    monkeypatch.setattr(profile, "SMALL", small)
    monkeypatch.setattr(profile, "ACCURACY", 100)
    frame = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "x double")
    found = profile.quantiles(frame.repartition(3), "x", MARKS)
    marks = MARKS[:-2] if np.isinf(values).any() else MARKS
    assert found[: len(marks)] == pytest.approx(list(np.quantile(values, marks)), rel=1e-12)


def test_quantiles_of_nothing(spark):
    assert profile.quantiles(spark.createDataFrame([], "x double"), "x", MARKS) == []
    assert profile.quantiles(spark.createDataFrame([(1.0,)], "x double"), "x", []) == []


@pytest.mark.parametrize("ends", [(0.0, 1.0), (98.0, 99.0), (2.0, 90.0), (40.0, 40.0)])
def test_a_sketch_that_is_wrong_costs_no_result(spark, monkeypatch, ends):
    monkeypatch.setattr(profile, "SMALL", 20)
    monkeypatch.setattr(profile, "ACCURACY", 20)
    values = spark.range(1000).select((F.col("id") % 100).cast("double").alias("x"))
    ranks = (0, 399, 400, 401, 999)
    found = profile._values_at(values, {r: ends for r in ranks}, 1000)
    assert found == {r: float(r // 10) for r in ranks}


@pytest.mark.parametrize("kind", ["double", "int"])
def test_quantiles_read_all_rows_twice_and_then_by_filter(spark, monkeypatch, tmp_path, kind):
    monkeypatch.setattr(profile, "SMALL", 100)
    monkeypatch.setattr(profile, "ACCURACY", 100)
    path, reads = str(tmp_path / "x"), []
    spark.range(40_000).select(F.col("id").cast(kind).alias("x")).repartition(2).write.parquet(path)
    between = profile._between
    monkeypatch.setattr(profile, "_between", lambda *a: reads.append(between(*a)) or reads[-1])
    found = profile.quantiles(spark.read.parquet(path), "x", [0.25, 0.5])
    assert found == [9999.75, 19999.5]
    assert reads
    for read in reads:
        pushed = read._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        ).split("PushedFilters:")[1].split("\n")[0]
        assert "GreaterThan(x," in pushed and "LessThan(x," in pushed


def test_histogram_agrees_with_numpy(spark):
    ages = [17, 18, 22.9, 23, 30, 67, 68, 69, 40, 40, None]
    frame = spark.createDataFrame([(float(a) if a else None,) for a in ages], "age double")
    found = profile.histogram(frame, "age", 18, 5, 10).orderBy("bin").collect()
    counts, _ = np.histogram([a for a in ages if a], bins=list(range(18, 70, 5)))
    assert [r["count"] for r in found] == list(counts)
    assert [r["probability"] for r in found] == pytest.approx(list(counts / counts.sum()))


def test_empty_histogram(spark):
    found = profile.histogram(spark.createDataFrame([], "age double"), "age", 18, 5, 10).collect()
    assert [r["probability"] for r in found] == [0.0] * 10


def test_indexes_and_intervals(spark):
    values = spark.range(5000).select(F.concat(F.lit("v"), "id").alias("value"))
    index = [r["index"] for r in profile.indexed_values(values).collect()]
    assert sorted(index) == list(range(5000))
    counts = values.withColumn("count", F.length("value").cast("long"))
    spans = sorted((r["lo"], r["hi"]) for r in profile.cumulative_intervals(counts).collect())
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert spans[-1][1] == counts.agg(F.sum("count")).first()[0]


def test_weighted_draws_match_the_intervals(spark):
    """Every draw against a scan of all intervals, with one value holding a third."""
    counts = spark.createDataFrame([("hot", 500)] + [(f"v{i}", 1 + i % 7) for i in range(250)], "value string, count long")
    spans = [tuple(r) for r in profile.cumulative_intervals(counts).collect()]
    total = max(hi for _, _, hi in spans)
    rows = spark.range(4000).withColumn("u", (F.col("id") + 0.5) / 4000)
    drawn = synth.draw_weighted(rows, F.col("u"), counts, "got").collect()
    assert len(drawn) == 4000
    for r in drawn:
        at = int(r["u"] * total)
        assert [v for v, lo, hi in spans if lo <= at < hi] == [r["got"]]


def test_uniform_draws_match_the_index(spark):
    values = spark.range(37).select(F.concat(F.lit("v"), "id").alias("value"))
    index = {r["index"]: r["value"] for r in profile.indexed_values(values).collect()}
    rows = spark.range(2000).withColumn("u", (F.col("id") + 0.5) / 2000)
    drawn = synth.draw_value(rows, F.col("u"), values, "got").collect()
    assert len(drawn) == 2000 and all(index[int(r["u"] * 37)] == r["got"] for r in drawn)


def sample(spark):
    rows = [
        (str(100 + i), f"City {i % 5}", "1/5/2024", "1/9/2024", ["3", "5", "x", None][i % 4],
         f"Name {i}", str(20 + i), "Male", "French", "Hotel", ["$1,200", "900", "700 USD", "$650"][i % 4],
         "Train", ["$80", "120 USD", " ", None][i % 4])
        for i in range(40)
    ]
    return spark.createDataFrame(rows + [(None,) * 13], TRIPS_RAW)


@pytest.mark.parametrize("method", ["distribution", "raw", "tiered"])
def test_synthesis_does_not_depend_on_partitioning(spark, method):
    from wayloom.plans.trips import generate

    def batch():
        return sorted(map(tuple, generate(spark, method, sample(spark), AS_OF, n=200, seed=3).collect()))

    first = batch()
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        assert batch() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert [r[0] for r in first] == list(range(140, 340))


def test_synthesis_from_a_profile(spark):
    found = synth.profile_trips(sample(spark), parse_costs=True)
    assert found.first_id == 140 and found.cost_marks["Accommodation cost"] == [650, 687.5, 800, 975, 1200]
    # Unreadable lengths count as seven days here, and not at all in the raw profile.
    assert {r["value"] for r in found.durations.collect()} == {3, 5, 7}
    assert {r["value"] for r in synth.profile_trips(sample(spark)).durations.collect()} == {3, 5}
    trips = synth.synthesize(spark, found, AS_OF, n=500, seed=5)
    assert trips.columns == list(TRIP_COLUMNS)
    for r in trips.collect():
        start = dt.datetime.strptime(r["Start date"], "%m/%d/%Y").date()
        end = dt.datetime.strptime(r["End date"], "%m/%d/%Y").date()
        assert (end - start).days == r["Duration (days)"]
        assert 1 <= abs((start - AS_OF).days) <= 180
        assert 18 <= r["Traveler age"] <= 67
        assert 640 <= r["Accommodation cost"] <= 1200 and r["Accommodation cost"] % 10 == 0
        assert r["Destination"].startswith("City ") and r["Traveler nationality"] == "French"
    past = trips.where(F.to_date("Start date", "M/d/yyyy") < F.lit(AS_OF)).count()
    assert 100 < past < 200


def test_synthesis_without_a_sample(spark):
    rows = synth.synthesize_tiered(spark, AS_OF, n=300).collect()
    assert rows[0]["Trip ID"] == 1000
    assert all(18 <= r["Traveler age"] <= 75 and 3 <= r["Duration (days)"] <= 14 for r in rows)
    assert len({r["Accommodation cost"][0] == "$" for r in rows}) == 2


def test_style_frequencies(spark):
    found = profile.style_frequencies(sample(spark), synth.COST_COLUMNS)
    counts = {r["style"]: r["count"] for r in found.collect()}
    # A blank text is still a text, and counts as plain.
    assert counts == {"$NUM_WITH_COMMAS": 10, "NUM": 20, "NUM_USD": 20, "$NUM": 20}


def test_next_key(spark):
    assert profile.next_key(spark.range(5), "id").first()[0] == 5
    assert profile.next_key(spark.range(0), "id").first()[0] == 1000
