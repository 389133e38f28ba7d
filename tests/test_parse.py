import datetime as dt
import math
import re

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayloom.functions import draws, parse
from wayloom.functions.classify import description_from_text, keyword_class, name_from_text


def test_white_space_is_that_of_python():
    assert set(parse.WHITESPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_currency(many):
    texts = ["1200", "$1200", "$1,200", "1200 USD", " ", "", None, "N/A", "$-12.50", "$"]
    amounts = [1200.0, 1200.0, 1200.0, 1200.0, None, None, None, None, -12.5, None]
    assert many(lambda x: parse.parse_currency(x, "null"), texts) == amounts


@pytest.mark.parametrize("text", ["N/A", "$", "inf", "1_000"])
def test_currency_fails_on_text(one, text):
    with pytest.raises(Exception, match="not an amount"):
        one(parse.parse_currency, text)


def test_numbers(many):
    texts = ["7", " 7.5 ", "7d", "nan", "inf", "1_000", "abc", None, "-3", ".5", "1e3", "5."]
    expected = [7.0, 7.5, None, None, None, None, None, None, -3.0, 0.5, 1000.0, 5.0]
    texts, expected = [*texts, "0e400", "1e-400"], [*expected, 0.0, 0.0]
    assert many(parse.parse_number, texts) == expected


def test_integers_keep_all_digits(many):
    texts = ["9007199254740993", "7.0", "7.5", "x", "-4"]
    assert many(parse.parse_integer, texts) == [9007199254740993, 7, None, None, -4]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="0123456789.+-e ", max_size=6), min_size=1, max_size=60))
def test_numbers_agree_with_pandas(many, texts):
    # Beyond two digits of exponent pandas overflows where ``0e400`` is plainly 0: left out.
    texts = [t for t in texts if not re.search(r"e[+-]?[0-9]{3}", t)]
    wanted = pd.to_numeric(pd.Series(texts, dtype=object), errors="coerce")
    found = many(parse.parse_number, texts)
    for text, a, b in zip(texts, found, wanted):
        if math.isinf(b):
            continue
        assert (a is None and math.isnan(b)) or a == b, text


def test_dates(many):
    texts = ["1/5/2024", "2024-01-05", "13/5/2024", None, "2024-02-30", "01/05/2024", "soon"]
    day = dt.date(2024, 1, 5)
    assert many(parse.parse_date, texts) == [day, day, None, None, None, day, None]
    assert many(lambda x: parse.parse_date(x, ("d/M/yyyy",)), ["13/5/2024"]) == [dt.date(2024, 5, 13)]
    assert many(lambda x: parse.parse_date(x, ("d MMM yyyy",)), ["5 Jan 2024"]) == [day]


def test_strict_dates(one):
    with pytest.raises(Exception, match="not a date"):
        one(lambda x: parse.parse_date(x, on_error="fail"), "soon")


def test_formats(one):
    day = lambda x: x.cast("date")
    assert one(lambda x: parse.format_us_date(day(x)), "2024-01-05") == "1/5/2024"
    assert one(lambda x: parse.format_us_date(parse.end_date(day(x), F.lit(30))), "2024-01-05") == "2/4/2024"
    styles = [parse.STYLE_PLAIN, parse.STYLE_DOLLAR, parse.STYLE_DOLLAR_COMMAS, parse.STYLE_USD]
    written = [one(lambda x: parse.format_currency(x.cast("int"), F.lit(s)), "1200") for s in styles]
    assert written == ["1200", "$1200", "$1,200", "1200 USD"]
    raw = [one(lambda x: parse.format_currency(x.cast("double"), F.lit(s), 1), "1230") for s in styles]
    assert raw == ["1230.0", "$1230.0", "$1,230.0", "1230.0 USD"]
    assert [one(parse.currency_style, w) for w in written] == styles


def test_half_even_tens(many):
    values = ["15", "25", "35", "-25", "1234.9"]
    found = many(lambda x: parse.round_to_tens(x.cast("double")), values)
    assert found == [round(float(v), -1) for v in values]


@pytest.mark.parametrize(
    "text, latitude, longitude",
    [
        ("40.7128; -74.0060", 40.7128, -74.006),
        ("40.7128", None, None),
        ("1;2;3", None, None),
        ("x; 2", None, None),
        ("1; x", 1.0, None),
    ],
)
def test_coordinates(one, text, latitude, longitude):
    assert tuple(one(parse.parse_coordinates, text)) == (latitude, longitude)


@pytest.mark.parametrize(
    "text, count, year",
    [
        ("8,804,190 (2020)", 8804190, 2020),
        ("• Total", None, None),
        ("about 12 (20201)", 12, None),
        (", (2020)", None, None),
    ],
)
def test_population(one, text, count, year):
    assert tuple(one(parse.parse_population, text)) == (count, year)


def test_small_rules(one):
    assert one(parse.split_list, " English, Spanish\nFrench,, ") == ["English", "Spanish", "French"]
    assert one(parse.drop_citations, "a[1] b[23][x]") == "a b[x]"
    assert one(parse.page_url, "New York City") == "https://en.wikipedia.org/wiki/New_York_City"
    assert one(parse.absolute_url, "//u/x.jpg") == "https://u/x.jpg"
    assert one(parse.absolute_url, "/x.jpg") == "/x.jpg"
    assert one(lambda x: parse.epoch_to_utc_date(x.cast("bigint")), "-1") == dt.date(1969, 12, 31)


@pytest.mark.parametrize(
    "name, kind",
    [
        ("Metropolitan Museum of Art", "museum"),
        ("Central Park", "park"),
        ("Empire State Building", "building"),
        ("Washington Monument", "monument"),
        ("Miami Beach", "beach"),
        ("Unknown Spot", "landmark"),
        ("Statue of Liberty", "monument"),
        ("PARK MUSEUM", "museum"),
    ],
)
def test_classes(one, name, kind):
    assert one(keyword_class, name) == kind


@pytest.mark.parametrize(
    "text, name, description",
    [
        ("Old Fort: a ruin", "Old Fort", "a ruin"),
        ("Old Fort - a ruin[3]", "Old Fort", "a ruin"),
        (": a ruin of old times by the sea", ": a ruin", "of old times by the sea"),
        ("The old fort by the sea of salt and sand", "The old fort", "by the sea of salt and sand"),
        ("a b c d e f g h i j k l m n o p q r s t u", "a b c d e", "f g h i j k l m n o p q r s t u"),
        ("One two three", "One two three", ""),
    ],
)
def test_entries(one, text, name, description):
    assert one(name_from_text, text) == name
    assert one(lambda x: description_from_text(x, F.lit(name)), text) == description


def test_draws_are_repeatable(spark):
    frame = spark.range(1000).select(draws.uniform(F.col("id"), "f", 1).alias("u"))
    first = sorted(r["u"] for r in frame.collect())
    again = sorted(r["u"] for r in frame.repartition(7).collect())
    assert first == again and 0 <= first[0] and first[-1] < 1
    assert abs(sum(first) / 1000 - 0.5) < 0.05
