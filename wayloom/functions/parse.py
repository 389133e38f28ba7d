"""Scalar parsing and formatting rules as ``Column -> Column`` functions.

Everything here is a composition of built-in functions, so it stays inside
generated code next to the scan it follows.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space in Python's ``str.strip``.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Plain decimal or exponent notation; keeps out ``7d``, ``nan``, ``inf`` and ``1_000``,
# which the engines disagree about.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

DATE_FORMATS = ("yyyy-MM-dd", "M/d/yyyy")

WIKI_BASE_URL = "https://en.wikipedia.org/wiki/"


def strip(text: Column) -> Column:
    """Trim every kind of white space at both ends (``trim`` alone only knows the blank)."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


def parse_number(text: Column) -> Column:
    """Number or NULL."""
    cleaned = strip(text.cast("string"))
    return F.when(cleaned.rlike(NUMBER), cleaned.try_cast("double"))


def parse_integer(text: Column) -> Column:
    """Whole number or NULL; ``7.0`` is 7, ``7.5`` is NULL.

    Digits are cast straight to ``bigint``: a detour over ``double`` would round
    numbers beyond 2^53.
    """
    cleaned = strip(text.cast("string"))
    number = parse_number(text)
    return F.when(cleaned.rlike(r"^[+-]?[0-9]+$"), cleaned.try_cast("bigint")).otherwise(
        F.when(number == F.floor(number), number.try_cast("bigint"))
    )


def _currency_digits(text: Column) -> Column:
    bare = text.cast("string")
    for mark in ("$", ",", "USD"):
        bare = F.replace(bare, F.lit(mark), F.lit(""))
    return strip(bare)


def currency_is_malformed(text: Column) -> Column:
    """True where text is present but no amount is left after the marks are removed."""
    return ~is_blank(text.cast("string")) & ~_currency_digits(text).rlike(NUMBER)


def parse_currency(text: Column, on_error: str = "fail") -> Column:
    """``$1,200`` / ``$1200`` / ``1200 USD`` / ``1200`` to double; blank is NULL.

    ``on_error="fail"`` stops the job at text that holds no amount, ``"null"`` yields NULL.
    """
    _check_mode(on_error)
    digits = _currency_digits(text)
    amount = F.when(digits.rlike(NUMBER), digits.try_cast("double"))
    if on_error == "null":
        return amount
    problem = F.raise_error(F.concat(F.lit("not an amount: "), text.cast("string")))
    return F.when(currency_is_malformed(text), problem.cast("double")).otherwise(amount)


def parse_date(
    text: Column, formats: Sequence[str] = DATE_FORMATS, on_error: str = "null"
) -> Column:
    """First format that fits wins; the order is explicit, never inferred from the rows."""
    _check_mode(on_error)
    cleaned = strip(text.cast("string"))
    day = F.coalesce(*[_date_of_format(cleaned, fmt) for fmt in formats])
    if on_error == "null":
        return day
    problem = F.raise_error(F.concat(F.lit("not a date: "), text.cast("string")))
    return F.when(~is_blank(text) & day.isNull(), problem.cast("date")).otherwise(day)


def _date_of_format(text: Column, fmt: str) -> Column:
    """Date or NULL; text of another shape is not handed to the parser, whose failures cost
    far more than its successes."""
    digits = {
        "yyyy": "[0-9]{4}",
        "MM": "[0-9]{2}",
        "dd": "[0-9]{2}",
        "M": "[0-9]{1,2}",
        "d": "[0-9]{1,2}",
    }
    parts = [run.group() for run in re.finditer(r"([a-zA-Z])\1*|.", fmt)]
    if any(part.isalpha() and part not in digits for part in parts):
        return F.try_to_date(text, fmt)
    shape = "".join(digits.get(part) or re.escape(part) for part in parts)
    return F.when(text.rlike(f"^{shape}$"), F.try_to_date(text, fmt))


def date_is_malformed(text: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    return ~is_blank(text) & parse_date(text, formats).isNull()


def format_iso_date(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def format_us_date(day: Column) -> Column:
    return F.date_format(day, "M/d/yyyy")


def end_date(start: Column, days: Column) -> Column:
    return F.date_add(start, days.cast("int"))


def epoch_to_timestamp(seconds: Column) -> Column:
    """Epoch seconds as an instant; no local clock is involved."""
    return F.timestamp_seconds(seconds)


def epoch_to_utc_date(seconds: Column) -> Column:
    """Calendar day in UTC, by integer arithmetic and so independent of the session zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))


def logical_key(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)


def slug(name: Column) -> Column:
    return F.translate(name, " ", "_")


def page_url(name: Column, base: str = WIKI_BASE_URL) -> Column:
    return F.concat(F.lit(base), slug(name))


def drop_citations(text: Column) -> Column:
    return F.regexp_replace(text, r"\[[0-9]+\]", "")


def parse_coordinates(text: Column) -> Column:
    """``"lat; lon"`` to a struct; exactly one ``;`` is needed, a bad latitude voids both."""
    parts = F.split(text, ";")
    latitude = F.when(F.size(parts) == 2, parse_number(F.get(parts, 0)))
    longitude = F.when(latitude.isNotNull(), parse_number(F.get(parts, 1)))
    return F.struct(latitude.alias("latitude"), longitude.alias("longitude"))


def parse_population(text: Column) -> Column:
    """First digit run as the count, ``(dddd)`` as its year."""
    digits = F.replace(F.regexp_extract(text, "([0-9,]+)", 1), F.lit(","), F.lit(""))
    count = F.nullif(digits, F.lit("")).try_cast("bigint")
    # A run of commas alone is a failed count and ends the parse before the year.
    has_year = text.rlike("[0-9,]") & count.isNull()
    year = F.nullif(F.regexp_extract(text, r"\(([0-9]{4})\)", 1), F.lit("")).try_cast("bigint")
    return F.struct(
        count.alias("count"), F.when(~has_year, year).alias("year")
    )


def split_list(text: Column) -> Column:
    parts = F.transform(F.split(strip(text), ",|\n"), strip)
    return F.filter(parts, lambda part: part != "")


def absolute_url(src: Column) -> Column:
    return F.when(F.startswith(src, F.lit("//")), F.concat(F.lit("https:"), src)).otherwise(src)


def round_to_tens(value: Column) -> Column:
    """Half-even, as Python rounds: 25 becomes 20 and 35 becomes 40."""
    return F.bround(value, -1)


# Names of the four ways an amount is written.
STYLE_PLAIN = "NUM"
STYLE_DOLLAR = "$NUM"
STYLE_DOLLAR_COMMAS = "$NUM_WITH_COMMAS"
STYLE_USD = "NUM_USD"


def currency_style(text: Column) -> Column:
    text = text.cast("string")
    return (
        F.when(text.contains("$") & text.contains(","), STYLE_DOLLAR_COMMAS)
        .when(text.contains("$"), STYLE_DOLLAR)
        .when(text.contains("USD"), STYLE_USD)
        .when(text.isNotNull(), STYLE_PLAIN)
    )


def format_currency(amount: Column, style: Column, decimals: int = 0) -> Column:
    """Write ``amount`` in the named style; grouped output keeps ``decimals`` places."""
    plain = amount.cast("bigint").cast("string") if decimals == 0 else amount.cast("string")
    return (
        F.when(style == STYLE_DOLLAR_COMMAS, F.concat(F.lit("$"), F.format_number(amount, decimals)))
        .when(style == STYLE_DOLLAR, F.concat(F.lit("$"), plain))
        .when(style == STYLE_USD, F.concat(plain, F.lit(" USD")))
        .otherwise(plain)
    )


def _check_mode(on_error: str) -> None:
    if on_error not in ("fail", "null"):
        raise ValueError(f"on_error must be 'fail' or 'null', not {on_error!r}")
