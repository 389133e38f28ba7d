"""Keyword classes, and the name and description of a free-text list entry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayloom.functions.parse import drop_citations, strip

# Attraction classes in the order they are tried, with their keywords.
ATTRACTION_CLASSES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("museum", ("museum", "gallery", "exhibition")),
    ("palace", ("palace", "castle", "mansion", "estate")),
    ("park", ("park", "garden", "botanical")),
    ("religious", ("cathedral", "church", "temple", "mosque", "shrine", "chapel")),
    ("monument", ("monument", "memorial", "statue")),
    ("building", ("tower", "skyscraper", "building", "center", "centre")),
    ("square", ("square", "plaza", "piazza")),
    ("theatre", ("theater", "theatre", "opera")),
    ("bridge", ("bridge", "tunnel")),
    ("zoo", ("zoo", "aquarium")),
    ("beach", ("beach", "coast", "shore")),
    ("market", ("market", "bazaar", "shopping")),
)
DEFAULT_CLASS = "landmark"

# Fixed value: punctuation taken off the front of a description.
LEADING_MARKS = ":-–— "

# White space as ``str.split()`` sees it.
_BLANKS = r"(?U)[\s\x1c-\x1f]+"


def contains_any(text: Column, keywords: Sequence[str]) -> Column:
    """Substring test for any keyword; plain ``contains`` needs no regex engine."""
    found = F.contains(text, F.lit(keywords[0]))
    for keyword in keywords[1:]:
        found = found | F.contains(text, F.lit(keyword))
    return found


def keyword_class(
    name: Column,
    classes: Sequence[tuple[str, Sequence[str]]] = ATTRACTION_CLASSES,
    default: str = DEFAULT_CLASS,
) -> Column:
    """First class whose keyword occurs anywhere in ``name``, ignoring case."""
    return class_of_lowered(F.lower(name), classes, default)


def class_of_lowered(
    lowered: Column,
    classes: Sequence[tuple[str, Sequence[str]]] = ATTRACTION_CLASSES,
    default: str = DEFAULT_CLASS,
) -> Column:
    """:func:`keyword_class` for text already in lower case."""
    label = None
    for title, keywords in classes:
        hit = contains_any(lowered, keywords)
        label = F.when(hit, title) if label is None else label.when(hit, title)
    return F.lit(default) if label is None else label.otherwise(default)


def name_from_text(text: Column) -> Column:
    """Name of an entry without markup: before ``:``, else before `` - ``, else its first words."""
    colon = F.instr(text, ":")
    dash = F.instr(text, " - ")
    words = F.filter(F.split(text, _BLANKS), lambda word: word != "")
    count = F.size(words)
    keep = F.least(F.lit(5), F.greatest(F.lit(3), F.floor(count / 3).cast("int")))
    return (
        F.when(colon > 1, strip(F.substring(text, F.lit(1), colon - 1)))
        .when(dash > 1, strip(F.substring(text, F.lit(1), dash - 1)))
        .when(count <= 5, text)
        .otherwise(F.array_join(F.slice(words, F.lit(1), keep), " "))
    )


def description_from_text(text: Column, name: Column) -> Column:
    """Entry text without the first occurrence of its name, citations and leading marks."""
    at = F.instr(text, name)
    rest = F.when(
        at > 0,
        F.concat(
            F.substring(text, F.lit(1), at - 1),
            F.substring(text, at + F.length(name), F.length(text)),
        ),
    ).otherwise(text)
    return F.ltrim(drop_citations(strip(rest)), F.lit(LEADING_MARKS))
