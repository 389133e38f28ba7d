"""Markup text to an ordered token array, its nesting, and lookups on the result.

A page stays one row: tokenising, nesting and text lookups are per-row work on arrays, so
a page table of any size is parsed without a shuffle and without a page key. Only the tag
nesting needs a running stack, which no built-in expression has; that one fold is a small
Arrow-batched function over the tag names.
"""

from __future__ import annotations

import html.entities
import json
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayloom.functions.binding import let

# Comments and the elements whose content is not page text. All begin with the same character, so
# that other places are passed over quickly.
HIDDEN = (
    r"(?s)<(?:!--.*?-->"
    r"|[sS](?:(?i:cript)\b[^>]*>.*?</(?i:script)\s*>"
    r"|(?i:tyle)\b[^>]*>.*?</(?i:style)\s*>))"
)

# One tag and the text up to the next one: (name with its slash)(attributes)(text).
# ``>`` may occur inside quoted attribute values, a stray ``<`` inside text.
# Runs of plain characters are taken at once, with a group only where one of the others follows.
TOKEN = (
    r"<(/?[a-zA-Z][^ \t\n\x0B\f\r/>]*+)"
    r"([^>=]*+(?:=(?:\s*+(?:\"[^\"]*+\"|'[^']*+'))?+[^>=]*+)*+)>"
    r"([^<]*+(?:<(?![/a-zA-Z!?])[^<]*+)*+)"
)

# Elements that never have content.
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr "
    "basefont bgsound command frame image isindex keygen menuitem nextid spacer".split()
)


def visible(markup: Column) -> Column:
    """Markup without comments, scripts and styles."""
    return F.regexp_replace(markup, HIDDEN, "")


def token_parts(shown: Column) -> dict[str, Column]:
    """Three arrays in document order, one entry per tag: name with its slash, attributes, and
    the text up to the next tag."""
    return {
        name: F.regexp_extract_all(shown, F.lit(TOKEN), F.lit(group))
        for group, name in enumerate(("tags", "attrs", "txts"), start=1)
    }


def tag_names(tags: Column, attrs: Column) -> Column:
    """Lower-case names; closing tags start with ``/``, tags that close themselves end with it."""
    return F.zip_with(
        tags,
        attrs,
        lambda tag, rest: F.concat(
            F.lower(tag), F.when(F.endswith(rest, F.lit("/")), "/").otherwise("")
        ),
    )


def _nest(sequence: str | None) -> np.ndarray:
    tags = sequence.split(" ") if sequence else []
    parents, ends = [-1] * len(tags), list(range(len(tags)))
    open_at: list[int] = []
    open_names: dict[str, int] = {}

    def close_top(at: int) -> str:
        start = open_at.pop()
        ends[start] = at
        open_names[tags[start]] -= 1
        return tags[start]

    for at, tag in enumerate(tags):
        if tag.startswith("/"):
            name = tag.strip("/")
            # Closing a tag also closes whatever was left open inside it; a closing tag
            # without an open partner means nothing.
            while open_names.get(name) and close_top(at) != name:
                pass
            continue
        parents[at] = open_at[-1] if open_at else -1
        if not tag.endswith("/") and tag not in VOID_TAGS:
            open_at.append(at)
            open_names[tag] = open_names.get(tag, 0) + 1
    while open_at:
        close_top(len(tags))
    return np.array(parents + ends, dtype=np.int32)


# Ship the fold with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def nesting(sequences: pd.Series) -> pd.Series:
    """From the tag names of a page, joined by blanks: for n tokens first the n ordinals of the
    elements around them (-1 at the top), then the n ordinals of the tokens that end them.
    Elements left open end with the element around them."""
    return sequences.map(_nest)


# --- entities ---------------------------------------------------------------------------

_REFERENCE = "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);?"
_COMMON = {name: chr(code) for name, code in html.entities.name2codepoint.items()} | {"apos": "'"}
_NAMED_JSON = json.dumps(_COMMON)
# The names that only the current standard has; looked up after the common ones.
_RARE_JSON = json.dumps(
    {
        name.removesuffix(";"): text
        for name, text in html.entities.html5.items()
        if name.endswith(";") and name.removesuffix(";") not in _COMMON
    }
)
# Numbers 0x80 to 0x9F stand for what Windows-1252 has there, where it has something.
_WINDOWS_JSON = json.dumps(
    {
        str(code): bytes([code]).decode("cp1252")
        for code in range(0x80, 0xA0)
        if bytes([code]).decode("cp1252", "ignore")
    }
)


def decode_entities(text: Column) -> Column:
    """Named and numeric character references to characters; unknown ones stay as they are.

    Each reference is decoded once, so ``&amp;lt;`` becomes ``&lt;``.
    """
    # One JSON literal, folded once, keeps the expression small where it is used often.
    named, rare, windows = (
        F.from_json(F.lit(names), "map<string,string>")
        for names in (_NAMED_JSON, _RARE_JSON, _WINDOWS_JSON)
    )

    def character(body: Column) -> Column:
        code = (
            F.when(body.rlike("^#[xX]"), F.conv(F.substring(body, 3, 6), 16, 10))
            .when(body.startswith("#"), F.substring(body, 2, 7))
            .try_cast("bigint")
        )
        numeric = let(
            code,
            lambda c: F.coalesce(
                F.when(c.between(0x80, 0x9F), F.try_element_at(windows, c.cast("string"))),
                F.when(
                    c.between(1, 0x10FFFF) & ~c.between(0xD800, 0xDFFF),
                    F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32"),
                ),
            ),
        )
        by_name = F.coalesce(F.try_element_at(named, body), F.try_element_at(rare, body))
        return F.when(body.startswith("#"), numeric).otherwise(by_name)

    def reference(piece: Column) -> Column:
        body = F.regexp_extract(piece, _REFERENCE, 1)
        length = F.length(F.regexp_extract(piece, _REFERENCE, 0))
        rest = F.substring(piece, length + 1, F.length(piece))
        return F.coalesce(F.concat(let(body, character), rest), F.concat(F.lit("&"), piece))

    def decoded(pieces: Column) -> Column:
        tail = F.slice(pieces, F.lit(2), F.size(pieces))
        return F.concat(F.get(pieces, 0), F.array_join(F.transform(tail, reference), ""))

    return F.when(F.contains(text, F.lit("&")), let(F.split(text, "&"), decoded)).otherwise(text)


# --- attributes -------------------------------------------------------------------------


def attribute(attrs: Column, name: str) -> Column:
    """Value of an attribute as written, ``""`` if it is absent or empty."""
    pattern = rf"(?is)(?:^|[\s\"'/]){name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"
    value = let(
        F.regexp_extract(attrs, pattern, 1),
        lambda v: F.when(
            F.left(v, F.lit(1)).isin("'", '"'), F.substring(v, F.lit(2), F.length(v) - 2)
        ).otherwise(v),
    )
    return F.when(F.contains(F.lower(attrs), F.lit(name)), value).otherwise("")


def has_class(attrs: Column, name: str) -> Column:
    """True if ``name`` is one of the element's classes."""
    classes = F.translate(attribute(attrs, "class"), "\t\n\r\f", "    ")
    spaced = F.concat(F.lit(" "), classes, F.lit(" "))
    return F.contains(attrs, F.lit(name)) & F.contains(spaced, F.lit(f" {name} "))
