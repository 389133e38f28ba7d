"""Page to destination record, and record to warehouse row.

Every field rule reads only its own page, so the whole extraction runs inside the scan
stage: no page key, no shuffle, and no group that a hot key could fill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.functions import html
from wayloom.functions.binding import let
from wayloom.functions.classify import (
    class_of_lowered,
    contains_any,
    description_from_text,
    name_from_text,
)
from wayloom.functions.parse import (
    absolute_url,
    drop_citations,
    parse_coordinates,
    parse_population,
    split_list,
    strip,
)
from wayloom.operators.elements import (
    NODES,
    TEXTS,
    first_node,
    inner_nodes,
    node_at,
    node_text,
    parse_pages,
)
from wayloom.schemas import ATTRACTION, DESTINATIONS_TABLE
from wayloom.session import spread

# Markers looked for in a page.
CLIMATE_IDS = ("Climate", "Geography_and_climate", "Weather", "Environment")
ATTRACTION_IDS = (
    "Attractions",
    "Tourism",
    "Landmarks",
    "Sights",
    "Tourist_attractions",
    "Places_of_interest",
    "Main_sights",
    "Notable_attractions",
    "Points_of_interest",
)
NON_CONTENT_TITLES = ("References", "External links", "See also", "Notes")
NON_LIST_TITLES = NON_CONTENT_TITLES + ("Bibliography",)
LIST_KEYWORDS = (
    "museum",
    "monument",
    "park",
    "palace",
    "castle",
    "cathedral",
    "temple",
    "landmark",
    "attraction",
    "garden",
    "square",
    "tower",
)
BLOCK_TAGS = ("p", "td", "tr", "th", "h2", "h3")
MIN_PARAGRAPH = 50
MIN_NAME = 3


def _no_items() -> Column:
    return F.array().cast(f"array<{ATTRACTION.simpleString()}>")



def available(pages: DataFrame) -> DataFrame:
    """Pages that were fetched; error responses and absent bodies are left out."""
    return pages.where(F.col("content").isNotNull() & (F.col("status_code") < 400))


def extract_destinations(
    pages: DataFrame,
    name: str = "destination_name",
    markup: str = "content",
    partitions: int | None = None,
) -> DataFrame:
    """One record per page: name and ten extracted fields; ``partitions`` deals few files over
    tasks."""
    texts = pages.select(F.col(name).alias("destination_name"), F.col(markup).alias("_markup"))
    parsed = parse_pages(spread(texts, partitions), "_markup")
    # What most rules look for is a small part of a page's nodes, which is picked out once.
    picked = F.filter(F.col(NODES), lambda n: n["tag"].isin(*BLOCK_TAGS))
    box = parsed.withColumns(
        {"_blocks": picked, "_box": first_node(F.col(NODES), _is_class("infobox"))}
    )
    # Header cells and span anchors are read by several rules: their texts are joined once.
    marked = box.withColumns({"_headers": _box_headers(), "_anchors": _anchors()})
    fields = marked.withColumn("_headings", _headings()).select(
        "destination_name",
        description().alias("description"),
        let(node_text(first_node(F.col(NODES), _is_class("geo"))), parse_coordinates).alias(
            "coordinates"
        ),
        infobox_value("Country", "Location").alias("country"),
        population().alias("population"),
        infobox_value("Time zone").alias("timezone"),
        languages().alias("languages"),
        climate().alias("climate"),
        main_image().alias("image_url"),
        section_titles().alias("sections"),
        section_items().alias("_named"),
        "_headings",
        NODES,
        TEXTS,
    )
    # Lists anywhere in the page count only where no named section gave an item.
    found = F.when(F.size("_named") > 0, F.col("_named")).otherwise(keyword_list_items())
    return (
        fields.withColumn("_found", found)
        .withColumn("attractions", keep_first_by_name(F.col("_found")))
        .drop("_named", "_found", "_headings", NODES, TEXTS)
    )


def to_warehouse(records: DataFrame, ingested_at: Column | None = None) -> DataFrame:
    """Flatten records into the 17 declared columns; absent fields get their defaults."""
    have = set(records.columns)

    def text(field: str) -> Column:
        return F.coalesce(F.col(field), F.lit("")) if field in have else F.lit("")

    def nested(path: str) -> Column:
        return F.col(path) if path.split(".")[0] in have else F.lit(None)

    def array(field: str, kind: str) -> Column:
        empty = F.array().cast(f"array<{kind}>")
        return F.coalesce(F.col(field), empty) if field in have else empty

    item = ATTRACTION.simpleString()
    stamp = F.current_timestamp() if ingested_at is None else ingested_at
    if "ingestion_timestamp" in have:
        stamp = F.coalesce(F.col("ingestion_timestamp"), stamp)
    values = {
        "destination_name": text("destination_name"),
        "description": text("description"),
        "country": text("country"),
        "latitude": nested("coordinates.latitude"),
        "longitude": nested("coordinates.longitude"),
        "population_count": nested("population.count"),
        "population_year": nested("population.year"),
        "timezone": text("timezone"),
        "languages": F.to_json(array("languages", "string")),
        "climate": text("climate"),
        "image_url": text("image_url"),
        "sections": F.to_json(array("sections", "string")),
        # Nothing extracts an area or a region yet; the table keeps the columns.
        "area_km2": nested("area.km2"),
        "region": text("region"),
        "attractions_count": F.size(array("attractions", item)),
        "attractions": F.to_json(array("attractions", item)),
        "ingestion_timestamp": stamp,
    }
    return records.select(
        *[values[f.name].cast(f.dataType).alias(f.name) for f in DESTINATIONS_TABLE.fields]
    )


# --- single fields ----------------------------------------------------------------------


def _is_class(name: str):
    return lambda n: html.has_class(n["attrs"], name)


def _boxed(node: Column) -> Column:
    return (node["ord"] > F.col("_box.ord")) & (node["ord"] < F.col("_box.end"))


def _or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def description() -> Column:
    """First paragraph directly below a block of the content area, unless marked empty."""

    def matches(n: Column) -> Column:
        block = node_at(n["parent"])
        area = node_at(block["parent"])
        return (
            (n["tag"] == "p")
            & (block["tag"] == "div")
            & (html.attribute(area["attrs"], "id") == "mw-content-text")
            & ~html.has_class(n["attrs"], "mw-empty-elt")
        )

    found = first_node(F.col("_blocks"), matches)
    return _or_empty(strip(drop_citations(node_text(found))))


def _box_headers() -> Column:
    cells = F.filter(F.col("_blocks"), lambda n: (n["tag"] == "th") & _boxed(n))
    return F.transform(cells, lambda n: F.struct(n["ord"].alias("ord"), node_text(n).alias("text")))


def _anchors() -> Column:
    spans = F.filter(
        F.col(NODES), lambda n: (n["tag"] == "span") | F.contains(n["attrs"], F.lit("mw-headline"))
    )
    return F.transform(
        spans,
        lambda n: F.struct(
            n["ord"].alias("ord"),
            n["parent"].alias("parent"),
            F.when(n["tag"] == "span", html.attribute(n["attrs"], "id")).alias("id"),
            html.has_class(n["attrs"], "mw-headline").alias("headline"),
            node_text(n).alias("text"),
        ),
    )


def _box_header(*labels: str) -> Column:
    """Ordinal of the first header of the box that mentions one of the labels."""
    return first_node(F.col("_headers"), lambda h: contains_any(h["text"], labels))["ord"]


def _next(tag: str, after: Column) -> Column:
    """Next element of this name, one of ``BLOCK_TAGS``, after a position, wherever it is nested."""
    return let(
        after,
        lambda at: first_node(F.col("_blocks"), lambda n: (n["tag"] == tag) & (n["ord"] > at)),
    )


def infobox_value(*labels: str) -> Column:
    """Cell after the first header of the box that mentions one of the labels."""
    return _or_empty(strip(node_text(_next("td", _box_header(*labels)))))


def population() -> Column:
    """Read from the first cell of the row after the header's."""
    row = _next("tr", _box_header("Population"))
    cell = first_node(inner_nodes(row), lambda n: n["tag"] == "td")
    return let(strip(node_text(cell)), parse_population)


def languages() -> Column:
    return split_list(infobox_value("Language", "Official language"))


def climate() -> Column:
    anchor = first_node(F.col("_anchors"), lambda a: a["id"].isin(*CLIMATE_IDS))
    paragraph = _next("p", anchor["parent"])
    return _or_empty(strip(drop_citations(node_text(paragraph))))


def main_image() -> Column:
    def framed(inner: Column) -> Column:
        return let(
            F.filter(inner, _is_class("image")),
            lambda frames: first_node(
                inner,
                lambda n: n["tag"].isin("img", "img/")
                & F.exists(frames, lambda f: (n["ord"] > f["ord"]) & (n["ord"] < f["end"])),
            ),
        )

    return _image_source(let(inner_nodes(F.col("_box")), framed))


def _image_source(image: Column) -> Column:
    source = html.decode_entities(html.attribute(image["attrs"], "src"))
    return _or_empty(let(source, absolute_url))


def _headline(heading: Column) -> Column:
    """Text of the first headline inside a heading; NULL if it has none."""
    inside = first_node(
        F.col("_anchors"),
        lambda a: a["headline"]
        & a["id"].isNotNull()
        & (a["ord"] > heading["ord"])
        & (a["ord"] < heading["end"]),
    )
    return strip(inside["text"])


def _headings() -> Column:
    """Headings with the text of their headline, NULL where they have none."""
    return F.transform(
        F.filter(F.col("_blocks"), lambda n: n["tag"].isin("h2", "h3")),
        lambda n: F.struct(n["ord"].alias("ord"), _headline(n).alias("title")),
    )


def section_titles() -> Column:
    # A missing headline is NULL and fails the test as well.
    return F.filter(
        F.transform(F.col("_headings"), lambda h: h["title"]),
        lambda title: ~title.isin(*NON_CONTENT_TITLES),
    )


# --- attractions ------------------------------------------------------------------------


def keep_first_by_name(items: Column) -> Column:
    """Drop later items whose name was seen before, ignoring case."""
    return let(
        F.transform(items, lambda item: F.lower(item["name"])),
        lambda names: F.filter(
            items, lambda item, at: F.array_position(names, F.get(names, at)) == at + 1
        ),
    )


def section_items() -> Column:
    """Items below the headings of the named sections, in the order of the names."""
    ids = F.array(*[F.lit(section) for section in ATTRACTION_IDS])

    def section(wanted: Column) -> Column:
        title = F.replace(wanted, F.lit("_"), F.lit(" "))
        anchor = first_node(
            F.col("_anchors"),
            lambda a: (a["id"] == wanted) | (a["headline"] & F.contains(a["text"], title)),
        )
        return let(node_at(anchor["parent"]), _below_heading)

    return F.flatten(F.transform(ids, lambda wanted: F.coalesce(section(wanted), _no_items())))


def _below_heading(heading: Column) -> Column:
    """Items from the lists and paragraphs beside a heading, up to the next h2, h3 or h4."""
    beside = F.filter(
        F.slice(F.col(NODES), heading["end"] + 1, F.size(NODES)),
        lambda n: (n["parent"] == heading["parent"])
        & n["tag"].isin("ul", "ol", "p", "h2", "h3", "h4"),
    )

    def before_stop(siblings: Column) -> Column:
        stop = first_node(siblings, lambda n: n["tag"].isin("h2", "h3", "h4"))["ord"]
        return let(
            F.coalesce(stop, F.size(NODES)),
            lambda end: F.filter(siblings, lambda n: n["ord"] < end),
        )

    return F.flatten(
        F.transform(
            let(beside, before_stop),
            lambda n: F.when(n["tag"] == "p", _bold_items(n)).otherwise(list_items(n)),
        )
    )


def _bold_items(paragraph: Column) -> Column:
    bolds = F.filter(inner_nodes(paragraph), lambda n: n["tag"] == "b")
    names = F.filter(
        F.transform(bolds, lambda b: strip(node_text(b))),
        lambda name: (F.length(name) > MIN_NAME) & (name != "edit"),
    )

    def items(text: Column) -> Column:
        named = F.transform(names, lambda name: _item(name, drop_citations(text), F.lit("")))
        return F.when(F.length(text) > MIN_PARAGRAPH, named).otherwise(_no_items())

    return let(strip(node_text(paragraph)), items)


def list_items(listing: Column) -> Column:
    """Items of a list's own entries; entries of lists nested in them are not looked at."""
    entries = F.filter(
        inner_nodes(listing), lambda n: (n["tag"] == "li") & (n["parent"] == listing["ord"])
    )
    named = F.filter(
        F.transform(F.transform(entries, _entry_parts), _named_entry),
        lambda entry: F.length(entry["name"]) > MIN_NAME,
    )
    return F.transform(
        named,
        lambda e: _item(e["name"], description_from_text(e["text"], e["name"]), e["image"]),
    )


def _entry_parts(entry: Column) -> Column:
    """Text of an entry and of the first bold and link in it; image address."""

    def first_text(inner: Column, tag: str) -> Column:
        return strip(node_text(first_node(inner, lambda n: n["tag"] == tag)))

    return let(
        inner_nodes(entry),
        lambda inner: F.struct(
            node_text(entry).alias("text"),
            first_text(inner, "b").alias("bold"),
            first_text(inner, "a").alias("link"),
            _image_source(first_node(inner, lambda n: n["tag"].isin("img", "img/"))).alias("image"),
        ),
    )


def _named_entry(parts: Column) -> Column:
    # A bold or link that is present but empty still decides the name.
    markup_name = F.coalesce(parts["bold"], parts["link"])
    plain = let(strip(parts["text"]), name_from_text)
    return F.struct(
        parts["text"].alias("text"),
        parts["image"].alias("image"),
        drop_citations(F.coalesce(markup_name, plain)).alias("name"),
    )


def _item(name: Column, text: Column, image: Column) -> Column:
    return F.struct(
        name.alias("name"),
        text.alias("description"),
        image.alias("image_url"),
        let(F.lower(name), lambda lowered: class_of_lowered(lowered)).alias("type"),
    )


def keyword_list_items() -> Column:
    """Items of every list that mentions a keyword and has several entries, except below the
    headings that only announce references."""

    def misplaced(n: Column) -> Column:
        earlier = F.filter(F.col("_headings"), lambda h: h["ord"] < n["ord"])
        title = let(earlier, lambda hs: F.get(hs, F.size(hs) - 1)["title"])
        return F.coalesce(title.isin(*NON_LIST_TITLES), F.lit(False))

    def eligible(n: Column) -> Column:
        entries = F.filter(inner_nodes(n), lambda e: e["tag"] == "li")
        return (
            n["tag"].isin("ul", "ol")
            & ~misplaced(n)
            & let(F.lower(node_text(n)), lambda text: contains_any(text, LIST_KEYWORDS))
            & (F.size(entries) > 1)
        )

    return F.flatten(F.transform(F.filter(F.col(NODES), eligible), list_items))
