import html as stdlib_html
from html.parser import HTMLParser

import fixtures_html as fx
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayloom.functions import html
from wayloom.operators import elements as el
from wayloom.plans import destinations
from wayloom.schemas import DESTINATIONS_TABLE
from wayloom.suite import pages as suite

PAGE = "destination_name string, content string"


def extract(spark, markup):
    frame = spark.createDataFrame([("X", markup)], PAGE)
    return destinations.extract_destinations(frame).first()


def test_full_page(spark):
    record = extract(spark, fx.FULL)
    assert record["destination_name"] == "X"
    assert record["description"].startswith("Lower Quandary is a harbour town of ferries, kilns & tide mills, set")
    assert record["description"].endswith("Its quay is 1.2\xa0km long, or 122 boats.")
    assert tuple(record["coordinates"]) == (-12.5, 131.25)
    assert record["country"] == "Vell Coast[2]"
    assert tuple(record["population"]) == (41207, 2019)
    assert record["timezone"] == "UTC+09:30"
    assert record["languages"] == ["Vellish", "Old Vellish", "Trade Pidgin"]
    assert record["climate"] == "Sea fog most mornings; dry winds from the salt flats in the long season."
    assert record["image_url"] == "https://pics.example/quay.jpg?w=320&h=200"
    assert record["sections"] == ["Landmarks", "Weather"]
    assert [(a["name"], a["description"], a["type"], a["image_url"]) for a in record["attractions"]] == [
        ("Kiln Museum", "six bottle kilns in a row", "museum", ""),
        ("Wren Garden", "moss and ferns", "park", ""),
        ("Salt Tower", "a lookout of 1790", "building", "/t.png"),
    ]


def test_population_in_the_first_cell(spark):
    box = (
        '<table class="infobox"><tr><th>Population</th></tr>'
        "<tr><td>8,804,190 (2020)</td></tr></table>"
    )
    assert tuple(extract(spark, box)["population"]) == (8804190, 2020)


def test_empty_page(spark):
    record = extract(spark, fx.EMPTY)
    assert record["destination_name"] == "X"
    assert record["description"] == record["country"] == record["climate"] == ""
    assert record["languages"] == record["sections"] == record["attractions"] == []


def test_description_needs_the_exact_nesting(spark):
    page = '<div id="mw-content-text"><p>no</p><section><p>no</p></section><div><b><p>no</p></b><p>yes</p></div></div>'
    assert extract(spark, page)["description"] == "yes"


def test_sections_stop_and_paragraph_bolds(spark):
    long_text = "This paragraph says enough about the place to be considered at all"
    page = f"""<div><h2><span class="mw-headline" id="Landmarks">Landmarks</span></h2>
    <p>{long_text}: <b>Grand Bridge</b>, <b>edit</b>, <b>abc</b>.[1]</p>
    <div><ul><li>Not beside it</li></ul></div>
    <ol><li><b></b><a>Linked name</a></li><li><a>grand bridge</a></li>
    <li>Tower <img src="//i/t.png"> view</li></ol>
    <h4>stop</h4><ul><li>After the stop</li></ul></div>"""
    found = extract(spark, page)["attractions"]
    assert [(a["name"], a["type"], a["image_url"]) for a in found] == [
        ("Grand Bridge", "bridge", ""),
        ("Tower  view", "building", "https://i/t.png"),
    ]
    assert found[0]["description"] == f"{long_text}: Grand Bridge, edit, abc."


def test_fallback_lists(spark):
    page = """<h2><span class="mw-headline">History</span></h2>
    <ul><li>Castle Rock: old</li><li>Second entry</li></ul><ul><li>Only one museum</li></ul>
    <h2><span class="mw-headline">References</span></h2><ul><li>Some park</li><li>Other</li></ul>"""
    found = extract(spark, page)["attractions"]
    assert [(a["name"], a["description"]) for a in found] == [
        ("Castle Rock", "old"),
        ("Second entry", ""),
    ]


def test_warehouse_shape(spark):
    records = destinations.extract_destinations(spark.createDataFrame([("X", fx.FULL)], PAGE))
    table = destinations.to_warehouse(records)
    assert [(f.name, f.dataType) for f in table.schema] == [
        (f.name, f.dataType) for f in DESTINATIONS_TABLE
    ]
    row = table.first()
    assert row["attractions_count"] == 3 and row["area_km2"] is None and row["region"] == ""
    bare = destinations.to_warehouse(spark.createDataFrame([("Y",)], "destination_name string"))
    row = bare.first()
    assert (row["description"], row["languages"], row["attractions_count"]) == ("", "[]", 0)


def test_failed_pages_are_left_out(spark):
    pages = spark.createDataFrame(
        [("a", 200, "x"), ("b", 404, "x"), ("c", 500, None), ("d", None, None)],
        "destination_name string, status_code int, content string",
    )
    assert [r[0] for r in destinations.available(pages).select("destination_name").collect()] == ["a"]


# --- markup -----------------------------------------------------------------------------


class Tree(HTMLParser):
    """Independent nesting: a tree of parser callbacks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes, self.stack, self.at = [], [], -1

    def handle_starttag(self, tag, attrs):
        self.at += 1
        parent = self.stack[-1][1] if self.stack else -1
        self.nodes.append([tag, self.at, None, parent, ""])
        if tag in html.VOID_TAGS:
            self.nodes[-1][2] = self.at
        else:
            self.stack.append((tag, self.at, len(self.nodes) - 1))

    def handle_startendtag(self, tag, attrs):
        self.at += 1
        parent = self.stack[-1][1] if self.stack else -1
        self.nodes.append([tag, self.at, self.at, parent, ""])

    def handle_endtag(self, tag):
        self.at += 1
        if tag in [t for t, _, _ in self.stack]:
            while True:
                name, _, index = self.stack.pop()
                self.nodes[index][2] = self.at
                if name == tag:
                    break

    def handle_data(self, data):
        for _, _, index in self.stack:
            self.nodes[index][4] += data

    def result(self, markup):
        self.feed(markup)
        self.close()
        return [tuple(n[:2]) + (self.at + 1 if n[2] is None else n[2], n[3], n[4]) for n in self.nodes]


pieces = st.sampled_from(
    ["<p>", "</p>", "<b>", "</b>", "<div class='a > b'>", "</div>", "<br>", "<br/>", "<li>", "</li>",
     "<i/>", "text", " 1 < 2 ", "&amp;", "&eacute;x", "&#8211;", "<!-- <p> -->", "é\n"]
)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(pieces, max_size=25), min_size=20, max_size=20))
def test_nesting_agrees_with_a_tree_builder(spark, documents):
    markups = ["<html>" + "".join(parts) + "</x>" for parts in documents]
    frame = spark.createDataFrame(list(enumerate(markups)), "id int, html string")
    rows = el.elements(frame, ["id"]).collect()
    for i, markup in enumerate(markups):
        found = sorted(
            (r["ord"], r["tag"], r["end_ord"], r["parent"], r["text"]) for r in rows if r["id"] == i
        )
        wanted = [(o, t, e, p, x) for t, o, e, p, x in Tree().result(markup)]
        assert found == sorted(wanted), markup


def test_hidden_parts_and_odd_attributes(spark):
    page = '<P Class=\'x\'>a<script>"<p>"</script>b<style>p{}</style><img alt="1 > 0" src=/i.png>c</P>'
    rows = el.elements(spark.createDataFrame([(1, page)], "id int, html string"), ["id"]).collect()
    assert [(r["tag"], r["text"]) for r in rows] == [("p", "abc"), ("img", "")]
    frame = spark.createDataFrame([(r["attrs"],) for r in rows], "a string")
    got = frame.select(
        html.attribute(F.col("a"), "src").alias("s"), html.has_class(F.col("a"), "x").alias("c")
    ).collect()
    assert [tuple(r) for r in got] == [("", True), ("/i.png", False)]


@pytest.mark.parametrize(
    "text",
    ["a &amp; b", "&lt;p&gt;", "&amp;lt;", "&eacute;&Eacute;", "&#8211;&#x2013;", "&#128512;",
     "no reference", "a&b", "&", "&;", "x &unknownname; y", "&amp", "caf&eacute"],
)
def test_entities(one, text):
    assert one(html.decode_entities, text) == stdlib_html.unescape(text)


def test_a_page_without_tags(spark):
    frame = spark.createDataFrame([(1, "plain"), (2, ""), (3, None)], "id int, html string")
    assert el.elements(frame, ["id"]).count() == 0


def test_find_next_and_containment(spark):
    page = "<ul><li><a>1</a></li></ul><p>x</p><a>2</a><p>y</p>"
    frame = el.elements(spark.createDataFrame([(1, page)], "id int, html string"), ["id"])
    after = el.find_next(frame, ["id"], F.col("tag") == "p", F.col("text"), "next_p")
    assert [r["next_p"] for r in after.orderBy("ord").collect()] == ["x", "x", "x", "y", "y", None]
    marked = el.mark_inside(frame, ["id"], F.col("tag") == "li", "listed")
    assert [r["text"] for r in marked.where("listed").collect()] == ["1"]
    lists = frame.where("tag = 'ul'").select("id", "ord", "end_ord")
    assert sorted(r["tag"] for r in el.inside(frame, lists, ["id"]).collect()) == ["a", "li"]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(pieces, max_size=25), min_size=20, max_size=20))
def test_sweeps_in_the_row_agree_with_windows(spark, documents):
    markups = ["".join(parts) for parts in documents]
    frame = spark.createDataFrame(list(enumerate(markups)), "id int, html string")
    flat, kinds = el.elements(frame, ["id"], tags=["p", "b", "li", "div"]), ["b", "li"]
    page = el.parse_pages(frame)
    kind = lambda n: n["tag"].isin(kinds)
    inside = page.select("id", F.inline(el.nodes_inside(lambda n: n["tag"] == "div", kind)))
    marked = el.mark_inside(flat, ["id"], F.col("tag") == "div", "held").where(F.col("held") & F.col("tag").isin(kinds))
    places = lambda found: sorted((r["id"], r["ord"]) for r in found.collect())
    assert places(inside) == places(marked)
    followed = page.select("id", F.inline(el.nodes_before_next(kind, lambda n: n["tag"] == "p")))
    after = el.find_next(flat, ["id"], F.col("tag") == "p", F.col("ord"), "n").where(F.col("tag").isin(kinds))
    assert sorted(
        (r["id"], r["node"]["ord"], r["next"]["ord"] if r["next"] else -1) for r in followed.collect()
    ) == sorted((r["id"], r["ord"], -1 if r["n"] is None else r["n"]) for r in after.collect())


@pytest.mark.parametrize("name", ["page_titles", "page_first_paragraph", "page_links", "page_next_match"])
def test_sweeps_need_no_shuffle(spark, name):
    plan = suite.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # One only: the pages are dealt over the cores before they are parsed.
    assert plan.count("Exchange") == plan.count("Exchange RoundRobinPartitioning") == 1
    assert "Window" not in plan and "Join" not in plan
