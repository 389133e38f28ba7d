"""Page parsing and destination records on the given tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.functions import html
from wayloom.functions.classify import description_from_text, name_from_text
from wayloom.functions.parse import strip
from wayloom.operators import elements as el
from wayloom.plans import destinations
from wayloom.session import spread
from wayloom.suite.inputs import cores, table

# --- the given pages --------------------------------------------------------------------

# References that occur in the pages; the closing semicolon may be missing.
SQL_DECODED = "raw"
for _name, _char in (
    ("&copy", "©"),
    ("&middot", "·"),
    ("&quot", '"'),
    ("&#x27", "''"),
    ("&lt", "<"),
    ("&gt", ">"),
    ("&amp", "&"),
):
    SQL_DECODED = f"regexp_replace({SQL_DECODED}, '{_name};?', '{_char}', 'g')"

# The same grammar in DuckDB's regex dialect, which has no possessive repeats.
SQL_TOKENS = r"""
shown AS (SELECT page_id, regexp_replace(html,
    '(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', '', 'g') AS h
    FROM pages),
found AS (SELECT page_id,
    regexp_extract_all(h, RX, 1) AS tags, regexp_extract_all(h, RX, 2) AS attrs,
    regexp_extract_all(h, RX, 3) AS txts FROM shown),
raw_tokens AS (SELECT page_id, unnest(range(len(tags))) AS ord, lower(unnest(tags)) AS tag,
    unnest(attrs) AS attrs, unnest(txts) AS raw FROM found),
tokens AS (SELECT page_id, CAST(ord AS INTEGER) AS ord, tag, attrs,
    TXT AS txt
    FROM raw_tokens)""".replace("TXT", SQL_DECODED).replace(
    "RX",
    r"""'<(/?[a-zA-Z][^\s/>]*)((?:[^>=]|=\s*"[^"]*"|=\s*''[^'']*''|=)*)>((?:[^<]|<[^/a-zA-Z!?])*)'""",
)

# Nesting by walking the tokens in order with an explicit stack.
SQL_NODES = (
    "RECURSIVE "
    + SQL_TOKENS.strip()
    + r""",
walk AS (
    SELECT page_id, -1 AS ord, CAST(NULL AS VARCHAR) AS tag, -1 AS parent,
           []::STRUCT(tag VARCHAR, ord INTEGER)[] AS stack, []::INTEGER[] AS popped FROM pages
    UNION ALL
    SELECT page_id, ord, tag, parent,
           CASE WHEN tag[1] = '/' THEN CASE WHEN k > 0 THEN stack[1:k - 1] ELSE stack END
                WHEN tag IN ('br', 'img', 'meta', 'link', 'hr', 'input') THEN stack
                ELSE list_append(stack, {'tag': tag, 'ord': ord}) END,
           CASE WHEN tag[1] = '/' AND k > 0 THEN list_transform(stack[k:], lambda s: s.ord) ELSE [] END
    FROM (SELECT w.page_id, t.ord, t.tag, w.stack,
                 CASE WHEN t.tag[1] = '/' OR len(w.stack) = 0 THEN -1 ELSE w.stack[-1].ord END AS parent,
                 coalesce(list_max([i FOR i IN range(1, len(w.stack) + 1)
                                    IF w.stack[i].tag = t.tag[2:]]), 0) AS k
          FROM walk w JOIN tokens t ON t.page_id = w.page_id AND t.ord = w.ord + 1)),
closed AS (SELECT page_id, unnest(popped) AS ord, ord AS end_ord FROM walk),
sizes AS (SELECT page_id, CAST(count(*) AS INTEGER) AS n FROM tokens GROUP BY 1),
nodes AS (SELECT w.page_id, w.ord, w.parent, w.tag, CAST(CASE
        WHEN w.tag IN ('br', 'img', 'meta', 'link', 'hr', 'input') THEN w.ord
        ELSE coalesce(c.end_ord, s.n) END AS INTEGER) AS end_ord
    FROM walk w JOIN sizes s ON s.page_id = w.page_id
         LEFT JOIN closed c ON c.page_id = w.page_id AND c.ord = w.ord
    WHERE w.ord >= 0 AND w.tag[1] <> '/')"""
)
# Text of nodes: the token texts of their span.
SQL_TEXT = """(SELECT string_agg(x.txt, '' ORDER BY x.ord) FROM tokens x
    WHERE x.page_id = n.page_id AND x.ord >= n.ord AND x.ord < n.end_ord)"""


def _elements(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Elements of the given pages. ``doc`` tells rows apart whose page id is the same, so that a
    page fetched many times is many small groups and not one."""
    pages = table(spark, folder, "pages").withColumn("doc", F.monotonically_increasing_id())
    return el.elements(pages, KEYS, **options, partitions=cores(spark))


KEYS = ["page_id", "doc"]


def page_tokens(spark: SparkSession, folder: str) -> DataFrame:
    tokens = el.tokenise(table(spark, folder, "pages").select("page_id", "html"))
    numbered = F.arrays_zip("tags", "txts")
    return tokens.select("page_id", F.posexplode(numbered).alias("ord", "t")).select(
        "page_id", "ord", F.col("t.tags").alias("tag"), F.col("t.txts").alias("txt")
    )


SQL_PAGE_TOKENS = f"WITH {SQL_TOKENS} SELECT page_id, ord, tag, txt FROM tokens"


def page_elements(spark: SparkSession, folder: str) -> DataFrame:
    found = _elements(spark, folder, with_text=False)
    return found.select("page_id", "ord", "end_ord", "parent", "tag")


SQL_PAGE_ELEMENTS = f"WITH {SQL_NODES} SELECT page_id, ord, end_ord, parent, tag FROM nodes"


def _parsed(spark: SparkSession, folder: str) -> DataFrame:
    """The given pages as node arrays, a row for each."""
    pages = table(spark, folder, "pages").select("page_id", "html")
    return el.parse_pages(spread(pages, cores(spark)))


def page_titles(spark: SparkSession, folder: str) -> DataFrame:
    """First heading and title of every page that has one, found in the page's row."""

    def first(tag: str) -> Column:
        return el.node_text(el.first_node(F.col(el.NODES), lambda n: n["tag"] == tag)).alias(tag)

    # A filter on the texts would be pushed below and parse the page again for each use; a
    # generator is not crossed.
    found = F.array(F.struct(first("title"), first("h1")))
    found = F.filter(found, lambda r: r["title"].isNotNull() | r["h1"].isNotNull())
    return _parsed(spark, folder).select("page_id", F.inline(found))


SQL_PAGE_TITLES = f"""
WITH {SQL_NODES},
t AS (SELECT n.page_id, n.ord, n.tag, {SQL_TEXT} AS text FROM nodes n WHERE tag IN ('title', 'h1'))
SELECT page_id, min_by(text, ord) FILTER (tag = 'title') AS title,
       min_by(text, ord) FILTER (tag = 'h1') AS h1
FROM t GROUP BY 1"""


def page_links(spark: SparkSession, folder: str) -> DataFrame:
    """Links inside navigation blocks, by the slices of nodes that the blocks cover."""
    links = F.transform(
        el.nodes_inside(lambda n: n["tag"] == "nav", lambda n: n["tag"] == "a"),
        lambda n: F.struct(
            n["ord"].alias("ord"),
            html.attribute(n["attrs"], "href").alias("href"),
            el.node_text(n).alias("text"),
        ),
    )
    return _parsed(spark, folder).select("page_id", F.inline(links))


SQL_PAGE_LINKS = f"""
WITH {SQL_NODES}
SELECT n.page_id, n.ord, regexp_extract(t.attrs, 'href="([^"]*)"', 1) AS href, {SQL_TEXT} AS text
FROM nodes n JOIN tokens t USING (page_id, ord)
     JOIN nodes v ON v.page_id = n.page_id AND v.tag = 'nav' AND n.ord > v.ord AND n.ord < v.end_ord
WHERE n.tag = 'a'"""


def page_first_paragraph(spark: SparkSession, folder: str) -> DataFrame:
    """First paragraph that stands directly in an article, found in the page's row."""
    first = el.first_node(
        F.col(el.NODES), lambda n: (n["tag"] == "p") & (n["parent_tag"] == "article")
    )
    found = F.array(F.struct(strip(el.node_text(first)).alias("text")))
    found = F.filter(found, lambda r: r["text"].isNotNull())
    return _parsed(spark, folder).select("page_id", F.inline(found))


SQL_FIRST_PARAGRAPH = f"""
WITH {SQL_NODES}
SELECT n.page_id, trim({SQL_TEXT}, ' ' || chr(10)) AS text
FROM nodes n JOIN nodes a ON a.page_id = n.page_id AND a.ord = n.parent AND a.tag = 'article'
WHERE n.tag = 'p' QUALIFY row_number() OVER (PARTITION BY n.page_id ORDER BY n.ord) = 1"""


def page_list_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """How many elements of each kind every list and block holds, by a join on containment."""
    found = _elements(spark, folder, tags=["nav", "ul", "li", "a"], with_text=False)
    outer = found.where(F.col("tag").isin("nav", "ul")).select(*KEYS, "ord", "end_ord", "tag")
    pairs = el.inside(found, outer, KEYS)
    return pairs.groupBy("page_id", "outer_tag", "tag").agg(F.count("*").alias("elements"))


SQL_LIST_PAIRS = f"""
WITH {SQL_NODES}
SELECT n.page_id, v.tag AS outer_tag, n.tag, count(*) AS elements
FROM nodes n JOIN nodes v ON v.page_id = n.page_id AND n.ord > v.ord AND n.ord < v.end_ord
WHERE v.tag IN ('nav', 'ul') AND n.tag IN ('nav', 'ul', 'li', 'a') GROUP BY ALL"""


def page_list_items(spark: SparkSession, folder: str) -> DataFrame:
    found = _elements(spark, folder, tags=["li"])
    named = found.withColumn("name", name_from_text(strip(F.col("text"))))
    return named.select(
        "page_id",
        "ord",
        "name",
        description_from_text(F.col("text"), F.col("name")).alias("description"),
    )


SQL_LIST_ITEMS = f"""
WITH {SQL_NODES}
SELECT n.page_id, n.ord, {SQL_TEXT} AS name, '' AS description FROM nodes n WHERE tag = 'li'"""


def page_next_match(spark: SparkSession, folder: str) -> DataFrame:
    """For each link, heading and list: the next paragraph that starts after it."""
    matched = F.transform(
        el.nodes_before_next(lambda n: n["tag"].isin("h1", "a", "ul"), lambda n: n["tag"] == "p"),
        lambda m: F.struct(
            m["node"]["ord"].alias("ord"), m["node"]["tag"].alias("tag"), m["next"]["ord"].alias("next_p")
        ),
    )
    return _parsed(spark, folder).select("page_id", F.inline(matched))


SQL_NEXT_MATCH = f"""
WITH {SQL_NODES}
SELECT page_id, ord, tag, (SELECT min(p.ord) FROM nodes p
       WHERE p.page_id = n.page_id AND p.tag = 'p' AND p.ord > n.ord) AS next_p
FROM nodes n WHERE tag IN ('h1', 'a', 'ul')"""

# --- wiki-shaped pages made from customers ----------------------------------------------

TOWN = """<!DOCTYPE html><html><head><title>{name}</title><script>var a = "<p>no</p>";</script></head>
<body><div id="mw-content-text"><div class="mw-parser-output"><p class="mw-empty-elt">
</p><p> <b>{name}</b> trades in {segment} &amp; more.[1]
It owes &lt;{nation}&gt; nothing&#33;[23]</p><p>Second paragraph.</p>
<table class="infobox vcard"><tbody>
<tr><td class="image"><a href="/f"><img alt='x>y' src="//img/{key}.png?a=1&amp;b=2"/></a></td></tr>
<tr><th scope="row">{country_label}</th><td> {nation}
</td></tr><tr><th>Population</th></tr>{population}
<tr><th>Time zone</th><td>UTC+{nation_no}</td></tr>
<tr><th>Official languages</th><td>{region}, {segment}
English,,</td></tr></tbody></table>
<span class="geo dec">{position}</span>
<h3><span class="mw-headline" id="Weather">Weather</span></h3><p>Mild in {nation}.[4]</p>
{body}<h2><span class="mw-headline" id="See_also">See also</span></h2>
<ul><li>Some park elsewhere</li><li>Another garden</li></ul></div></div></body></html>"""

SIGHTS = """<h2><span class="mw-headline" id="Sights">Sights</span></h2>
<p>A short <b>Sign post</b>.</p>
<p>The skyline is ruled by <b>{nation} Tower</b>, seen from <b>abc</b> and far beyond.[5]</p>
<ul><li><b>{segment} Museum</b>: holds {key} pieces[7]</li>
<li><a href="/t">{nation} TOWER</a> again</li>
<li>Old Market - open daily<ul><li><b>Nested Bazaar</b></li></ul></li>
<li>tiny</li><li>abc</li><li>One two three four five six seven</li></ul>
<h4>More</h4><ul><li>Beyond the stop</li></ul>"""

HISTORY = """<h2><span class="mw-headline" id="History">History</span></h2>
<ul><li>Castle of {nation}: built long ago</li><li>Second – entry</li></ul>
<ol><li>Only one temple</li></ol>"""


def _fill(template: str, **values: Column) -> Column:
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(
        *[values[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts) if p]
    )


def wiki_pages(spark: SparkSession, folder: str) -> DataFrame:
    """One page per customer, with gaps and oddities by market segment."""
    joined = (
        spread(table(spark, folder, "customer"), cores(spark))
        .join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    segment = F.col("c_mktsegment")
    given = {
        "name": F.col("c_name"),
        "key": F.col("c_custkey"),
        "segment": segment,
        "nation": F.col("n_name"),
        "nation_no": F.col("n_nationkey"),
        "region": F.col("r_name"),
    }
    grouped = F.format_number(F.col("c_custkey") * 7919 + 1, 0)
    cell = F.concat(grouped, F.lit(" ("), F.col("c_nationkey") + 1990, F.lit(")"))
    latitude = (F.col("c_nationkey") * 3.25 - 40).cast("string")
    page = _fill(
        TOWN,
        **given,
        country_label=F.when(segment == "BUILDING", "Location of seat").otherwise("Country"),
        population=F.when(
            segment == "FURNITURE",
            F.concat(F.lit("<tr><td>• Total</td><td>"), cell, F.lit("</td></tr>")),
        ).otherwise(F.concat(F.lit("<tr><td>"), cell, F.lit("</td></tr>"))),
        position=F.when(segment == "HOUSEHOLD", latitude).otherwise(
            F.concat(latitude, F.lit("; "), F.col("c_custkey") / 4)
        ),
        body=F.when(segment == "MACHINERY", _fill(HISTORY, **given)).otherwise(
            _fill(SIGHTS, **given)
        ),
    )
    return joined.select(
        F.col("c_name").alias("destination_name"),
        F.lit(200).alias("status_code"),
        page.alias("content"),
    )


def destination_records(spark: SparkSession, folder: str) -> DataFrame:
    records = destinations.extract_destinations(wiki_pages(spark, folder), partitions=cores(spark))
    return destinations.to_warehouse(records, F.lit(None)).drop("ingestion_timestamp")


def _sql_items(*items: tuple[str, str, str]) -> str:
    """JSON text of (name, description, type) items given as SQL expressions."""
    parts = [
        f"""'{{"name":"' || {name} || '","description":"' || {text} || '","image_url":"","type":"{kind}"}}'"""
        for name, text, kind in items
    ]
    return "'[' || " + " || ',' || ".join(parts) + " || ']'"


SQL_SIGHT_ITEMS = _sql_items(
    (
        "n_name || ' Tower'",
        "'The skyline is ruled by ' || n_name || ' Tower, seen from abc and far beyond.'",
        "building",
    ),
    ("c_mktsegment || ' Museum'", "'holds ' || c_custkey || ' pieces'", "museum"),
    ("'Nested Bazaar'", "'Old Market - open daily'", "market"),
    ("'tiny'", "''", "landmark"),
    ("'One two three'", "'four five six seven'", "landmark"),
)
SQL_HISTORY_ITEMS = _sql_items(
    ("'Castle of ' || n_name", "'built long ago'", "palace"),
    ("'Second – entry'", "''", "landmark"),
)
SQL_DESTINATION_RECORDS = f"""
SELECT c_name AS destination_name,
       c_name || ' trades in ' || c_mktsegment || ' & more.' || chr(10) || 'It owes <' || n_name
            || '> nothing!' AS description,
       n_name AS country,
       CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN c_nationkey * 3.25::DOUBLE - 40 END AS latitude,
       CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN c_custkey / 4 END AS longitude,
       CASE WHEN c_mktsegment <> 'FURNITURE' THEN c_custkey * 7919 + 1 END AS population_count,
       CAST(CASE WHEN c_mktsegment <> 'FURNITURE' THEN c_nationkey + 1990 END AS BIGINT)
            AS population_year,
       'UTC+' || n_nationkey AS timezone,
       '["' || r_name || '","' || c_mktsegment || '","English"]' AS languages,
       'Mild in ' || n_name || '.' AS climate,
       'https://img/' || c_custkey || '.png?a=1&b=2' AS image_url,
       CASE WHEN c_mktsegment = 'MACHINERY' THEN '["Weather","History"]'
            ELSE '["Weather","Sights"]' END AS sections,
       CAST(NULL AS DOUBLE) AS area_km2, '' AS region,
       CAST(CASE WHEN c_mktsegment = 'MACHINERY' THEN 2 ELSE 5 END AS BIGINT) AS attractions_count,
       CASE WHEN c_mktsegment = 'MACHINERY' THEN {SQL_HISTORY_ITEMS} ELSE {SQL_SIGHT_ITEMS} END
            AS attractions
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def page_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the given pages, which have none of the wiki markers."""
    pages = table(spark, folder, "pages")
    records = destinations.extract_destinations(pages, "url", "html", cores(spark))
    return records.select(
        F.col("destination_name").alias("url"),
        "description",
        "country",
        F.size("sections").alias("sections"),
        F.size("attractions").alias("attractions"),
    )


# Only lists that mention a keyword count, and every name in them must be longer than three.
SQL_PAGE_RECORDS = f"""
WITH {SQL_NODES},
lists AS (SELECT n.page_id, n.ord, lower({SQL_TEXT}) AS text FROM nodes n WHERE tag IN ('ul', 'ol')),
hits AS (SELECT * FROM lists WHERE regexp_matches(text,
    'museum|monument|park|palace|castle|cathedral|temple|landmark|attraction|garden|square|tower')),
names AS (SELECT n.page_id, lower({SQL_TEXT}) AS name FROM nodes n
          JOIN hits h ON h.page_id = n.page_id AND h.ord = n.parent WHERE n.tag = 'li'),
counts AS (SELECT page_id, count(DISTINCT name) AS n FROM names WHERE length(name) > 3 GROUP BY 1)
SELECT url, '' AS description, '' AS country, CAST(0 AS INTEGER) AS sections,
       CAST(coalesce(n, 0) AS INTEGER) AS attractions
FROM pages LEFT JOIN counts USING (page_id)"""

QUERIES = {
    "page_tokens": page_tokens,
    "page_elements": page_elements,
    "page_titles": page_titles,
    "page_links": page_links,
    "page_first_paragraph": page_first_paragraph,
    "page_list_pairs": page_list_pairs,
    "page_list_items": page_list_items,
    "page_next_match": page_next_match,
    "page_records": page_records,
    "destination_records": destination_records,
}
ORACLES = {
    "page_tokens": SQL_PAGE_TOKENS,
    "page_elements": SQL_PAGE_ELEMENTS,
    "page_titles": SQL_PAGE_TITLES,
    "page_links": SQL_PAGE_LINKS,
    "page_first_paragraph": SQL_FIRST_PARAGRAPH,
    "page_list_pairs": SQL_LIST_PAIRS,
    "page_list_items": SQL_LIST_ITEMS,
    "page_next_match": SQL_NEXT_MATCH,
    "page_records": SQL_PAGE_RECORDS,
    "destination_records": SQL_DESTINATION_RECORDS,
}
