"""Main text of web pages, by structure and by differencing with the page of the nearest URL.

A page is cut into text lines at its block elements. Menus, page headers, footers, sidebars,
notices, adverts, forms, scripts, styles, hidden parts and reader comments are left out by element,
``role``, and the names in ``class`` and ``id``; a name leaves no element out that holds the page's
content. Then pages of one host are sorted by URL path,
each is paired with the neighbour whose path agrees with its own the longest, the lines of the two
are aligned by a longest common subsequence, and lines that both have are deleted as part of the
site's frame.

Two kinds of shared lines stay. Where a page marks its content with ``article`` or ``main``, the
text is what stands inside (all of ``main`` if its articles hold less than half of the words), and shared lines there are passages that two articles have in common.
And where the pair shares half of the page's words or more, one is a copy of the other, which says
nothing about the frame.

Neighbours come from a global order of (host, path), cut into blocks of ``BLOCK`` pages that also
see the page before and after: a host with a third of all pages is spread like any other, and only
line hashes travel, never texts.

Defined results: a null page is empty and has no text. A null or malformed URL has no host and no
pair. Rows that repeat in all of id, URL and page count once in the pairing; each gets its row. An
empty table gives no rows. Truncated markup is read up to its end; an unfinished tag is no text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayloom.llm.common import pages, partitions
from wayloom.session import stage

BLOCK = 64
#: From this share of its words on, a page that shares them with its pair is a copy of it.
COPY_SHARE = 0.5

RAW_TAGS = "script|style|noscript|template|textarea|iframe|svg|math|select|title"
#: Comments and raw elements whole, then declarations and tags with quoted attributes.
MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW_TAGS})\b[^>]*+(?:>.*?(?:</\1\s*+>|\Z)|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|</[^>]*+(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE_TAGS = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt "
    "ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
LEFT_OUT_TAGS = frozenset("nav footer aside form button dialog menu head".split())
#: An opening block ends an open paragraph; items end the item before them.
ENDED_BY_SELF = frozenset("li dt dd tr td th option".split())
CONTENT_TAGS = frozenset("article main".split())
LEFT_OUT_WORDS = frozenset(
    "nav navbar navigation menu footer sidebar ad ads adv advert adverts advertisement advertising "
    "banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup "
    "modal overlay newsletter subscribe subscription signup comment comments disqus respond replies "
    "related recommended share sharing social breadcrumb breadcrumbs pagination pager widget login "
    "search masthead topbar toolbar skip".split()
)
#: Parts that may follow such a word in a class or id, and those before it that say it is not one.
STRUCTURE_WORDS = frozenset(
    "area bar block body box button column container content group inner item items left link links list "
    "outer panel right section slot top bottom unit wrap wrapper".split()
)
NEGATING_WORDS = frozenset("has no not with without".split())
LEFT_OUT_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split()
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)

#: Where a line stands: outside, in ``main``, or in ``article``.
OUTSIDE, IN_MAIN, IN_ARTICLE = 0, 1, 2


#: Kept; left out; left out by a class or id unless it turns out to hold the page's content.
KEPT, OUT, OUT_BY_NAME = 0, 1, 2
#: Share of the words of ``main`` from which on its articles stand for all of it.
ARTICLE_SHARE = 0.5


def names_left_out(token: str) -> bool:
    """Whether one class or id names something that is no main text.

    Its last part decides, but for parts that name a mere structure: ``site-footer`` and
    ``comment-list`` do, ``ad-free`` and ``has-sidebar`` do not.
    """
    parts = [p for p in re.split(r"[_-]+", token) if p]
    while parts and parts[-1] in STRUCTURE_WORDS:
        parts.pop()
    return bool(parts) and parts[-1] in LEFT_OUT_WORDS and parts[0] not in NEGATING_WORDS


@lru_cache(maxsize=20_000)
def left_out(tag: str, attributes: str, inside: bool) -> int:
    """Whether an element is no part of the main text, by its name and attributes."""
    if tag in LEFT_OUT_TAGS or (tag == "header" and not inside):
        return OUT
    if tag in ("html", "body", "main") or not attributes.strip():
        return KEPT
    found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
    if re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attributes, re.IGNORECASE) or _HIDDEN.search(found.get("style", "")):
        return OUT
    if found.get("aria-hidden", "").lower() == "true" or found.get("role", "").lower() in LEFT_OUT_ROLES:
        return OUT
    tokens = f"{found.get('class', '')} {found.get('id', '')}".lower().split()
    return OUT_BY_NAME if any(map(names_left_out, tokens)) else KEPT


def lines_of(page: str) -> list[tuple[str, int]]:
    """The page's text lines that are not left out, each with where it stands.

    An element left out by its class or id is taken back if it holds ``main``, an ``h1`` or the page's
    first ``article``; if nothing else is left of the page, all of them are.
    """
    lines: list[tuple[list[tuple[str, tuple[int, ...]]], int]] = []
    parts: list[tuple[str, tuple[int, ...]]] = []
    stack: list[tuple[str, int, str | None]] = []
    dropped, held = 0, {"article": 0, "main": 0}
    named: tuple[int, ...] = ()
    taken_back: set[int] = set()
    count, articles = 0, 0

    def flush() -> None:
        if parts:
            where = IN_ARTICLE if held["article"] else IN_MAIN if held["main"] else OUTSIDE
            lines.append((parts.copy(), where))
            parts.clear()

    def close(at: int) -> None:
        nonlocal dropped, named
        for _, out, content in stack[at:]:
            dropped -= out == OUT
            if out == OUT_BY_NAME:
                named = named[:-1]
            if content:
                held[content] -= 1
        del stack[at:]

    def add(text: str) -> None:
        if text and not dropped:
            parts.append((html.unescape(text) if "&" in text else text, named))

    def kept(back: set[int] | None) -> list[tuple[str, int]]:
        joined = [
            (" ".join("".join(t for t, by in line if back is None or back.issuperset(by)).split()), where)
            for line, where in lines
        ]
        return [(text, where) for text, where in joined if text]

    at = 0
    for found in MARKUP.finditer(page):
        add(page[at : found.start()])
        at = found.end()
        tag = found[3]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            add(" ")
            continue
        inline = tag in INLINE_TAGS
        if not inline:
            flush()
        if found[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
            continue
        if not inline and stack and stack[-1][0] not in ("article", "main"):
            for k in range(len(stack) - 1, -1, -1):
                name = stack[k][0]
                if name == "p" or (name == tag and tag in ENDED_BY_SELF):
                    close(k)
                    break
                if name not in INLINE_TAGS:
                    break
        if tag in VOID_TAGS or found[4].endswith("/") and tag in INLINE_TAGS:
            continue
        if not dropped:
            articles += tag == "article"
            if tag in ("main", "h1") or (tag == "article" and articles == 1):
                taken_back.update(named)
        out = left_out(tag, found[4], held["article"] + held["main"] > 0)
        content = tag if tag in CONTENT_TAGS else None
        stack.append((tag, out, content))
        dropped += out == OUT
        if out == OUT_BY_NAME:
            count += 1
            named += (count,)
        if content:
            held[content] += 1
    add(page[at:])
    flush()
    return kept(taken_back) or kept(None)


def main_lines(lines: list[tuple[str, int]], deleted: frozenset[int] = frozenset()) -> list[str]:
    """The lines of the marked content if there is any, else all that are not deleted.

    Articles stand for a ``main`` around or beside them if they hold half of the words of both; one
    teaser does not, and then all of both is content.
    """
    words = [0, 0, 0]
    for text, where in lines:
        words[where] += len(text.split())
    marked = words[IN_ARTICLE] + words[IN_MAIN]
    least = IN_ARTICLE if words[IN_ARTICLE] >= ARTICLE_SHARE * marked else IN_MAIN
    return [text for k, (text, where) in enumerate(lines) if (where >= least if marked else k not in deleted)]


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``.

    Bit-parallel: a row of the table is one integer, so long pages cost a row of bits for each line.
    """
    full, places = (1 << len(b)) - 1, {}
    for j, line in enumerate(b):
        places[line] = places.get(line, 0) | 1 << j
    row, rows = full, []
    for line in a:
        hit = row & places.get(line, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    found, i, j = [], len(a) - 1, len(b) - 1
    while i >= 0 and j >= 0:
        if rows[i] >> j & 1:
            j -= 1
        elif i and not rows[i - 1] >> j & 1:
            i -= 1
        else:
            found.append(i)
            i, j = i - 1, j - 1
    return found[::-1]


def host_and_path(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit((url or "").strip())
        return parts.hostname or "", parts.path
    except ValueError:
        return "", ""


def _agreement(a: str, b: str) -> int:
    """Length of the common prefix of two paths."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


_OUTLINE = "key long, host string, path string, hashes array<long>, words array<int>, wheres array<int>"


def outlines(table: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """The line hashes of every page with a host, without their texts."""
    schema = pa.schema(
        [
            ("key", pa.int64()),
            ("host", pa.string()),
            ("path", pa.string()),
            ("hashes", pa.list_(pa.int64())),
            ("words", pa.list_(pa.int32())),
            ("wheres", pa.list_(pa.int32())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, url, page in zip(*(c.to_pylist() for c in batch.columns)):
                host, path = host_and_path(url)
                if not host:
                    continue
                lines = lines_of(page or "")
                rows.append(
                    {
                        "key": key,
                        "host": host,
                        "path": path,
                        "hashes": [xxhash.xxh3_64_intdigest(t.encode("utf-8", "replace")) - (1 << 63) for t, _ in lines],
                        "words": [len(t.split()) for t, _ in lines],
                        "wheres": [where for _, where in lines],
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, schema)

    return table.select("key", url_col, html_col).mapInArrow(run, _OUTLINE)


def _differences(block: pa.Table) -> pa.Table:
    """Deleted lines of the pages of one block, whose first and last page may be others' pages."""
    rows = sorted(block.to_pylist(), key=lambda r: r["rank"])
    out = []
    for k, row in enumerate(rows):
        if row["rank"] // BLOCK != row["block"]:
            continue
        near = [
            other
            for other in rows[max(0, k - 1) : k] + rows[k + 1 : k + 2]
            if other["host"] == row["host"]
        ]
        if not near:
            continue
        pair = max(near, key=lambda other: _agreement(other["path"], row["path"]))
        shared = common_lines(row["hashes"], pair["hashes"])
        if sum(row["words"][i] for i in shared) >= COPY_SHARE * max(1, sum(row["words"])):
            continue
        if deleted := [i for i in shared if row["wheres"][i] == OUTSIDE]:
            out.append({"key": row["key"], "deleted": deleted})
    return pa.Table.from_pylist(out, pa.schema([("key", pa.int64()), ("deleted", pa.list_(pa.int32()))]))


def differences(outline: DataFrame) -> DataFrame:
    """``(key, deleted)``: for each page, the lines it shares with the page of the nearest URL."""
    spark = outline.sparkSession
    ordered = stage(
        outline.dropDuplicates(["key"])
        .repartitionByRange(partitions(spark), "host", "path", "key")
        .sortWithinPartitions("host", "path", "key")
        .withColumn("place", F.monotonically_increasing_id())
    )
    # The id holds the partition above 33 bits and the place in it below; made dense by an offset.
    part, place = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    offsets = offsets.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    ranked = ordered.withColumn("part", part).join(offsets, "part").withColumn("rank", F.col("offset") + place)
    own = F.floor(F.col("rank") / BLOCK)
    blocks = F.array_distinct(F.array(own, F.floor((F.col("rank") - 1) / BLOCK), F.floor((F.col("rank") + 1) / BLOCK)))
    dealt = ranked.select("key", "host", "path", "hashes", "words", "wheres", "rank", F.explode(blocks).alias("block"))
    return dealt.groupBy("block").applyInArrow(_differences, "key long, deleted array<int>")


def extract(
    table: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """``(id_col, url_col, text, n_chars)`` of every page.

    Pages meet their deleted lines in a join whose sides Spark weighs: pages that mark their content
    have none, and where few others are left their table is small and no page is shuffled.
    """
    rows = table.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")
    ).withColumn("key", F.xxhash64("page_id", "url", "html"))
    deleted = stage(differences(outlines(rows, "url", "html")))
    kind = table.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                "\n".join(main_lines(lines_of(page or ""), frozenset(gone or ())))
                for page, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    joined = rows.join(deleted, "key", "left").select("page_id", "url", "html", "deleted")
    found = joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
    return found.withColumnsRenamed({"page_id": id_col, "url": url_col})


def op4_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract(pages(spark, folder))
