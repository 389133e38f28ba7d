import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wayloom.llm import html_extraction as extraction

SCHEMA = "page_id long, url string, html string, key string, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA)


def texts(found):
    return {(r["page_id"], r["url"]): r["text"] for r in found.collect()}


def main_text(page):
    return "\n".join(extraction.main_lines(extraction.lines_of(page)))


CASES = [
    ("", ""),
    ("plain only", "plain only"),
    ("<article><h1>A</h1><p>One<br>two  <b>th</b>ree\n four<p>Five</article>", "A\nOne two three four\nFive"),
    ("<nav>menu<ul><li>x</ul></nav><article>Body</article><footer>f</footer>", "Body"),
    ("<header>site</header><article><header><h1>Title</h1></header><p>b</p></article>", "Title\nb"),
    ("<article><p>a</p><div class='ad'>buy<div>now</div></div><p>b</p></article>", "a\nb"),
    ("<article><p class='ad'>buy<p>b</p></article>", "b"),
    ("<article><p>a &amp; b &lt;c&gt; &eacute;&nbsp;&#233; &am</article>", "a & b <c> é é &am"),
    ("<article><script>if (a<b) '</p>'</script><style>p{}</style><p>x</p></article>", "x"),
    ("<article><p>x</p><section id='comments'><p>first!</p></section></article>", "x"),
    ("<article><p>x</p><form><p>mail</p></form><aside>s</aside><p hidden>h</p></article>", "x"),
    ("<article><p>x <!-- <p>no</p> --> y</p><p>cut <a hre", "x y\ncut"),
    ("<main><p>m</p><article><p>a</p></article></main>", "a"),
    ("<body class='has sidebar'><main id=main><p title='a>b'>m</p></main></body>", "m"),
    ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\nb\nc\nd"),
    ("<article><p>x</p><div style='display: none'>h</div><div aria-hidden=true>h</div></article>", "x"),
    ("<div class='cookie-notice'>c</div><div class='adventure'>kept</div>", "kept"),
    # Ordinary names around or on the content.
    ("<div class='post has-sidebar'><article><p>Body.</p></article></div>", "Body."),
    ("<div class='site-content no-comments'><p>Body.</p></div><p>x</p>", "Body.\nx"),
    ("<div class='l-page ad-free'><p>Body.</p></div><p>x</p>", "Body.\nx"),
    ("<div class='content notice-board-story'><p>Body.</p></div><p>x</p>", "Body.\nx"),
    ("<div class='entry widget-area-none'><p>Body.</p></div><p>x</p>", "Body.\nx"),
    ("<article class='post share-friendly'><p>Body.</p></article>", "Body."),
    ("<div class='layout-sidebar'><p>x</p><article><p>Body.</p></article></div>", "Body."),
    ("<div id=promo><h1>T</h1><p>Body.</p></div><div class='promo'>buy</div>", "T\nBody."),
    ("<article class='sponsored'><p>Only <b>this</b>.</p></article>", "Only this."),
    # Names that do say so, on elements beside it.
    ("<article><p>a</p><div class='comment-list'><article class='comment'>no</article></div></article>", "a"),
    ("<article><p>a b</p></article><div class='related-items'><article>c</article></div>", "a b"),
    ("<article><p>a <span class='ad-slot'>buy</span>b</p><div id=site_footer>f</div></article>", "a b"),
    # A teaser beside the content of ``main``.
    ("<main><p>one two</p><p>three</p><article>Teaser</article></main>", "one two\nthree\nTeaser"),
    ("<main><header><h1>T</h1></header><p>m</p></main>", "T\nm"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_structure(page, text):
    assert main_text(page) == text


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4), max_size=14))
def test_common_lines_are_a_longest_common_subsequence(a, b):
    found = extraction.common_lines(a, b)
    assert found == sorted(set(found)) and len(found) == lcs_length(a, b)
    at = 0
    for i in found:
        at = b.index(a[i], at) + 1


def site(n, body):
    return f"<div>Acme daily</div><p>{body}</p><p>Printed by Acme in {2000}</p>"


def test_shared_lines_of_the_nearest_page_go(spark):
    rows = [
        (1, "http://a.com/news/1", site(1, "First story with many words of its own")),
        (2, "http://a.com/news/2?x=1", site(2, "Second story with many words of its own")),
        (3, "http://a.com/shop/9", "<div>Acme shop</div><p>Wholly other page here</p>"),
        (4, "http://b.com/news/1", site(4, "Alone on its host with the same frame")),
        (5, "http://c.com/x", "<p>The same text twice on this host</p>"),
        (6, "http://c.com/y", "<p>The same text twice on this host</p>"),
        (7, "http://d.com/x", "<article><p>Shared passage</p><p>own words here one</p></article>"),
        (8, "http://d.com/y", "<article><p>Shared passage</p><p>own words here two</p></article>"),
        (9, None, "<p>no url</p>"),
        (10, "http://[bad", "<p>bad url</p>"),
        (11, "http://e.com/", None),
        (None, "http://g.com/news/1", "<p>null id</p>"),
        (12, "http://f.com/z", "<p>again</p>"),
        (12, "http://f.com/z", "<p>again</p>"),
    ]
    found = extraction.extract(frame(spark, rows))
    got = texts(found)
    assert found.count() == len(rows)
    assert got[1, rows[0][1]] == "First story with many words of its own"
    assert got[2, rows[1][1]] == "Second story with many words of its own"
    assert got[3, rows[2][1]] == "Acme shop\nWholly other page here"
    assert got[4, rows[3][1]].startswith("Acme daily\n")
    assert got[5, rows[4][1]] == got[6, rows[5][1]] == "The same text twice on this host"
    assert got[7, rows[6][1]] == "Shared passage\nown words here one"
    assert (got[9, None], got[10, "http://[bad"], got[11, "http://e.com/"]) == ("no url", "bad url", "")
    assert got[12, "http://f.com/z"] == "again"
    assert all(r["n_chars"] == len(r["text"]) for r in found.collect())


def expected(rows):
    """Pairs by a plain sort of each host's pages."""
    pages = sorted((*extraction.host_and_path(u), i) for i, (_, u, _) in enumerate(rows))
    lines = [extraction.lines_of(h) for *_, h in rows]
    out = {}
    for k, (host, path, i) in enumerate(pages):
        near = [pages[j] for j in (k - 1, k + 1) if 0 <= j < len(pages) and pages[j][0] == host]
        gone = set()
        if near:
            pair = max(near, key=lambda o: extraction._agreement(o[1], path))
            a, b = ([t for t, _ in lines[x]] for x in (i, pair[2]))
            shared = extraction.common_lines(a, b)
            words = [len(t.split()) for t in a]
            if sum(words[x] for x in shared) < 0.5 * sum(words):
                gone = set(shared)
        out[rows[i][0], rows[i][1]] = "\n".join(t for x, (t, _) in enumerate(lines[i]) if x not in gone)
    return out


def test_many_pages_of_one_host_over_blocks(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        section = rng.choice(["news", "shop", "blog"])
        frame_lines = [f"{section} frame {k}" for k in range(rng.randint(0, 3))]
        body = [" ".join(rng.choice("abcdefgh") * 3 for _ in range(12)) for _ in range(3)]
        page = "".join(f"<p>{x}</p>" for x in [*frame_lines, *body])
        rows.append((i, f"http://hot.com/{section}/{i:04d}", page))
    assert texts(extraction.extract(frame(spark, rows))) == expected(rows)


def test_empty_table(spark):
    assert extraction.extract(frame(spark, [])).count() == 0


def test_query_on_whole_pages(spark, folder):
    rows = spark.read.parquet(f"{folder}/pages.parquet").collect()
    found = {r["page_id"]: r["text"] for r in extraction.op4_html_extraction(spark, folder).collect()}
    assert found == {r["page_id"]: main_text(r["html"]) for r in rows}
