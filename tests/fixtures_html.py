"""An invented town's page, and a page with nothing on it, used by several tests."""

# The parts stand in an order of their own, nested in wrappers the rules have to see through.
GALLERY = '<div class="gallery"><img src="//pics.example/gallery.png" alt=""></div>'
PLACE = '<p><small>Position: <a href="/map"><span class="marker geo">-12.5; 131.25</span></a></small></p>'
INTRO = """
<main><div id="mw-content-text" lang="en"><div class="body output">
<p class="mw-empty-elt"> </p>
<p>Lower <i>Quandary</i> is a harbour town of ferries, kilns &amp; tide mills,[4] set where the
Vell meets the sea. Its quay is 1.2&nbsp;km long, or 12<sup>2</sup> boats.[11]</p>
<p>A second paragraph, which is not the description.</p>
</div></div></main>
"""
BOX = """
<div><table id="facts" class="wide infobox town">
<caption>Lower Quandary</caption>
<tr><td colspan="2"><div class="frame image"><a href="/f"><img title='a > b'
 src="//pics.example/quay.jpg?w=320&amp;h=200"></a></div></td></tr>
<tr><th scope="row">Languages spoken, Official language</th><td>Vellish,
 Old Vellish , Trade Pidgin</td></tr>
<tr><th>Location</th><td> Vell Coast[2] </td></tr>
<tr><th>Population (estimate)</th><td>see below</td></tr>
<tr><td>41,207 (2019)</td></tr>
<tr><th>Time zone in winter</th><td>UTC+09:30</td></tr>
</table></div>
"""
WEATHER = """
<h3>Overview</h3>
<h2><span class="mw-headline" id="Weather">Weather</span> <a>edit</a></h2>
<div><p>Sea fog most mornings;[7] dry winds from the salt flats in the long season.</p></div>
"""
SIGHTS = """
<h2><span class="mw-headline" id="Landmarks">Landmarks</span></h2>
<ul>
<li><b>Kiln Museum</b>: six bottle kilns in a row</li>
<li><a href="/w">Wren Garden</a> - moss and ferns</li>
<li>Hm</li>
<li><a href="/t"><img src="/t.png">Salt Tower</a> - a lookout of 1790</li>
<li><a href="/k">kiln museum</a> - named again</li>
</ul>
<h2><span class="mw-headline" id="See_also">See also</span></h2>
<ul><li>Upper Quandary park</li><li>Vell castle</li></ul>
"""
FULL = (
    "<!doctype html><html><body><header><h1>Lower Quandary</h1></header>"
    + GALLERY + SIGHTS + PLACE + BOX + WEATHER + INTRO + "<!-- <p>gone</p> --></body>"
)
EMPTY = "<html><body><div><p>Nothing is known of this place.</p></div></body></html>"
