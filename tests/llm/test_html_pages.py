"""Main text of pages that are written here with their text, and of the generated pages against a plain reading."""

import re
from html.parser import HTMLParser

import pytest

from fixmine.llm import html_text

A = "The evening was quiet and the river went slowly past the old houses."
B = "Nobody on the bridge could say how long the rain would last this time."
C = "In the morning the ferry was late again, and the baker counted eleven people at the landing."
MENU = '<nav><ul><li><a href="/">Home</a></li><li><a href="/map">Map of the town</a></li></ul></nav>'
FOOT = "<footer>&copy; The town, all rights reserved</footer>"

#: Names that look like menus or notices and are part of the article, and a form around a whole page.
NAMED = {
    "id of a heading": (f'<article><h1>Title</h1><p>{A}</p><h2 id="search-trees">Trees that search</h2><p>{B}</p></article>', ["Title", A, "Trees that search", B]),
    "id of a section": (f'<article><p>{A}</p><section id="related-work"><h2>Work</h2><p>{B}</p></section></article>', [A, "Work", B]),
    "id of a division": (f'<article><p>{A}</p><div id="legal-background"><p>{B}</p></div></article>', [A, B]),
    "class of a paragraph": (f'<article><p>{A}</p><p class="notice-of-motion">{B}</p></article>', [A, B]),
    "class of a figure": (f'<article><p>{A}</p><figure class="banner"><img src=x><figcaption>A bridge</figcaption></figure><p>{B}</p></article>', [A, "A bridge", B]),
    "class of a quotation": (f'<article><p>{A}</p><blockquote class="reply">{B}</blockquote></article>', [A, B]),
    "class of a table's row": (f'<article><p>{A}</p><table><tr class="header"><th>Year</th><th>Rain</th></tr><tr><td>1990</td><td>12</td></tr></table></article>', [A, "Year", "Rain", "1990", "12"]),
    "header inside content": (f'<div class="content"><div class="header"><h1>The old bridge</h1></div><p>{A}</p><p>{B}</p></div>', ["The old bridge", A, B]),
    "form around a page": (f'<form id="aspnetForm" action="/x"><input type="hidden" name="__VIEWSTATE" value="x"><div id="content"><h1>The old bridge</h1><p>{A}</p><p>{B}</p></div></form>', ["The old bridge", A, B]),
    "a notice that is prose": (f'<article><p>{A}</p><div class="notice"><p>{B}</p></div><p>{C}</p></article>', [A, B, C]),
    "a class of prose": (f'<article><p>{A}</p><div class="related-work"><p>{B} {C}</p></div></article>', [A, f"{B} {C}"]),
}

#: Layouts of other sites.
SITES = {
    "divisions only": (f'<div id="header"><a href=/>Town news</a></div><div id="wrapper"><div class="sidebar"><h3>About</h3><p>{C}</p></div><div class="post"><h1>Rain</h1><p>{A}</p><p>{B}</p></div></div><div id="footer">Contact us</div>', ["Rain", A, B]),
    "comments below": (f'<article><h1>Rain</h1><p>{A}</p></article><section id="comments"><h2>2 comments</h2><article class="comment"><p>{B}</p></article><article class="comment"><p>{C}</p></article></section>', ["Rain", A]),
    "comments inside": (f'<article><h1>Rain</h1><p>{A}</p><p>{B}</p><div class="comments"><div class="comment"><p>{C}</p></div></div></article>', ["Rain", A, B]),
    "advert inside": (f'<article><p>{A}</p><div class="ad">Umbrellas at half the price, only today!</div><p>{B}</p></article>', [A, B]),
    "share and tags": (f'<main><h1>Rain</h1><div class="share-buttons"><a href=f>Share</a> <a href=t>Post</a></div><p>{A}</p><p>{B}</p><div class="related-posts"><ul><li><a href=1>More rain</a></li><li><a href=2>Less rain</a></li></ul></div></main>', ["Rain", A, B]),
    "newsletter form inside": (f'<article><p>{A}</p><form class="newsletter-signup"><p>Get our letter every week</p><label>Your address</label><input type=email><button>Send</button></form><p>{B}</p></article>', [A, B]),
    "cookie notice": (f'<div class="cookie-notice"><p>We use cookies to make everything better for you.</p><button>Accept</button></div><main><p>{A}</p><p>{B}</p></main>', [A, B]),
    "search form above": (f'<form class="search"><input name=q><button>Search</button></form><div class="entry"><h2>Rain</h2><p>{A}</p></div>', ["Rain", A]),
    "aside inside": (f'<article><p>{A}</p><aside><p>{C}</p></aside><p>{B}</p></article>', [A, B]),
    "hidden parts": (f'<article><p>{A}</p><div style="display:none"><p>{C}</p></div><script>var a = "<p>{C}</p>";</script><p>{B}</p></article>', [A, B]),
    "code and lists": (f"<article><h1>Rain</h1><ul><li><a href=a>First of the links</a></li><li>Second</li></ul><pre>a = b\n  + c</pre><p>{A}</p></article>", ["Rain", "First of the links", "Second", "a = b + c", A]),
    "references": (f"<article><p>Tom &amp; Jerry&#39;s &lt;rain&gt; caf&eacute;, {A}</p></article>", [f"Tom & Jerry's <rain> café, {A}"]),
}


@pytest.mark.parametrize("name", sorted(NAMED))
def test_names_inside_an_article(name):
    page, want = NAMED[name]
    for weights in (html_text.PRIOR, html_text.PRIOR * np_ones(0.8)):
        assert html_text.main_text(f"<html><body>{MENU}{page}{FOOT}</body></html>", weights) == "\n".join(want)


def np_ones(scale):
    """Weights of names that a fit has moved."""
    out = html_text.PRIOR * 0 + 1.0
    out[-2:] = scale
    return out


@pytest.mark.parametrize("name", sorted(SITES))
def test_sites(name):
    page, want = SITES[name]
    assert html_text.main_text(f"<html><body>{MENU}{page}{FOOT}</body></html>") == "\n".join(want)


@pytest.mark.parametrize("token", ["notice", "related", "menu", "sidebar", "banner", "social"])
def test_no_single_name_is_a_verdict(token):
    """The cut overturns a name where text and neighbours are those of an article."""
    page = f'<article><p>{A}</p><div class="{token}"><p>{A} {B}</p></div><p>{C}</p></article>'
    assert html_text.main_text(page) == "\n".join([A, f"{A} {B}", C])
    assert html_text.main_text(f'<div class="{token}"><a href=x>One</a></div><article><p>{A}</p></article>') == A


class Article(HTMLParser):
    """The blocks of the generated pages' articles: a new one at each p and h1, and a blank for a br."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.inside, self.parts = False, [""]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("p", "h1", "article"):
            self.parts.append("")
        elif tag == "br":
            self.parts[-1] += " "

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        if tag in ("p", "h1", "article"):
            self.parts.append("")

    def handle_data(self, data):
        if self.inside:
            self.parts[-1] += data


def test_generated_pages_equal_a_plain_reading(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r["page_id"]: "\n".join(x for x in (re.sub(r"\s+", " ", p).strip() for p in Article(r["html"]).parts) if x) for r in pages.collect()}
    rows = html_text.extract(pages).collect()
    assert len(rows) == len(want) and {r["page_id"]: r["text"] for r in rows} == want
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
