"""Main text of pages: exact on the test table, and the odd cases of markup."""

from __future__ import annotations

import html
import re

from tests.conftest import SF
from tidelog.llm import common
from tidelog.llm.html import Page, extract


def main(source):
    page = Page(source)
    return page.main_text(page.best()[0][0])


def test_table(spark):
    """On these pages the article element is the main text; its text is derived by patterns alone."""
    pages = common.table(spark, SF, "pages")
    got = {r.page_id: (r.text, r.n_chars) for r in extract(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " ")
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        want = "\n".join(b for b in blocks if b)
        assert got[r.page_id] == (want, len(want))


def test_markup():
    assert main("<p>a &lt; b &amp;amp; c&nbsp;d &#233;<p>two<br>lines <b>bold<i>er</b></i>!") == "a < b &amp; c d é\ntwo lines bolder!"
    assert main("<div>1 < 2 and 3 > 2<script>if (a < b) { document.write('<p>x</p>') }</script> end") == "1 < 2 and 3 > 2 end"
    assert main("<ul><li>one<li>two</ul><dl><dt>t<dd>d</dl><pre> x\n  y </pre>") == "one\ntwo\nt\nd\nx y"
    assert main("<table><tr><td>a<td>b<tr><th>c</table>tail") == "a b\nc\ntail"
    assert main("<p title='a > b'>x</p><!-- <p>no</p> --><p>y</p><![CDATA[z]]>") == "x\ny"
    assert main("") == "" and main("plain & simple") == "plain & simple" and main("<") == "<" and main("<p") == "<p"
    assert main("<p>before <button>Go</button> after <label>L") == "before after"
    assert main("<P>Up</P><STYLE>p{}</STYLE><noscript>n</noscript><textarea>t</textarea>") == "Up"


PAGE = """<!DOCTYPE html><html><head><title>T</title></head><body class="has-sidebar">
<header class="site"><h1>Site</h1><p>{0} slogan</p></header><nav><a href="/">Home</a> <a href="/b">B</a></nav>
<div class="cookie-notice">We use cookies {0}</div>
<div id="wrap"><div class="post-{0}"><h1>Title {0}</h1><p>First paragraph of {0} with <a href="x">a link</a> in it.</p>
<div class="ad-box">Buy {0}!</div><p>Second paragraph, also of some length, about {0}.</p><form><input><label>mail</label><button>Go</button></form>
<div class="share-buttons"><a>Share</a></div></div>
<div id="comments"><p>first! {0} is a comment, and a rather long one so that it outweighs the text around it by far; yes it does indeed do that.</p></div>
<aside><p>side {0}</p></aside></div><footer>&copy; {0}</footer></body></html>"""


def test_page_parts():
    want = "Title 7\nFirst paragraph of 7 with a link in it.\nSecond paragraph, also of some length, about 7."
    assert main(PAGE.format(7)) == want


def test_plain_divs():
    page = """<body><div id=header><h1>Site</h1><ul class=mainMenu><li><a href=1>One</a></ul></div><table><tr><td class=left-rail>links</td>
<td><div class=post-header><h1>Title</h1></div><div class="entry c{0}"><p>Paragraph one, of some length.<p>Paragraph two.</div><div class=threads>reader says no</div></td></tr></table><div class=googleads>x</div><div class=copyright>c</div>"""
    assert main(page) == "Title\nParagraph one, of some length.\nParagraph two."


def test_article_header_stays():
    page = "<body><header>Site</header><main><article><header><h1>Head</h1></header><p>Body text of the article.</p><section class='comments'><p>no</p></section></article></main><div role='complementary'>no</div><div hidden>no</div><div style='display: none'>no</div></body>"
    assert main(page) == "Head\nBody text of the article."


def test_words_do_not_empty_a_page():
    """A word of a class doesn't leave out the article or a wrapper of it; menus, comments and teasers beside it go."""
    text = "<h1>Title</h1><p>Paragraph one, of some length.</p><p>Paragraph two.</p>"
    want = "Title\nParagraph one, of some length.\nParagraph two."
    for start, end in (
        ("<article class='post category-social'>", "</article>"),
        ("<article class='trending'>", "</article>"),
        ("<div class='post tag-offers'>", "</div>"),
        ("<div class='right-sidebar'>", "</div>"),
        ("<div id='layout-sidebar-left'><div class='menu-on'><div class=x>", "</div></div></div>"),
        ("<div class='comment-cookie'>", "</div>"),
    ):
        assert main(f"<body><nav>no</nav>{start}{text}{end}</body>") == want, start
    extra = "<div class=sidebar><p>Some words.</p></div><article class=teaser><p>Another page's words.</p></article><div class=comments><p>" + "A long comment. " * 20 + "</p></div>"
    assert main(f"<body><div class=right-sidebar><article>{text}</article>{extra}</div></body>") == want
    assert main(f"<body><h1>Title</h1><p>Story.</p><div class='share'>Share it</div></body>") == "Title\nStory."


def test_consensus_helps_a_lone_page(spark):
    """A short article whose own page would have another container win is read by its host's path."""
    usual = "<body><div class='content'><p>{}</p></div><div class='box'><p>other box</p></div></body>"
    odd = "<body><div class='content'><p>short but here, some words</p></div><div class='box'><p>other box of a few</p></div></body>"
    rows = [(i, "http://h.example/%d" % i, usual.format("many words of text " * 20), "x", "y") for i in range(20)] + [(99, "https://www.H.example:80/z", odd, "x", "y")]
    got = {r.page_id: r for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string, path string")).collect()}
    assert got[99].text == "short but here, some words" and got[99].path == "body>div.content"


def test_article_in_parts(spark):
    """All containers on a host's path count, and a lone page loses no running text."""
    a, b = "first part of it " * 30, "second part of it " * 18
    parts = {
        "p": ("<body><article><p>{}</p></article>", "<article><p>{}</p></article></body>"),
        "q": ("<body><div class=text><p>{}</p></div>", "<div class=text><p>{}</p></div></body>"),
    }
    rows = [(i, f"http://{h}.example/{i}", first.format(a)) for h, (first, _) in parts.items() for i in range(20)]
    rows += [(99, f"http://{h}.example/x", first.format(a) + second.format(b)) for h, (first, second) in parts.items()]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string")).where("page_id = 99").collect()
    assert [r.text for r in got] == [f"{a.strip()}\n{b.strip()}"] * 2
    assert main(f"<div class=text><h1>T</h1><p>{a * 3}</p></div><div class=text><p>{b}</p></div>") == f"T\n{(a * 3).strip()}\n{b.strip()}"
    assert main(f"<div class=text><p>{a * 3}</p></div><div class=more><p>{b}</p></div>") == f"{(a * 3).strip()}\n{b.strip()}"


def test_odd_rows(spark):
    rows = [(1, None, None), (None, "::", "<p>x"), (2, "", ""), (2, "", ""), (3, "http://a b/", "<div>" * 3000 + "deep"), (4, "http://a/", "<p>" + "w " * 200_000)]
    got = [(r.page_id, r.text[:4], r.n_chars) for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert sorted(got, key=repr) == sorted([(1, "", 0), (None, "x", 1), (2, "", 0), (2, "", 0), (3, "deep", 4), (4, "w w ", 399_999)], key=repr)
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_long_odd_pages_take_linear_time():
    """A megabyte of what is no tag, of unclosed quotes, or of nesting is parsed in seconds."""
    import time

    for piece in ("<a ", "<a x=\"", "<a x='\" ", "<div>", "<b>", "<div class=sidebar><p>x", "<article>", "<p><b>", "<!-", "<![", "<textarea>", "</i>"):
        began = time.time()
        Page(piece * (1_000_000 // len(piece))).best()
        assert time.time() - began < 15, piece
    for page in ("<b>" * 100_000 + "</i>" * 100_000, "<i><div>" + "<b>" * 100_000 + "</i>" * 100_000, "<b>" * 100_000 + "<li>x" * 100_000):
        began = time.time()
        Page(page).best()
        assert time.time() - began < 15, page[-9:]


def test_quotes_of_attributes():
    assert main("<p title=it's>x</p><p title=\"a>b\">y</p><p title='z>w' data-x=5'>z</p>") == "x\ny\nz"
    assert main("<div class='werbung'><p>no</p></div><p>Text of the page.</p><div id=kommentare><p>no</p></div>") == "Text of the page."


def test_many_templates_of_a_host(spark):
    """Each of five templates that a host's pages share wins, not only the three of most votes."""
    page = "<body><div class='{}'><p>{}</p></div><div class='{}'><p>other box</p></div></body>"
    names = ["one", "two", "three", "four", "five"]
    rows = [(10 * k + i, f"http://h.example/{k}/{i}", page.format(f"main{n}x {n}", "many words of text " * 20, "side-" + n)) for k, n in enumerate(names) for i in range(6 - k)]
    rows += [(1000, "http://h.example/x", page.format("mainfourx four", "short but here", "side-four"))]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1000] == "short but here"
