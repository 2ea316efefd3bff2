import re

from loomgraph.llm import queries
from loomgraph.llm.html_extract import extract, main_text

SF = "/root/testdata/sf0.001"


def expected(html):
    """The article of a generated page, whose form is known."""
    import html as h

    body = html.split("<article>", 1)[1].split("</article>", 1)[0]
    blocks = re.split(r"</?(?:p|h1)>", body)
    text = (" ".join(h.unescape(re.sub(r"<[^>]*>", " " if "<br" in b else "", b)).split()) for b in blocks)
    return "\n\n".join(t for t in text if t)


def test_generated_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r for r in queries.op3_html_extract(spark, SF).collect()}
    assert {i: r.text for i, r in got.items()} == {i: expected(h) for i, h in pages.items()}
    assert all(r.n_chars == len(r.text) for r in got.values())


ARTICLE = "<h1>Title &amp; more</h1><p>First   paragraph with\n enough words to be seen as the text of a page, and then some.</p><p>Short.</p><ul><li>one</li><li>two <a href=x>link</a></li></ul><p>Last paragraph &lt;b&gt; has many words too, so that it counts as content.</p>"
WANT = "Title & more\n\nFirst paragraph with enough words to be seen as the text of a page, and then some.\n\nShort.\n\none\n\ntwo link\n\nLast paragraph <b> has many words too, so that it counts as content."
AROUND = [
    "<header><h2>Site name and a long slogan that nobody reads at all but is here</h2></header><nav><a href=/>Home</a></nav><main><article>{}</article></main><footer>&copy; all rights reserved by a company with a long name</footer>",
    '<div class="cookie-notice">We use cookies and many other things to make a page that is hard to read.</div><div id="content">{}</div><aside>Another text that stands at the side of the page, with many words.</aside>',
    '<div class="sidebar"><p>Words words words words words words words words words words.</p></div><article>{}</article><section id="comments"><article><p>A reader says a lot of things about this text, most of them wrong, at length.</p></article></section>',
    '<article>{}<form><p>Write to us about this and that, as we like to hear from you all.</p><input name=q><button>Send</button></form><div class="ad">Buy this thing now, it is very good and costs nearly nothing at all.</div></article>',
    '<div role="banner">A banner of some length that tells of a sale that ends today.</div><div class="page"><div class="entry-content">{}</div></div><script>var a = "<p>not text</p>";</script><style>p {{ color: red }}</style>',
]


def test_furniture_is_left_out():
    for page in AROUND:
        html = f"<!DOCTYPE html><html><head><title>Title</title></head><body>{page.format(ARTICLE)}</body></html>"
        assert main_text(html) == WANT, page
        assert main_text(html[: html.rindex("</body>")]) == WANT, page


PARA = ["The first paragraph of this text has quite a few words, so that it looks like prose.", "A second one follows it, and it too goes on for a while before it ends with a stop.", "The third says that nothing here is marked as an article, only by how dense it is."]
LINKS = "".join(f'<div><a href="/{i}">Section {i} of the site</a></div>' for i in range(8))
PROSE = "".join(f"<div>{p}</div>" for p in PARA)
#: Pages without article or main, hand-made: (page, text).
DENSE = [
    (f"<body><div>{LINKS}</div><div><h1>Top</h1>{PROSE}</div><div>{LINKS}</div></body>", ["Top", *PARA]),
    (f"<body>{LINKS}<h1>Top</h1>{PROSE}{LINKS}</body>", ["Top", *PARA]),
    (f"<body><form id='aspnetForm'><div class='nav'>Home</div><h1>Top</h1>{PROSE}<input name=q></form></body>", ["Top", *PARA]),
    (f"<body><div class='post no-sidebar'><h1>Top</h1>{PROSE}</div><div class='sidebar'>{PARA[0]}</div></body>", ["Top", *PARA]),
    (f"<body><div class='sidebar-left'><div class='sidebar'>Side words here</div><h1>Top</h1>{PROSE}</div></body>", ["Top", *PARA]),
    (f"<body><div><h1>Top</h1><div>{PARA[0]}</div><p><a href=x>a paragraph that is wholly one link</a></p><div>{PARA[1]}</div><div class=ad>Buy this</div><div>{PARA[2]}</div></div></body>", ["Top", PARA[0], "a paragraph that is wholly one link", *PARA[1:]]),
    (f"<body><div><h1>Top</h1>{PROSE}</div><div id='comments'><h3>Comments</h3>{PROSE * 3}</div></body>", ["Top", *PARA]),
    (f"<body><div><h2>Top</h2><table><tr><td>cell one</td><td>cell two</td></tr></table>{PROSE}</div><footer>{PARA[0]}</footer></body>", ["Top", "cell one cell two", *PARA]),
]


def test_pages_without_an_article():
    for page, want in DENSE:
        assert main_text(page) == "\n\n".join(want), page


def test_the_clusters_decide(monkeypatch):
    from loomgraph.llm import html_extract

    monkeypatch.setattr(html_extract, "THRESHOLD", -1.0)  # every line counts as content
    assert sum(main_text(page) != "\n\n".join(want) for page, want in DENSE) >= 6
    pages = [p.format(ARTICLE) for p in AROUND]
    assert sum(main_text(f"<html><body>{p}</body></html>") != WANT for p in pages) >= 3


def test_whole_page_form_and_article():
    assert main_text(f"<body><form id='aspnetForm'><article>{ARTICLE}</article></form></body>") == WANT
    assert main_text(f"<body><div class='post no-sidebar'><article>{ARTICLE}</article></div></body>") == WANT


def test_time_is_linear_in_nesting():
    import time

    for page in ("<div>" * 100_000 + "text of the page", "<div>text " * 60_000, "<p><b>" * 60_000 + "x", "<i>" * 60_000 + "</b>" * 60_000 + "x", "<ul>" + "<li><div>" * 60_000 + "x"):
        began = time.process_time()
        assert main_text(page)
        assert time.process_time() - began < 8


def test_odd_html(spark):
    assert main_text("") == "" and main_text("<html><body></body></html>") == "" and main_text("<p>") == ""
    assert main_text("just text") == "just text"
    assert main_text("<article><p>a<b>b</p><p>c</article>") == "ab\n\nc"
    assert main_text("<p>x &am; &copy &#x41; &notanentity; y</p>").startswith("x &am; © A")
    rows = [(1, "u", None, "t"), (2, None, "", "t"), (None, "u", "<p>" + "long text " * 50_000, None), (3, "u", "<p>a</p>", "t"), (3, "u", "<p>a</p>", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract(pages)
    assert got.columns == ["page_id", "url", "text"]
    assert sorted((r.page_id or 0, len(r.text)) for r in got.collect()) == [(0, len("long text " * 50_000) - 1), (1, 0), (2, 0), (3, 1), (3, 1)]
    assert extract(pages.limit(0)).collect() == []
