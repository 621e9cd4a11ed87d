import html
import re
import time

from airwell.llm import html_text
from tests.conftest import SF001


def article(page):
    """Blocks of the article element, for pages that have just headings and paragraphs in it."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)
    parts = re.split(r"</?(?:p|h1)>", inner[1]) if inner else []
    found = [" ".join(html.unescape(re.sub(r"</?(?:b|br)>", " ", x)).split()) for x in parts]
    return "\n".join(x for x in found if x)


def test_given_pages(spark):
    pages = spark.read.parquet(f"{SF001}/pages.parquet")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        assert got[r.page_id].text == article(r.html) and got[r.page_id].n_chars == len(article(r.html))
        assert got[r.page_id].url == r.url


def test_tree_fits_its_table_and_uses_neighbours_features():
    x, y = html_text.labelled_rows()
    assert x.shape == (len(y), len(html_text.FEATURES))
    tree = html_text.fit()
    assert (html_text.classify(tree, x) == y).mean() == 1.0

    def used(node):
        return {html_text.FEATURES[node[0]]} | used(node[2]) | used(node[3]) if isinstance(node, tuple) else set()
    assert used(tree) & {"link_before", "link_after"} and "named_away" in used(tree)


TITLE = "The ferry to the islands"
TEXT = ["The ferry crosses twice a day from spring to autumn, and in the winter only when the harbour is free of ice and the crew is well.",
        "Nobody waits.", "Those who miss it sleep in the small house by the pier, where a lamp burns and somebody has always left bread on the table."]
BODY = f"<h1>{TITLE}</h1>" + "".join(f"<p>{t}</p>" for t in TEXT)
MENU = '<ul><li><a href="/a">Home</a></li><li><a href="/b">All the news</a></li><li><a href="/c">About</a></li></ul>'
SIDE = '<p>Order the letter of the islands now and get the map of all harbours for free with it, as long as we have some.</p>'

# held-out layouts: none of them is in the labelled table
LAYOUTS = [
    f'<body class="single has-sidebar"><nav>{MENU}</nav><article>{BODY}</article></body>',
    f'<body><div class="content no-sidebar">{BODY}</div></body>',
    f'<body><div id="page" class="header-fixed"><article>{BODY}</article></div></body>',
    f'<body class="sidebar-left menu-open"><div class="site-nav">{MENU}</div><main>{BODY}</main></body>',
    f'<html class="js no-touch nav-sticky"><body><div class="layout-with-sidebar"><main><article>{BODY}</article></main>'
    f'<div class="sidebar">{SIDE}</div></div></body></html>',
    f'<body><div class="sidebar-wrapper"><article>{BODY}</article></div><div class="sidebar">{SIDE}</div></body>',
    f'<body><div class="header-page-footer"><div class="menu">{MENU}</div><article>{BODY}</article></div></body>',
    f'<body><article><header class="entry-header"><h1>{TITLE}</h1></header>{BODY.split("</h1>")[1]}</article><footer>{SIDE}</footer></body>',
    f'<body><h1>{TITLE}</h1><article>{BODY.split("</h1>")[1]}</article><div class="comments"><article><p>I was there in May and it was '
    f'very good, thank you all.</p></article></div></body>',
    f'<body><div class="main-nav">{MENU}</div><div class="post"><div class="post-title"><h1>{TITLE}</h1></div>{BODY.split("</h1>")[1]}</div>'
    f'<div class="related-posts"><article><p>{SIDE}</p></article></div></body>',
    f'<body>{MENU}<div>{BODY}</div>{MENU}</body>',
    f'<body><table><tr><td>{MENU}</td></tr><tr><td>{BODY}</td></tr></table><p>Most read</p>{MENU}</body>',
    f'<body><div class="cookie-notice">{SIDE}</div><div class="story">{BODY}</div><div class="ad-box">{SIDE}</div></body>',
    f'<body><div class="menu-enabled"><div class="is-search-open">{BODY}</div></div><div id="search">{SIDE}</div></body>',
]


def test_held_out_layouts():
    tree = html_text.fit()
    for page in LAYOUTS:
        assert html_text.main_text(page, tree) == "\n".join([TITLE, *TEXT]), page[:90]


def test_parts_that_are_not_main_text():
    tree = html_text.fit()
    page = ('<head><title>T</title></head><body class="page"><header><h1>Site</h1></header><div id="cookie-banner">We use cookies here, as you may '
            'know by now.</div><nav><a href="/">Home</a></nav><article><h2>Title &amp; more</h2><p>First&nbsp;<em>part</em>\n of  it.</p>'
            '<script>var x = "<p>no</p>";</script><!-- <p>no</p> --><p>Second &lt;b&gt;.</p><ul><li>One</li><li>Two <a href="x">linked</a></li></ul>'
            '<form><p>Send us your name and your address, please.</p></form></article><aside><p>A long text on the side of the page that '
            'nobody reads.</p></aside><div class="comments"><p>I read this with great joy and hope for more.</p></div><footer><p>The end of the page.'
            '</p></footer></body>')
    assert html_text.main_text(page, tree) == "Title & more\nFirst part of it.\nSecond <b>.\nOne\nTwo linked"


def test_edge_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "plain text without markup that is long enough to be read"), (4, "u", "<nav><a>x</a>"),
            (5, "u", "<article><p>unclosed <b>text"), (6, "u", "<<>> < p"), (6, "u", "<<>> < p"), (None, "u", "<script>x"),
            (7, "u", "<p>" + "word " * 50_000), (8, "u", "<article>a</p></div>b<p>c")]
    from pyspark.sql import functions as F
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x")).withColumn("n_chars", F.lit(0))
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    assert got[1].text == "" and got[1].n_chars == 0 and got[2].text == "" and got[4].text == "" and got[None].text == ""
    assert got[5].text == "unclosed text" and got[8].text == "a\nb\nc" and got[7].n_chars == 5 * 50_000 - 1
    assert html_text.extract(pages).count() == len(rows) and html_text.extract(pages.filter("page_id < 0")).count() == 0


def test_time_grows_with_the_page():
    start = time.time()
    for page in ("<p " + '"' * 200_000, "<" * 200_000, "<a '" * 50_000, "<!--" * 50_000, "<script>" * 30_000, "<p>" * 50_000,
                 "<div><p>x" * 20_000, "&amp" * 50_000, "</p>" * 50_000):
        html_text.blocks(page)
    assert time.time() - start < 20


def test_text_after_elements_without_end_tag():
    tree = html_text.fit()
    two = "<p>One.</p>{}<p>Two.</p></article>"
    for part in ('<svg class="i"/>', "<math/>", '<svg viewBox="0"><path d="x"/><title/></svg>', "<svg><path d='x'>", "<div><button>Menu</div>",
                 "<div><select><option>a<option>b</select></div>", "<div><select><option>a<option>b</div>", "<div><object data='x'>no</div>",
                 "<div><canvas>no</div>", "<div><button>a<button>b</button></div>", "<svg><foreignObject><p>no</p></foreignObject></svg>",
                 "<noscript><div><h2>no</h2></div></noscript>", "<template><p>no<li>no</template>", "<svg><style>p{}</style><title>no</title></svg>",
                 '<div data-x="' + "a > b " * 2000 + '"></div>', "<img alt='" + "x>" * 5000 + "'>"):
        assert html_text.main_text("<article>" + two.format(part), tree) == "One.\nTwo.", part[:60]
        assert html_text.main_text("<article>" + two.format(part) + "<svg><p>x</p></svg>", tree).startswith("One.\nTwo."), part[:60]
    assert [b[0] for b in html_text.blocks("<p>One <svg/>and <button><div>no</div></button>two</p>")] == ["One and two"]
    assert [b[0] for b in html_text.blocks("<p class=x'>One.</p><p>It's two.</p><p>He's three.</p>")] == ["One.", "It's two.", "He's three."]


def test_time_grows_with_unclosed_elements_and_values():
    start = time.time()
    for page in ("<button>" * 50_000, "<svg>" * 50_000 + "</p>" * 50_000, "<option>" * 50_000, "<svg><title>" * 30_000, '<a b=">" ' * 30_000,
                 "<a b='>c=\"" * 40_000, "<a" + " =" * 100_000, "<object><p>" * 30_000 + "</div>", "<svg><p>" * 30_000):
        html_text.blocks(page)
    assert time.time() - start < 20
