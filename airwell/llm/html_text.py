"""Main text of HTML pages: flat blocks, classified by a decision tree.

A page is cut into flat text blocks at block-level tags.  A block is described
by its word count, its link density, both of its neighbours too, whether it
ends like a sentence, and by where it stands (inside an element that names
itself a menu, header, footer, sidebar, notice, advert, form or comment list;
inside an article or main element; a heading).  A decision tree, grown here on
the small labelled table below, tells main text from the rest.

Names are whole words of a class, id or role at its first or last place
(``site-footer``, ``ad-box``); words that tell a state of the page
(``has-sidebar``, ``header-fixed``) name nothing.  ``html`` and ``body`` name
nothing either, and an article or main element inside a wrapper counts more than
the wrapper's layout name (a comment list or a box of related pages stays one).
A ``header`` inside an article is the article's own.

Defined edge results: a null or empty page, and a page without main text, give
the empty string; scripts, styles, markup comments and the head never give
text; unclosed elements end where an enclosing element ends, except those
of raw text (scripts, styles, titles, text fields, frames); repeated rows
agree; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airwell.llm._common import map_arrow, values_of

MAX_DEPTH = 8
FEATURES = ("words", "link_density", "words_before", "link_before", "words_after", "link_after",
            "sentence", "named_away", "in_article", "heading")

# Element names and name parts.
SKIPPED = ("script", "style", "noscript", "template", "head", "svg", "math", "iframe", "object", "canvas",
           "textarea", "select", "option", "title", "button")
RAW = ("script", "style", "textarea", "title", "iframe")   # these run to their end tag, or to the end of the page
FOREIGN = ("svg", "math")       # elements may close themselves in these, and page elements end them, except inside HOSTS
HOSTS = ("foreignobject", "desc", "title", "annotation-xml", "mi", "mo", "mn", "ms", "mtext")
ENDS_FOREIGN = ("b", "big", "blockquote", "body", "br", "center", "code", "dd", "div", "dl", "dt", "em", "embed", "h1", "h2", "h3",
                "h4", "h5", "h6", "head", "hr", "i", "img", "li", "listing", "menu", "meta", "nobr", "ol", "p", "pre", "ruby", "s",
                "small", "span", "strong", "strike", "sub", "sup", "table", "tt", "u", "ul", "var")
AWAY_TAGS = ("nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset")
AWAY_NAMES = ("nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar",
              "side", "ad", "ads", "advert", "adverts", "advertisement", "banner", "promo", "sponsor", "sponsored",
              "cookie", "cookies", "consent", "notice", "notices", "popup", "modal", "newsletter", "subscribe", "login",
              "signup", "search", "share", "social", "related", "recommended", "comment", "comments", "disqus", "reply",
              "replies", "respond", "widget", "pagination", "pager", "copyright", "toolbar", "skip", "form")
AWAY_ROLES = ("navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "dialog", "alert")
# names of boxes that stay away even where they hold article elements; the others may be the page's layout
BOX_NAMES = ("related", "recommended", "comment", "comments", "disqus", "reply", "replies", "respond", "newsletter", "popup", "modal",
             "cookie", "cookies", "consent", "widget", "ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored")
STATE_STARTS = ("no", "has", "with", "without", "is", "not", "js", "layout", "page", "theme", "template", "show", "hide", "hidden", "enable")
STATE_ENDS = ("fixed", "sticky", "open", "opened", "closed", "collapsed", "active", "enabled", "disabled", "hidden", "visible", "transparent",
              "offset", "padding", "page", "layout", "above", "below", "on", "off", "loaded")
ARTICLE_TAGS = ("article", "main")
ARTICLE_NAMES = ("article", "content", "main", "post", "entry", "story", "body")
INLINE = ("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i",
          "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong",
          "sub", "sup", "time", "tt", "u", "var", "wbr", "input")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
REPEATED = ("p", "li", "td", "tr", "dt", "dd")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")

# Labelled table: parts of small pages and whether their text is main text (1) or not (0).
LABELLED = [
    [('<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">About us</a></li></ul></nav>', 0),
     ('<div class="ad">Buy the new tea set now and save a third of the price until Sunday evening. Free delivery.</div>', 0),
     ('<article><h1>The harbour opens again</h1>', 1), ('<p>After two years of work the old harbour opened on Monday. Boats came in from '
      'the islands, and the mayor spoke of a good day for the town and for all who live from the sea.</p>', 1),
     ('<p>Rain.</p>', 1), ('<p>The first ferry left at noon with <a href="/x">some guests</a> on board.</p>', 1),
     ('<p>Everyone stayed late.</p></article>', 1),
     ('<footer>&copy; harbour.example.org &middot; All about the sea and the people who work on it.</footer>', 0)],
    [('<header><a href="/">The Daily Page</a><p>News from the valley since 1950.</p></header>', 0),
     ('<main><h2>A short note</h2>', 1), ('<p>No.</p>', 1), ('<p>Maybe later, said the baker, and closed the door.</p>', 1),
     ('<aside class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Ten ways to bake</a></li>'
      '<li><a href="/2">The long road home</a></li></ul></aside>', 0),
     ('<p>On the next day the shop was open as usual, and there was bread for everyone who came before eight.</p></main>', 1),
     ('<section class="comments"><h3>Comments</h3><p>I think that this is a very good article and I would like to read more of '
      'them in the coming weeks.</p><p>Me too.</p></section>', 0),
     ('<footer><p>Imprint and contact. We answer every letter that reaches us before the end of the month.</p></footer>', 0)],
    [('<div class="cookie-notice"><p>We use cookies to make this page better for you and to count our visitors.</p></div>', 0),
     ('<div id="menu"><a href="/a">Start</a> <a href="/b">Shop</a></div>', 0),
     ('<div id="content"><h1>How to plant a tree</h1>', 1), ('<p>Dig a hole that is twice as wide as the roots. Water it well.</p>', 1),
     ('<ul><li>A spade</li>', 1), ('<li>Good <a href="/e">earth</a></li>', 1), ('<li>Ten <a href="/w">litres of water</a></li></ul>', 1), ('<blockquote>Who plants a tree plants hope.</blockquote>', 1),
     ('<p>Read <a href="/soil">our long guide to soils</a> too.</p></div>', 1),
     ('<form action="/s"><p>Your name and your address, please</p><input name="n"></form>', 0),
     ('<div class="related"><p><a href="/p1">Roses in June and how to cut them</a></p></div>', 0)],
    [('<p><a href="/">Home</a> | <a href="/news">News</a> | <a href="/shop">Shop</a></p>', 0),
     ('<h1>An old page without any layout</h1>', 1),
     ('<p>This page was written by hand many years ago. It tells of a journey through the mountains in the winter of that year, '
      'of the snow on the passes and of the people in the huts.</p>', 1),
     ('<p>We walked for nine days and met nobody but a shepherd, who gave us cheese and a map of the next valley.</p>', 1),
     ('<p><a href="/a">Back</a> <a href="/b">Next page</a></p>', 0), ('<p>Last change: May</p>', 0)],
    [('<ul class="breadcrumbs"><li><a href="/">Start</a></li><li>Garden</li></ul>', 0),
     ('<article><p>Bees.</p>', 1), ('<p>Bees need flowers from early spring to late autumn, and a quiet place for the winter.</p>', 1),
     ('<h2>Food</h2>', 1), ('<p>See <a href="/w">what we wrote about willows last spring and why they matter</a>.</p>', 1),
     ('<div class="newsletter"><p>Leave your address and get a letter from us on every first Friday of the month.</p></div>', 0),
     ('<p>One.</p></article>', 1), ('<div role="contentinfo">Made with care by the people of the garden club.</div>', 0)],
    [('<ul><li><a href="/1">Ten good ways to bake bread at home</a></li>', 0), ('<li><a href="/2">What the winter brings to the islands this year</a></li></ul>', 0),
     ('<p>The lamp in the tower burned every night for ninety years, and every night somebody climbed the stairs to light it.</p>', 1),
     ('<p>Then came the motor.</p>', 1),
     ('<p>Today the stairs are empty, and a small machine turns the light on at dusk and off at dawn without any help at all.</p>', 1),
     ('<p><a href="/3">All stories from the coast and the sea in one place</a></p>', 0), ('<p>Print this</p>', 0)],
    [('<article><h1>Snow</h1>', 1), ('<p>It snowed.</p>', 1), ('<h2>In the north</h2>', 1), ('<p><a href="/4">The whole report on the snow in the north</a></p>', 1),
     ('<p>It snowed again.</p></article>', 1)],
    [('<p>A single paragraph may be a whole page, when its writer had nothing else to say and no wish to sell anything.</p>', 1)],
    [('<p>the writer of this page knew no full stops and no capital letters but went on from word to word and from line to line '
      'as one does on a long walk along the sea when the wind is loud and the next house is far away</p>', 1)],
    [('plain words without any tags around them were the whole of this page for as long as the server could be reached', 1)],
    [('<div><a href="/5">All pages</a></div>', 0), ('<article><p>Wind</p></article>', 1)],
    [('<article><p>Sun</p></article>', 1), ('<div>Page 5</div>', 0)],
    # layouts without names: what stands next to lists of links is not main text
    [('<div><p>Most read</p>', 0), ('<p><a href="/1">How the mill was saved by its neighbours</a></p>', 0),
     ('<p><a href="/2">Twelve boats and one storm in the bay</a></p></div>', 0),
     ('<div><h1>The mill by the river</h1>', 1), ('<p>The mill has ground the corn of three villages since the bridge was built, and nobody '
      'remembers a year in which its wheel stood still for longer than a week.</p>', 1), ('<p>Until now.</p>', 1),
     ('<p>In the spring the river changed its bed after a long rain, and the wheel hangs above dry stones while the miller waits for help '
      'from the county.</p></div>', 1),
     ('<div><p>More good stories from our town</p>', 0), ('<p><a href="/3">A bridge for the people on the other side</a></p>', 0),
     ('<p><a href="/4">The last baker of the upper valley</a></p></div>', 0), ('<div><p>Contact</p>', 0), ('<p><a href="/5">Imprint of this page</a></p></div>', 0)],
    [('<div><a href="/">Start</a></div>', 0), ('<div>Our shop</div>', 0), ('<div><a href="/s">All offers of the week</a></div>', 0),
     ('<div><p>The winter came early in that year, and the children walked to the school on paths that the men had cut through the snow '
      'in the night before.</p>', 1), ('<p>It was quiet.</p>', 1),
     ('<p>Only the dogs were heard from farm to farm, and sometimes the bell of the sledge that brought the letters from the town below.</p></div>', 1),
     ('<div>Top of the page</div>', 0), ('<div><a href="#top">Back to the top of it</a></div>', 0)],
    [('<div><h1>Salt</h1>', 1), ('<p>Salt came over the pass on mules, two sacks to an animal, and paid for the houses that still stand around '
      'the square with their painted walls.</p>', 1), ('<h2>The trade</h2>', 1),
     ('<p>In good years four hundred mules went up in a week, and the toll at the upper gate fed the whole valley until the railway was '
      'built.</p></div>', 1),
     ('<div><p>What other readers of this page liked</p>', 0), ('<p><a href="/7">The road of the iron and its seven inns</a></p>', 0),
     ('<p>Pages that belong to the same subject</p>', 0), ('<p><a href="/8">How glass came to the islands of the lagoon</a></p></div>', 0)],
    # a title outside of the article, and what an article's own header holds
    [('<h1>Two wells and a garden</h1>', 1), ('<article><header><h2>Water</h2></header>', 1),
     ('<p>Both wells are older than the house, and both were dug by hand in a summer without rain by the sisters who lived here.</p></article>', 1),
     ('<div><p><a href="/6">Other gardens of the region</a></p></div>', 0)],
    [('<div class="has-sidebar"><div class="content"><h1>Bells</h1>', 1), ('<p>There are four.</p>', 1),
     ('<p>Three of them came from the old church across the river, which was given up after the flood.</p></div>', 1),
     ('<div class="sidebar"><p>All bells of the land on a map that you can order here for little money and good friends.</p></div></div>', 0)],
]

_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*+)")
_TAG_MARK = re.compile(r">|=\s*+[\"']")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[a-z]+")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("head", *RAW)}


def _place(name: str, rest: str, in_article: bool = False) -> str:
    """'away' (a box whatever it holds), 'layout' (away unless an article is inside), 'article' or '' for an opening tag."""
    if name in ("html", "body"):
        return ""
    if name in AWAY_TAGS and not (name == "header" and in_article):
        return "away"
    found = "article" if name in ARTICLE_TAGS else ""
    for key, *values in _ATTRIBUTE.findall(rest) if rest else ():
        for token in "".join(values).lower().split():
            words = _PART.findall(token)
            if key.lower() == "role":
                if token in AWAY_ROLES:
                    return "away"
                continue
            if not words or words[0] in STATE_STARTS and len(words) > 1 or words[-1] in STATE_ENDS:
                continue
            if words[0] in ARTICLE_NAMES and words[-1] in ("header", "title", "heading"):
                continue
            own = [w for w in (words[0], words[-1]) if w in AWAY_NAMES]
            if any(w in BOX_NAMES for w in own):
                return "away"
            if own and found != "article":
                found = "layout"
            elif not found and any(w in ARTICLE_NAMES for w in words):
                found = "article"
    return found


def _tag_end(page: str, at: int, dead: set[int]) -> int:
    """Where a tag ends: after the first ``>`` outside of quoted values, or if
    there is none, after the first one.  ``dead``: marks from which none was found."""
    seen, start = [], at
    while (m := _TAG_MARK.search(page, at)) and m.start() not in dead:
        if m[0] == ">":
            return m.end()
        seen.append(m.start())
        at = page.find(m[0][-1], m.end()) + 1
        if at == 0:
            break
    dead.update(seen)
    return page.find(">", start) + 1


def blocks(page: str) -> list[tuple[str, int, int, bool, bool, bool]]:
    """Flat text blocks: (text, words, words in links, named away, in article, heading)."""
    out: list = []
    stack: list[tuple[str, str]] = []
    opened: Counter = Counter()     # open elements by name, and by place
    parts: list[tuple[str, bool]] = []
    dead: set[int] = set()
    links = 0
    skipped = 0     # depth of the outermost open element without text
    outer: list[int] = []       # layout names that are open outside of each open article or main element

    def push(name: str, place: str):
        stack.append((name, place))
        if name in ARTICLE_TAGS:
            outer.append(opened["/layout"])
        opened.update((name, f"/{place}", "/heading" if name in HEADINGS and not skipped else "/"))

    def pop():
        nonlocal skipped
        name, place = stack.pop()
        if name in ARTICLE_TAGS:
            outer.pop()
        opened.subtract((name, f"/{place}", "/heading" if name in HEADINGS and not skipped else "/"))
        if len(stack) < skipped:
            skipped = 0

    def close(name: str):
        while stack[-1][0] != name:
            pop()
        pop()

    def flush():
        text = " ".join("".join(p for p, _ in parts).split())
        if text:
            linked = sum(len(p.split()) for p, in_link in parts if in_link)
            words = len(text.split())
            away = opened["/away"] > 0 or opened["/layout"] > (outer[-1] if outer else 0)
            out.append((text, words, min(words, linked), away, opened["/article"] > 0, opened["/heading"] > 0))
        parts.clear()

    at, end = 0, len(page)
    while at < end:
        stop = page.find("<", at)
        stop = end if stop < 0 else stop
        if stop > at and not skipped:
            parts.append((html.unescape(page[at:stop]), links > 0))
        if stop == end:
            break
        if page.startswith(("<!", "<?"), stop):
            closer = "-->" if page.startswith("<!--", stop) else "]]>" if page.startswith("<![CDATA[", stop) else ">"
            at = page.find(closer, stop + 2)
            at = end if at < 0 else at + len(closer)
            continue
        m = _NAME.match(page, stop + 1)
        if m is None:       # a bare "<" is text
            if not skipped:
                parts.append(("<", links > 0))
            at = stop + 1
            continue
        at = _tag_end(page, m.end(), dead)
        if at == 0:         # the page ends inside a tag
            break
        rest = page[m.end():at - 1]
        name, closing = m[1].lower(), page[stop + 1] == "/"
        foreign = opened["svg"] > 0 or opened["math"] > 0
        if foreign and not closing and name in ENDS_FOREIGN and not any(opened[h] > 0 for h in HOSTS):
            while opened["svg"] > 0 or opened["math"] > 0:
                pop()
            foreign = False
        if name in _RAW_END and not foreign:
            if not closing:
                done = _RAW_END[name].search(page, at)
                if name != "head":
                    at = done.end() if done else end
                elif done:
                    at = done.end()
            continue
        if name in SKIPPED:
            if closing:
                if opened[name] > 0:
                    close(name)
            elif not ((foreign or name in FOREIGN) and rest.endswith("/")):
                if name == "option" and stack and stack[-1][0] == name or name == "button" and opened[name] > 0:
                    close(name)
                push(name, "")
                skipped = skipped or len(stack)
            continue
        if name in INLINE:
            if skipped:
                continue
            if name == "br":
                parts.append((" ", False))
            elif name == "a":
                links = 0 if closing else 1
            continue
        if skipped and closing and opened[name] > 0:
            while skipped and stack[-1][0] != name:
                pop()
            if skipped:
                pop()
                continue
        if not skipped:
            flush()
            links = 0
        if closing:
            if opened[name] > 0:
                close(name)
        elif name not in VOID and not rest.rstrip().endswith("/"):
            if name in REPEATED or name in HEADINGS:    # these end the paragraph, heading or item before them
                while stack and (stack[-1][0] in ("p", *HEADINGS) or (stack[-1][0] == name and name in REPEATED)):
                    pop()
            push(name, "" if skipped else _place(name, rest, opened["article"] + opened["main"] > 0))
    flush()
    return out


def feature_rows(found: list) -> np.ndarray:
    """One row of FEATURES per block."""
    n = len(found)
    x = np.zeros((n + 2, 2))
    for i, b in enumerate(found):
        x[i + 1] = b[1], b[2] / b[1]
    own = np.array([[b[0][-1] in ".!?…:\"'»”", b[3], b[4], b[5]] for b in found], dtype=float).reshape(n, 4)
    return np.concatenate([x[1:-1], x[:-2], x[2:], own], axis=1)


def labelled_rows() -> tuple[np.ndarray, np.ndarray]:
    """Features and classes of the labelled table's blocks."""
    rows, classes = [], []
    for page in LABELLED:
        text, marks = "", []
        for part, label in page:
            before = len(blocks(text)) if text else 0
            text += part
            marks += [label] * (len(blocks(text)) - before)
        rows.append(feature_rows(blocks(text)))
        classes += marks
    return np.concatenate(rows), np.array(classes)


def grow(x: np.ndarray, y: np.ndarray, depth: int = MAX_DEPTH):
    """A tree by Gini impurity: a class, or (feature, threshold, tree up to it, tree above it)."""
    share = y.mean()
    if depth == 0 or share in (0.0, 1.0):
        return int(share >= 0.5)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= t
            p, q = y[low].mean(), y[~low].mean()
            gini = low.sum() * p * (1 - p) + (~low).sum() * q * (1 - q)
            if best is None or gini < best[0] - 1e-12:
                best = (gini, f, t, low)
    if best is None or best[0] >= len(y) * share * (1 - share) - 1e-12:
        return int(share >= 0.5)
    _, f, t, low = best
    return f, float(t), grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


def classify(tree, x: np.ndarray) -> np.ndarray:
    """The class of every row."""
    out = np.zeros(len(x), dtype=bool)
    work = [(tree, np.arange(len(x)))]
    while work:
        node, at = work.pop()
        if isinstance(node, tuple):
            low = x[at, node[0]] <= node[1]
            work += [(node[2], at[low]), (node[3], at[~low])]
        else:
            out[at] = bool(node)
    return out


def fit():
    """The tree of the labelled table."""
    return grow(*labelled_rows())


def main_text(page: str | None, tree) -> str:
    """The main text of a page, its blocks joined by line feeds."""
    found = blocks(page) if page else []
    if not found:
        return ""
    keep = classify(tree, feature_rows(found))
    return "\n".join(b[0] for b, k in zip(found, keep) if k)


def _extract(tree):
    def run(batches):
        for batch in batches:
            texts = [main_text(p, tree) for p in values_of(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])
    return run


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    t = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html"))
    id_type = t.schema["page_id"].dataType.simpleString()
    return map_arrow(t, _extract(fit()), f"page_id {id_type}, url string, text string, n_chars long")
