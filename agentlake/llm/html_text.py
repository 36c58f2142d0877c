"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into blocks at block-level tags. A block's features are its words and the share of them in links, the
same of the blocks before and after it, and what its enclosing elements say: inside an article or main element, or
inside page furniture (by tag, role, class or id; elements around the article itself say nothing). The tree is trained when first used, on the blocks of a few
labelled pages below.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose edges end a block.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a new one of the second set ends, if they are the nearest block open.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FURNITURE = frozenset("nav header footer aside form menu dialog select noscript template head title label search".split())
ARTICLE = frozenset(("article", "main"))
#: Words of class, id and role that name page furniture.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising alert banner bottombar breadcrumb breadcrumbs comment commentlist comments complementary consent contentinfo cookie cookies copyright disclaimer "
    "discussion disqus feedback footer gdpr header hidden login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion "
    "related replies reply respond search share sharing sidebar signup skyscraper social sponsor sponsored subscribe subscription teaser toolbar topbar widget widgets".split()
)
#: Words with which a class states a property of an element that is something else: no-sidebar, comments-open.
STATES = frozenset("no not non has have with without open closed enabled disabled allowed on off".split())
#: Furniture that stays so whatever it holds, and words that name readers' text, articles in it included.
FIXED = frozenset("nav header footer aside menu dialog".split())
READERS = frozenset("comment comments commentlist discussion disqus reply replies respond related".split())
#: Words that name furniture in any case; the others of HINTS may name a wrapper of the whole text.
SURE = READERS | frozenset("cookie cookies consent gdpr copyright disclaimer footer hidden login menu modal nav navbar navigation newsletter overlay popup signup subscribe subscription".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: A form of at least so many blocks of so many words, with over half of the page's words, is the page's frame.
FRAME_BLOCKS, FRAME_WORDS = 2, 15
#: Elements left out with all they hold, up to their first end tag. Without one, those of SCRIPT reach to the end of the
#: page, as in browsers; a self-closing or unclosed one of the others holds nothing.
SCRIPT = frozenset(("script", "style"))
RAW = SCRIPT | frozenset("textarea title xmp iframe noembed noframes noscript template svg object canvas video audio".split())
ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
START = re.compile(r"<(?:!--|[!?]|(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*))")
EDGE = re.compile(r"[>\"']")
NAMED = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
#: Pages whose texts are sent on together.
PAGES_AT_ONCE = 64
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "article", "furniture", "article_on_page")


@dataclass
class Hinted:
    """An element that looks like furniture: by its tag alone, or for readers' text; ``around``: it holds the article."""

    tag: str
    readers: bool
    around: bool = False


class Open(NamedTuple):
    """An open element with what it and those around it say: in an article, in which hinted elements, in a heading."""

    tag: str
    article: bool
    hinted: tuple[Hinted, ...]
    heading: bool


class Tag(NamedTuple):
    """A place of the page with its end: of a tag with its name in lower case, or without one of a comment or declaration."""

    start: int
    stop: int
    name: str = ""
    end: bool = False
    attrs: str = ""


class Tags:
    """A page's tags, found one after the other in time that is linear in its length, whatever is left unclosed.

    A tag ends at its first ``>`` outside quotes; a quote that isn't closed in the rest of the page counts as any other
    character. If quotes swallow all of a tag's ends, this tag and all later ones end at their first ``>``, so the rest
    isn't looked through once for each. Without a ``>`` ahead there is no tag, and without ``-->`` a comment has no end.
    """

    def __init__(self, page: str):
        self.page, self.last, self.quoted = page, {c: page.rfind(c) for c in ">\"'"}, True

    def _stop(self, at: int) -> int:
        i = at
        while self.quoted and (m := EDGE.search(self.page, i)):
            if m[0] == ">":
                return m.end()
            i = self.page.find(m[0], m.end()) + 1 if m.start() < self.last[m[0]] else m.end()
        self.quoted = False
        return self.page.find(">", at) + 1

    def after(self, at: int) -> Tag | None:
        while m := START.search(self.page, at):
            if m[0] == "<!--":
                stop = self.page.find("-->", m.end())
                return Tag(m.start(), stop + 3 if stop >= 0 else len(self.page))
            if m.end() > self.last[">"]:
                return None
            if not m["tag"]:
                return Tag(m.start(), self.page.find(">", m.end()) + 1)
            stop = self._stop(m.end())
            return Tag(m.start(), stop, m["tag"].lower(), bool(m["end"]), self.page[m.end() : stop - 1])
        return None


def _says(tag: str, attrs: str, classes: bool) -> tuple[bool, bool, bool]:
    """(article, furniture, readers' text) for an element. Without ``classes`` only words that are SURE name furniture."""
    article, furniture, readers = tag in ARTICLE, tag in FURNITURE, False
    if attrs.strip():
        for name, a, b, c in NAMED.findall(attrs):
            value = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", a or b or c).lower()
            article |= name.lower() == "role" and value == "main" or value.replace(" ", "") == "articlebody"
            for token in value.split():
                words = {w for w in re.split(r"[^a-z]+", token) if w}
                if words & (HINTS if classes else SURE) and not words & STATES and tag not in ("html", "body"):
                    furniture, readers = True, readers or bool(words & READERS)
        furniture |= bool(HIDDEN.search(attrs))
    return article, furniture, readers


def text_blocks(page: str, classes: bool = True) -> list[tuple[str, int, int, bool, bool]]:
    """(text, words, words in links, article, furniture) for each block with text, in page order."""
    found: list[tuple[str, int, int, int, Open]] = []
    stack: list[Open] = []
    held: list[str] = []
    inside: dict[str, list[str]] = {"a": [], "button": []}
    depth = {"a": 0, "button": 0}
    nothing = Open("", False, (), False)

    def add(text: str) -> None:
        held.append(text)
        for name, n in depth.items():
            if n > 0:
                inside[name].append(text)

    def flush() -> None:
        words = " ".join(html.unescape("".join(held)).split()) if held else ""
        if words:
            linked, pressed = (len(html.unescape(" ".join(inside[name])).split()) for name in ("a", "button"))
            found.append((words, words.count(" ") + 1, linked, pressed, stack[-1] if stack else nothing))
        held.clear()
        for x in inside.values():
            x.clear()

    def close(at: int) -> None:
        for x in stack[at:]:
            if x.tag in depth:
                depth[x.tag] -= 1
        del stack[at:]

    at = 0
    unclosed: set[str] = set()  # names of RAW without an end tag in the rest of the page
    tags = Tags(page)
    while m := tags.after(at):
        if m.start > at:
            add(page[at : m.start])
        at, tag = m.stop, m.name
        if not tag:
            continue
        if tag in RAW and not m.end and (tag in SCRIPT or not m.attrs.endswith("/")):
            if tag not in unclosed and (close_tag := ENDS[tag].search(page, at)):
                at = close_tag.end()
                continue
            if tag in SCRIPT:
                at = len(page)
                continue
            unclosed.add(tag)
        block = tag in BLOCK
        if block:
            flush()
        elif tag == "br":
            held.append(" ")
        if m.end:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
                if not block and stack[k].tag in BLOCK:
                    break
            continue
        if block:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == "p" or stack[k].tag in IMPLIED.get(tag, ()):
                    close(k)
                    break
                if stack[k].tag in BLOCK:
                    break
        if tag not in VOID and tag not in RAW and not m.attrs.endswith("/"):
            around = stack[-1] if stack else nothing
            article, furniture, readers = _says(tag, m.attrs, classes)
            hinted = (*around.hinted, Hinted(tag, readers)) if furniture else around.hinted
            stack.append(Open(tag, around.article or article, hinted, around.heading or tag in HEADINGS))
            if tag in depth:
                depth[tag] += 1
            if article and not furniture or tag == "h1":
                for x in around.hinted:
                    x.around |= x.tag == "form" or article and x.tag not in FIXED and not x.readers
    if at < len(page):
        add(page[at:])
    flush()
    return _judged(found)


def _judged(found: list[tuple[str, int, int, int, Open]]) -> list[tuple[str, int, int, bool, bool]]:
    words = sum(x[1] for x in found)
    forms: dict[int, tuple[Hinted, int, int]] = {}
    for _, n, links, _, at in found:
        for x in at.hinted:
            if x.tag == "form":
                _, total, large = forms.get(id(x), (x, 0, 0))
                forms[id(x)] = x, total + n, large + (n - links >= FRAME_WORDS)
    for x, total, large in forms.values():
        x.around |= 2 * total > words and large >= FRAME_BLOCKS
    out = []
    for text, n, links, pressed, at in found:
        left = [x for x in at.hinted if not x.around]
        # an article's own header holds its headline
        headline = at.article and at.heading and all(x.tag == "header" and not x.readers for x in left)
        out.append((text, n, links, at.article, pressed >= n or bool(left) and not headline))
    return out


def features(blocks: list[tuple[str, int, int, bool, bool]]) -> np.ndarray:
    """A row of FEATURES for each block."""
    words = np.array([b[1] for b in blocks], dtype=float)
    links = np.array([b[2] for b in blocks]) / np.maximum(words, 1)
    before = lambda x: np.concatenate([[0.0], x[:-1]])
    after = lambda x: np.concatenate([x[1:], [0.0]])
    article, furniture = (np.array([b[k] for b in blocks], dtype=float) for k in (3, 4))
    return np.stack([words, links, before(words), before(links), after(words), after(links), article, furniture, np.full(len(words), article.max(initial=0.0))], axis=1)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6) -> tuple:
    """A CART tree: (feature, bound, below or equal, above) or the label of a leaf."""
    if depth == 0 or y.min() == y.max():
        return (bool(2 * y.sum() > len(y)),)
    best = None
    for f in range(x.shape[1]):
        for bound in (lambda v: (v[1:] + v[:-1]) / 2)(np.unique(x[:, f])):
            low = x[:, f] <= bound
            score = sum(s.sum() * (p := y[s].mean()) * (1 - p) for s in (low, ~low))
            if best is None or score < best[0] - 1e-12:
                best = (score, f, bound, low)
    if best is None:
        return (bool(2 * y.sum() > len(y)),)
    _, f, bound, low = best
    return (f, float(bound), grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


def classify(tree: tuple, row) -> bool:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0]


_LONG = "The committee published its findings after a year of interviews with residents of the valley and the towns nearby"
_NAV = '<ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/a">About us</a></li></ul>'
#: The labelled table: pages whose blocks that begin with * are main text (the mark isn't part of the page).
LABELLED_PAGES = (
    f"<title>A report</title><nav>{_NAV}</nav><div class=ad>Buy now and save on shoes today only.</div><article><h1>*A report</h1><p>*{_LONG}.</p><p>*Yes.</p><p>*<a href=x>See also the second part</a></p></article><footer>All rights reserved</footer>",
    f"<header><h2>The Daily Page</h2></header><nav>{_NAV}</nav><main><h1>*On rivers</h1><p>*{_LONG}, {_LONG}.</p><aside>Also of interest to readers of this page</aside><p>*{_LONG}.</p><section class=comments><p>I disagree with all of this, {_LONG}.</p></section></main><footer><a href=c>Contact</a></footer>",
    f"<div id=menu>{_NAV}</div><div><h1>*On hills</h1><p>*{_LONG}.</p><p>*Not so fast.</p><p>*{_LONG}, {_LONG}.</p></div><div class=sidebar><p>{_LONG}.</p></div><div class=footer>Imprint</div>",
    f"<div>{_NAV}</div><h1>*Lakes of the north</h1><p>*{_LONG}.</p><p>*They left early.</p><p>*{_LONG}.</p><ul><li><a href=1>One</a></li><li><a href=2>Two more</a></li></ul><p><a href=3>Next page</a></p>",
    f"<div class='cookie notice'>This site uses cookies to give you the best service, {_LONG}.</div><div role=main><p>*{_LONG}.</p><form><label>Your name</label><p>Send us a line, {_LONG}</p><button>Send</button></form><p>*Then it rained.</p></div><div>Copyright of the owners</div>",
    f"<p><a href=1>Home</a> <a href=2>Archive</a> <a href=3>Help</a></p><p>*{_LONG} and <a href=4>those beyond</a> who came.</p><p>*{_LONG}.</p><p><a href=1>Home</a> <a href=2>Archive</a></p>",
    f"<div>{_NAV}</div><article><p>*{_LONG}.</p></article><div><p>{_LONG}.</p></div><div>{_NAV}</div>",
    "<article><h1>*Short</h1><p>*One.</p><p>*Two words.</p><ul><li>*<a href=x>Three</a></li></ul></article><div>Four</div>",
    f"<p>*{_LONG}.</p>",
    "<p>*A short page.</p>",
    f"<div class=banner>{_LONG}.</div><p>*It was cold.</p><p>*{_LONG}.</p>",
    f"<article><header>The Valley Post</header><p>*{_LONG}.</p><footer>Filed under weather</footer></article><nav>{_NAV}</nav>",
    f"<form id=aspnet><div>{_NAV}</div><h1>*A framed page</h1><p>*{_LONG}.</p><p>*Rain came.</p><p>*{_LONG}, {_LONG}.</p><div class=footer>Terms of use</div></form>",
    f"<div class='page no-sidebar'><nav>{_NAV}</nav><article class='post comments-open'><header><h1>*On dikes</h1><p>By a writer, {_LONG}</p></header><p>*{_LONG}.</p><p>*Press <button>stop</button> to end it.</p><div class=comments><article><p>Well said, {_LONG}.</p></article></div></article></div>",
    f"<article><h1>*Short</h1><p>*{_LONG}.</p><p>*The end.</p></article>",
    "<article><p>*One.</p><p>*Two.</p></article>",
    f"<nav>{_NAV}</nav><main><p>*{_LONG}.</p><p>*{_LONG}, {_LONG}.</p></main>",
    "<article>*word</article>",
    f"<div class=header><h1>The Hill Gazette</h1></div><div><h2>*Snow on the pass</h2><p>*{_LONG}.</p><p>*{_LONG}, {_LONG}.</p></div><div class='related'><h2>More</h2><p>{_LONG}.</p></div>",
)


def labelled_pages(n: int = 240, seed: int = 11) -> list[str]:
    """More of the labelled table, made by rule: articles in and without elements of their own, of paragraphs of any
    length, lists and links, framed by elements that hold all of the page, between every kind of furniture."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abdeiklmnorstu", k=k)) for k in (2, 3, 4, 5, 6, 7, 9) for _ in range(40)]
    some = lambda k: " ".join(r.choices(vocabulary, k=k))
    links = lambda k: "<ul>" + "".join(f"<li><a href=/{i}>{some(r.choice([1, 2, 3]))}</a></li>" for i in range(k)) + "</ul>"
    block = lambda tag, k: f"<{tag}>{some(k)}.</{tag}>"
    size = lambda: int(2 ** r.uniform(0, 7))  # noqa: E731 - any length, wherever the text stands
    pages = []
    for _ in range(n):
        home = r.choice(["article", "main", "div role=main", "div itemprop=articleBody", "article class='post comments-open'", "div", "div", ""])
        own = home not in ("div", "")
        text = [f"<h1>*{some(r.randrange(1, 9))}</h1>"] if r.random() < 0.8 else []
        text[:0] = [f"<header>{text.pop()}<p>{some(4)}</p></header>"] if text and own and r.random() < 0.3 else []
        for _ in range(r.randrange(2, 8)):
            k = size() if own else r.randrange(4, 120)
            text.append(f"<p>*{some(k)} " + (f"<a href=x>{some(max(1, k // 8))}</a> {some(k)}" if k > 7 and r.random() < 0.3 else "") + ".</p>")
            if own and r.random() < 0.2:
                text.append(r.choice([f"<ul><li>*{some(3)}</li><li>*<a href=y>{some(2)}</a></li></ul>", f"<aside>{block('p', size())}</aside>", f"<div class='share-tools'>{links(3)}</div>", f"<p>*<a href=z>{some(5)}</a></p>"]))
        body = "".join(text)
        if own and r.random() < 0.3:
            body += f"<div id=comments><p>{some(size())}.</p><article class=comment>{block('p', size())}</article></div>"
        body = f"<{home}>{body}</{home.split()[0]}>" if home else body
        above = r.sample([f"<nav>{links(5)}</nav>", f"<div>{links(6)}</div>", f"<div class=ad>{some(size())}</div>", f"<header>{block('h2', 3)}</header>", f"<div class='cookie-notice'>{block('p', size())}</div>", f"<div id=menu>{links(4)}</div>", f"<div class=header><h1>{some(3)}</h1></div>"], r.randrange(0, 4))
        below = r.sample([f"<footer>{some(size())}</footer>", f"<div>{links(5)}</div>", f"<div class=sidebar>{block('p', size())}</div>", f"<section class=related><article>{block('p', size())}</article></section>", f"<form>{block('p', size())}</form>", f"<div class='footer-area'>{some(size())}</div>", *([f"<div>{block('p', size())}</div>", f"<div>{block('p', size())}</div>"] if own else [])], r.randrange(0, 4))
        page = "".join(above) + body + "".join(below)
        if own and r.random() < 0.3:
            open_, close = r.choice([("<div class='page no-sidebar'>", "</div>"), ("<form id=f>", "</form>"), ("<div class='widget wrap'>", "</div>")])
            page = open_ + page + close
        pages.append(page)
    return pages


@cache
def trained_tree() -> tuple:
    x, y = [], []
    for page in (*LABELLED_PAGES, *labelled_pages()):
        marked = text_blocks(page)
        x.append(features([(t.lstrip("*"), *rest) for t, *rest in marked]))
        y += [b[0].startswith("*") for b in marked]
    return grow(np.concatenate(x), np.array(y, dtype=float))


def main_text(page: str, tree: tuple) -> str:
    """The blocks that the tree takes; if it takes none, those that it takes when only SURE words of classes, ids and roles
    name furniture, so that no page is emptied by the words of its wrappers."""
    for classes in (True, False):
        blocks = text_blocks(page, classes)
        taken = [b[0] for b, row in zip(blocks, features(blocks).tolist(), strict=True) if classify(tree, row)] if blocks else []
        if taken:
            break
    return "\n".join(taken)


def _extract(batches: Iterator[pa.RecordBatch], tree: tuple) -> Iterator[pa.RecordBatch]:
    small = (batch.slice(a, PAGES_AT_ONCE) for batch in batches for a in range(0, batch.num_rows, PAGES_AT_ONCE))
    for batch in small:
        texts = [main_text(page.as_py() or "", tree) for page in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``. Null or empty html gives an empty text, an empty table no rows;
    repeated rows come out alike; other columns are ignored. One pass, no shuffle; a page is read whole, however long, in
    time that grows with its length."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(partial(_extract, tree=trained_tree()), "page_id long, url string, text string, n_chars long")
