"""Main text of web pages by composite text density.

Each element of a page's tree has characters C, tags T, characters in links LC and tags in links LT. Its composite density
is characters per tag, scaled by a logarithm of how few of them are links, whose base grows with the links' share in the
element and in the whole body. The density sum of an element is the sum over its children; the subtree of the largest
density sum is the article's core. The smallest density on its path up to the body is the threshold by which elements
around the core count as part of the article, headings beside it do as well. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are
known by tag, role and class and never count or appear. A class, an id or a form tag is no proof: an element known by that
only is kept if it holds the page's main element, its article, or, with no article elsewhere, most of the text outside links.

White space inside a block becomes one blank, blocks are joined by one blank in page order, references are decoded; nothing
else is dropped. A null, empty or textless page gives an empty text. Broken markup is read as browsers do in the common
cases (tags left open, stray end tags, attributes without quotes); nesting of any depth is read without recursion and in a
time that grows with the page.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_batches, texts_of

_TOKEN = re.compile(r"<(?:(!--)|([/]?)([a-zA-Z][^\s/>]*)|([!?]))")
_TAG_END = re.compile(r"[^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+>")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|([^\s=/>\"']+)")
_NAME = re.compile(r"[a-z]+")

# Elements and names of HTML, and class names in common use.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
_NO_CONTENT = frozenset("script style noscript template iframe object embed applet svg math canvas audio video map head title nav footer aside button select textarea input label fieldset dialog menu noembed noframes".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_CLASSES = frozenset("ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promoted promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay lightbox newsletter subscribe subscription signup nav navbar navigation navi menu menus submenu breadcrumb breadcrumbs sidebar sidebars aside rail widget widgets footer foot header masthead topbar comment comments commentlist disqus replies respond related recommended recommendations share sharing social toolbar pagination pager search login skip".split())
#: Classes that name the page's head only outside an article.
_HEADS = frozenset(("header", "masthead", "banner"))
#: Parts of a class name by which it speaks of something else, and what follows "ad" where that is an advert.
_NEGATIONS = frozenset("no not non has with without hide".split())
_AD_PARTS = frozenset("ad ads adv banner block bottom box break container content area frame inner left middle outer right side sidebar slot space top unit wrap wrapper zone".split())
#: Reader comments, however long they are.
_COMMENTS = frozenset("comment comments commentlist disqus replies respond".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CLOSED_BY = {  # an open element and the start tags that end it
    "li": frozenset(("li",)),
    "dt": frozenset(("dt", "dd")),
    "dd": frozenset(("dt", "dd")),
    "tr": frozenset(("tr", "tbody", "thead", "tfoot")),
    "td": frozenset(("td", "th", "tr", "tbody", "thead", "tfoot")),
    "th": frozenset(("td", "th", "tr", "tbody", "thead", "tfoot")),
    "option": frozenset(("option", "optgroup")),
    "head": frozenset(("body",)),
    "p": _BLOCK - frozenset(("br", "body", "head", "html", "title", "button", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "li", "dd", "dt", "legend", "summary")),
}
#: An end tag doesn't reach beyond these.
_SCOPE = frozenset("table td th article section aside nav main body html form".split())


class Page:
    """A page's tree as flat lists: parent, tag and noise of each element in order, and the events of reading it."""

    def __init__(self, source: str):
        self.parent, self.tag, self.noise = [-1], [""], [False]
        self.within = [False]  # an article or main element
        self.doubtful = [0]  # 1: noise by a name or as a form, unless it holds the text; 2: comments
        self.events: list[tuple[int, str | None]] = []  # (element, text), or (element, None) at its start, (~element, None) at its end
        self.start, self.end = [0], [0]
        # of the open elements: how many of each scope, and of each other name in each scope
        self.scopes, self.names, self.last_block = Counter(), [Counter()], [0]
        self._read(source)
        if any(self.doubtful):
            self._settle()

    def _open(self, tag: str, parent: int, noise: bool, doubtful: int) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.noise.append(noise)
        self.doubtful.append(doubtful)
        self.within.append(self.within[parent] or tag in ("article", "main"))
        self.start.append(len(self.events))
        self.end.append(-1)
        self.events.append((len(self.tag) - 1, None))
        return len(self.tag) - 1

    def _close(self, node: int) -> None:
        self.events.append((~node, None))
        self.end[node] = len(self.events)

    def _text(self, node: int, text: str) -> None:
        if text:
            self.events.append((node, html.unescape(text) if "&" in text else text))

    def _read(self, source: str) -> None:
        stack, at, n = [0], 0, len(source)
        while at < n:
            m = _TOKEN.search(source, at)
            if not m:
                self._text(stack[-1], source[at:])
                break
            self._text(stack[-1], source[at : m.start()])
            comment, slash, name, other = m.groups()
            if comment:
                stop = source.find("-->", m.start() + 4 - (source[m.end() : m.end() + 1] == ">"))
                at = n if stop < 0 else stop + 3
                continue
            found = _TAG_END.match(source, m.end())
            stop = found.end() if found else source.find(">", m.end()) + 1
            if not stop:
                if name and not slash:
                    break  # a tag that never ends
                at = n
                continue
            at = stop
            if other:
                continue
            name = name.lower()
            if slash:
                self._end_tag(stack, name)
                continue
            while len(stack) > 1 and self._ends(stack, name):
                self._pop(stack)
            attributes = source[m.end() : stop - 1]
            kind = self._is_noise(name, attributes, self.within[stack[-1]])
            node = self._open(name, stack[-1], self.noise[stack[-1]] or kind is True, 0 if kind is True else kind)
            if name in _VOID:
                self._close(node)
            elif name in _RAW:
                close = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(source, at)
                finish = source.find(">", close.end()) if close else -1
                at = finish + 1 if finish >= 0 else n
                self._close(node)
            else:
                self._push(stack, node)
        while len(stack) > 1:
            self._pop(stack)
        self._close(0)

    def _push(self, stack: list[int], node: int) -> None:
        tag = self.tag[node]
        if tag in _SCOPE:
            self.scopes[tag] += 1
            self.names.append(Counter())
        else:
            self.names[-1][tag] += 1
        # the place in the stack of the last element that is not inline
        self.last_block.append(len(stack) if tag in _BLOCK or tag in _SCOPE else self.last_block[-1])
        stack.append(node)

    def _pop(self, stack: list[int]) -> None:
        node = stack.pop()
        self.last_block.pop()
        tag = self.tag[node]
        if tag in _SCOPE:
            self.scopes[tag] -= 1
            self.names.pop()
        else:
            self.names[-1][tag] -= 1
        self._close(node)

    def _ends(self, stack: list[int], name: str) -> bool:
        """Whether the start tag ends the innermost open element, or one around it within the scope."""
        at = self.last_block[-1]
        while at:
            tag = self.tag[stack[at]]
            if name in _CLOSED_BY.get(tag, ()):
                return True
            if tag != "p":
                return False
            at = self.last_block[at - 1]
        return False

    def _end_tag(self, stack: list[int], name: str) -> None:
        """Ends the innermost element of the name, if there is one within the scope, with all in it."""
        if self.scopes[name] if name in _SCOPE else self.names[-1][name]:
            while self.tag[stack[-1]] != name:
                self._pop(stack)
            self._pop(stack)

    def _settle(self) -> None:
        """Decides on the doubtful elements by what they hold, and hands noise down."""
        n = len(self.tag)
        chars, linked, main = [0] * n, [False] * n, [False] * n
        for i in range(1, n):
            linked[i] = linked[self.parent[i]] or self.tag[i] == "a"
        for node, text in self.events:
            if text is not None and not self.noise[node] and not linked[node]:
                chars[node] += sum(map(len, text.split()))
        own = chars.copy()
        for i in range(n - 1, 0, -1):
            chars[self.parent[i]] += chars[i]
            main[i] |= self.tag[i] == "main" and chars[i] > 0 and not self.noise[i]
            main[self.parent[i]] |= main[i]
        # articles within and around each element: one that leaves none outside may be kept for its share of the text
        marked = [int(t in ("article", "main") and chars[i] > 0 and not self.noise[i]) for i, t in enumerate(self.tag)]
        inner, around = marked.copy(), marked.copy()
        for i in range(n - 1, 0, -1):
            inner[self.parent[i]] += inner[i]
        for i in range(1, n):
            around[i] += around[self.parent[i]]
        keep = [not d or main[i] or d == 1 and 2 * chars[i] > chars[0] and inner[i] + around[i] - marked[i] == inner[0] for i, d in enumerate(self.doubtful)]
        lost = [False] * n
        for i in range(1, n):
            lost[i] = lost[self.parent[i]] or not keep[i]
        articles = [i for i in range(n) if self.tag[i] == "article" and chars[i] and not self.noise[i]]
        if articles:  # the page's article, if no more text than its own is outside all that is doubtful
            best = at = max(articles, key=lambda i: (chars[i], -i))
            held = []
            while at > 0:
                held.append(at)
                at = self.parent[at]
            if lost[best] and chars[best] >= sum(c for c, x in zip(own, lost) if not x) and all(self.doubtful[i] < 2 for i in held):
                for i in held:
                    keep[i] = True
        for i in range(1, n):
            self.noise[i] = self.noise[i] or self.noise[self.parent[i]] or not keep[i]

    @staticmethod
    def _named(name: str, inside: bool) -> int:
        """Whether one class name or id names noise; 2 for comments."""
        parts = _NAME.findall(name)
        if _NEGATIONS.intersection(parts):
            return 0
        hits = {x for i, x in enumerate(parts) if x in _CLASSES and (x != "ad" or i + 1 == len(parts) or parts[i + 1] in _AD_PARTS)}
        if inside:
            hits -= _HEADS
        return (2 if hits & _COMMENTS else 1) if hits else 0

    @staticmethod
    def _is_noise(tag: str, attributes: str, inside: bool) -> bool | int:
        """True: noise whatever it holds; else what ``doubtful`` says."""
        if tag in _NO_CONTENT or tag == "header" and not inside:
            return True
        doubtful = int(tag == "form")
        if not attributes or tag in ("html", "body", "article", "main"):
            return doubtful
        low = attributes.lower()
        if not any(k in low for k in ("class", "id", "role", "hidden", "style")):
            return doubtful
        for m in _ATTRIBUTE.finditer(low):
            key, value = m[1] or m[5], m[2] or m[3] or m[4] or ""
            if key == "role" and value in _ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
                return True
            if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True
            # ids of headings, and of sections in an article, are made from titles
            if key == "class" or key == "id" and tag not in _HEADINGS and not (tag == "section" and inside and value.strip() not in _COMMENTS):
                doubtful = max([doubtful, *(Page._named(x, inside) for x in value.split())])
        return doubtful


def _densities(page: Page) -> tuple[list[float], list[float], list[int]]:
    """Composite density and density sum of every element, and its characters."""
    n = len(page.tag)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    linked = [False] * n
    for i in range(1, n):
        linked[i] = linked[page.parent[i]] or page.tag[i] == "a"
    for node, text in page.events:
        if text is not None and not page.noise[node]:
            k = sum(map(len, text.split()))
            chars[node] += k
            if linked[node]:
                link_chars[node] += k
    for i in range(n - 1, 0, -1):
        if not page.noise[i]:
            p = page.parent[i]
            chars[p] += chars[i]
            link_chars[p] += link_chars[i]
            tags[p] += tags[i] + 1
            link_tags[p] += link_tags[i] + linked[i]
    body = next((i for i, t in enumerate(page.tag) if t == "body"), 0)
    share = link_chars[body] / max(chars[body], 1)
    density, total = [0.0] * n, [0.0] * n
    for i in range(n):
        if chars[i]:
            c, lc = chars[i], link_chars[i]
            base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
            density[i] = c / max(tags[i], 1) * math.log(max(c / max(lc, 1) * max(tags[i], 1) / max(link_tags[i], 1), 1.0)) / max(math.log(base), 1.0)
    for i in range(1, n):
        total[page.parent[i]] += density[i]
    return density, total, chars


def _choose(page: Page) -> list[int]:
    """The elements whose text is the article, in page order."""
    density, total, chars = _densities(page)
    body = next((i for i, t in enumerate(page.tag) if t == "body"), 0)
    if not chars[body]:
        body = 0
    lower = page.start[body]
    inside = [i for i in range(len(page.tag)) if page.start[i] >= lower and page.end[i] <= page.end[body] and not page.noise[i]]
    if not inside:
        return []
    core = max(inside, key=lambda i: (total[i] or density[i] * 1e-9, -i))
    path = [core]
    while path[-1] != body and page.parent[path[-1]] >= 0:
        path.append(page.parent[path[-1]])
    # up the path while siblings there belong to the article: those as dense as the path, and headings
    threshold = min(density[i] for i in path)
    beside = Counter(page.parent[i] for i in inside if chars[i] and (density[i] >= threshold or page.tag[i] in _HEADINGS))
    for node, parent in zip(path, path[1:]):
        if beside[parent] > (density[node] >= threshold or page.tag[node] in _HEADINGS):
            core = parent
    return [core]


def main_text(source: str) -> str:
    """The article's text of one page."""
    page = Page(source)
    blocks: list[str] = []
    run: list[str] = []
    for chosen in _choose(page):
        for node, text in page.events[page.start[chosen] : page.end[chosen]]:
            if text is None:
                if page.tag[node if node >= 0 else ~node] in _BLOCK and run:
                    blocks.append("".join(run))
                    run = []
            elif not page.noise[node]:
                run.append(text)
        blocks.append("".join(run))
        run = []
    return " ".join(x for b in blocks if (x := " ".join(b.split())))


def _extract(batch: pa.RecordBatch):
    texts = [main_text(t) for t in texts_of(batch, "html")]
    columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
    yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row; repeated rows and null ids or urls stay as they are."""
    own = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return map_batches(own, _extract, "page_id long, url string, text string, n_chars long")
