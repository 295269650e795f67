"""Main text of web pages by tag-path ratios.

A page is read as a list of text blocks, each with its path of tags from the root. All blocks of one path are summed: characters, punctuation
and link characters for each node. The ratios are smoothed over neighbouring blocks with a Gaussian kernel and fused;
paths whose mean reaches a share of the deviation over the page are content paths. They show the container of the article, which is then given whole:
blocks that the ratios cannot judge, such as a heading or a line of two words, stay if they lie inside. Elements whose
tag, role or class names a menu, header, footer, sidebar, notice, advert, form or reader comment are left out before.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import pick

# Elements of HTML by their part in a page.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rp rt ruby s samp small span strike"
    " strong sub sup time tt u var".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that hold no part of an article.
LEFT_OUT = set(
    "nav header footer aside form script style noscript template button select textarea iframe svg menu dialog object audio video canvas"
    " title head xmp noembed noframes datalist option fieldset".split()
)
HEAD_ONLY = {"title", "meta", "link", "style", "script", "base", "noscript", "template"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "tablist", "toolbar"}
#: Elements whose cells keep end tags outside from reaching in.
CELLS = {"td", "th", "caption"}
TABLE = {"table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"}
#: A start tag ends these open elements, unless one of the second set lies between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th", "caption"}, {"tr", "table"}),
    "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
#: Words in a class or id that mark such parts, and first words that only speak of them.
MARKS = re.compile(
    r"(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?\w*|consent|gdpr|notices?|notification|popup|modal|overlay|newsletter\w*|subscri\w*|signup"
    r"|login|sidebar\w*|side|widgets?|menus?|nav|navbar|navigation|breadcrumbs?|header|masthead|topbar|toolbar|footer|footnav|copyright|comments?"
    r"|commentlist|disqus|respond|repl(?:y|ies)|discussion|shar(?:e|es|ing)|sharebar|social\w*|related\w*|recommend\w*|pagination|pager|search\w*|skip|legal)"
)
SPEAKS = {"has", "no", "with", "without", "not", "is"}
#: Elements that wrap a whole page or article, whatever their class.
WRAPS = {"html", "body", "main"}

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>\"'][^\s>]*)|[^>=]|=)*+)(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]*))|([^\s=/\"'>]+)", re.S)
#: Attributes that are read.
TELLING = re.compile(r"class|id|role|hidden|style|itemprop", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？·¿¡\"'()“”«»-]")

#: Share of the deviation over blocks that a content path's mean reaches, and of its mean where the deviation is small.
LAMBDA = 0.5
#: Share of link characters from which a path is a list of links.
LINKS = 0.5
#: Share of the content that a container must hold for the search to go down to it.
DOMINANT = 0.9
NO_INLINE = ("", False, False, False)
KERNEL = np.exp(-np.arange(-2, 3) ** 2 / 2.0)


class Block:
    """A stretch of text between block tags."""

    __slots__ = ("path", "element", "tag", "out", "marked", "parts", "linked", "text")

    def __init__(self, path, element, tag, out, marked):
        self.path, self.element, self.tag, self.out, self.marked = path, element, tag, out, marked
        self.parts, self.linked, self.text = [], 0, ""


class Element:
    """An open block element. ``out``: left out by its tag or role; ``marked``: by a class or id."""

    __slots__ = ("tag", "path", "parent", "out", "marked", "inner", "names", "article", "within", "number")

    def __init__(self, tag, path, parent, out, marked, article, number):
        self.tag, self.path, self.parent, self.out, self.marked = tag, path, parent, out, marked
        self.article, self.number = article, number
        self.within = tag == "article" or (parent is not None and parent.within)
        # Open inline elements: tag, and whether text in it is left out, marked, or part of a link.
        self.inner, self.names = [], defaultdict(int)


def attributes_of(source: str) -> dict[str, str]:
    return {(m[1] or m[5]).lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(source)}


@lru_cache(maxsize=4096)
def names_part(names: str) -> bool:
    """Whether a class or id names a part that is not the article."""
    for name in names.split():
        words = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", name)]
        if words and words[0] not in SPEAKS and any(map(MARKS.fullmatch, words)):
            return True
    return False


class Page:
    """The blocks of a page in order. Reading is one pass; each tag is pushed and popped once."""

    def __init__(self, source: str):
        self.paths: dict[tuple[int, str], int] = {}
        self.blocks: list[Block] = []
        self.elements = [Element("#root", 0, None, False, False, False, 0)]
        self.stack = [self.elements[0]]
        # How often each tag is open, since the innermost table cell and in all.
        self.scopes: list[dict[str, int]] = [defaultdict(int)]
        self.open: dict[str, int] = defaultdict(int)
        self.block: Block | None = None
        self.title = ""
        self.read(source)

    def read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            m = TOKEN.search(source, at)
            self.take(source[at : m.start()] if m else source[at:])
            if not m:
                break
            at = m.end()
            if m["end"]:
                self.close(m["end"].lower())
            elif m["tag"]:
                tag = m["tag"].lower()
                if tag in RAW:
                    stop = re.compile(f"</{tag}(?=[\\s/>]|\\Z)", re.I).search(source, at)
                    if tag == "title" and not self.title:
                        self.title = html.unescape(source[at : stop.start() if stop else end])
                    self.block = None
                    at = stop.start() if stop else end
                else:
                    self.start(tag, m["attributes"])
        for block in self.blocks:
            block.text = " ".join("".join(block.parts).split())
            block.parts = []
        self.blocks = [b for b in self.blocks if b.text]

    def take(self, text: str) -> None:
        if not text:
            return
        text = html.unescape(text) if "&" in text else text
        top = self.stack[-1]
        if self.block is None:
            if text.isspace():
                return
            if top.tag == "head":
                self.pop()
                top = self.stack[-1]
            self.block = Block(top.path, top, top.tag, top.out, top.marked)
            self.blocks.append(self.block)
        _, out, marked, link = top.inner[-1] if top.inner else NO_INLINE
        if out or marked:
            # Text of an advert inside a line: a block of its own, and the line goes on after it.
            aside = Block(top.path, top, top.tag, self.block.out or out, self.block.marked or marked)
            aside.parts.append(text)
            self.blocks.append(aside)
            self.block.parts.append(" ")
            return
        self.block.parts.append(text)
        if link:
            self.block.linked += len("".join(text.split()))

    def pop(self) -> None:
        top = self.stack.pop()
        self.open[top.tag] -= 1
        if top.tag in CELLS:
            self.scopes.pop()
        self.scopes[-1][top.tag] -= 1
        self.block = None

    def start(self, tag: str, source: str) -> None:
        if tag == "br":
            return self.take(" ")
        if tag in ("html", "wbr"):
            return
        if self.open["head"] and tag not in HEAD_ONLY and tag != "head":
            while self.open["head"]:
                self.pop()
        if tag == "body" and self.open["body"]:
            return
        if tag in VOID:
            if tag == "hr":
                self.block = None
            return
        attributes = attributes_of(source) if TELLING.search(source) else {}
        role = attributes.get("role", "").lower()
        style = attributes.get("style", "").replace(" ", "").lower()
        out = tag in LEFT_OUT or role in ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in style
        marked = tag not in WRAPS and names_part(f"{attributes.get('class', '')} {attributes.get('id', '')}")
        top = self.stack[-1]
        if tag in INLINE:
            _, o, k, link = top.inner[-1] if top.inner else NO_INLINE
            top.inner.append((tag, out or o, marked or k, link or tag == "a"))
            top.names[tag] += 1
            return
        self.block = None
        if self.scopes[-1]["p"]:
            self.until("p")
        ended, fence = ENDS.get(tag, (set(), set()))
        if any(self.open[t] for t in ended):
            depth = len(self.stack) - 1
            while depth and self.stack[depth].tag not in fence and self.stack[depth].tag not in ended and self.stack[depth].tag not in CELLS - ended:
                # Only elements that a start tag may end lie between; anything else keeps the outer one open.
                if self.stack[depth].tag in ("div", "section", "article", "table", "ul", "ol", "dl"):
                    depth = 0
                    break
                depth -= 1
            if depth and self.stack[depth].tag in ended:
                while len(self.stack) > depth:
                    self.pop()
                while self.stack[-1].tag in ended:
                    self.pop()
        top = self.stack[-1]
        # An article inside an article is a comment on it; the heading of an article may stand in its header.
        article = tag in ("article", "main") or role in ("article", "main") or attributes.get("itemprop") == "articleBody"
        out = out or (tag == "article" and top.within)
        if tag in HEADINGS and top.tag == "header" and top.within:
            inherited, below = top.parent.out, top.parent.marked
        else:
            inherited, below = top.out, top.marked
        kind = attributes.get("class", "").split()[:1] or [""]
        step = tag if tag in HEADINGS or tag in ("p", "li", "td", "th", "tr", "dt", "dd", "blockquote", "pre") else f"{tag}.{kind[0]}"
        path = self.paths.setdefault((top.path, step), len(self.paths) + 1)
        element = Element(tag, path, top, inherited or out, below or marked, article, len(self.elements))
        self.elements.append(element)
        self.stack.append(element)
        self.open[tag] += 1
        self.scopes[-1][tag] += 1
        if tag in CELLS:
            self.scopes.append(defaultdict(int))

    def until(self, tag: str) -> None:
        while self.stack[-1].tag != tag:
            self.pop()
        self.pop()

    def close(self, tag: str) -> None:
        if tag == "br":
            self.take(" ")
        elif tag in INLINE:
            top = self.stack[-1]
            found = not top.names[tag]
            while not found:
                last = top.inner.pop()[0]
                top.names[last] -= 1
                found = last == tag
        elif tag not in ("html", "body"):
            self.block = None
            if (self.open if tag in TABLE else self.scopes[-1])[tag] > 0:
                self.until(tag)


def punctuation(text: str) -> int:
    return len(PUNCTUATION.findall(text))


def path_scores(blocks: list[Block]) -> tuple[dict[int, float], dict[int, float], float]:
    """Fused score and share of links of each path, and the threshold of the page."""
    total: dict[int, list[int]] = {}
    for b in blocks:
        row = total.setdefault(b.path, [0, 0, 0, 0])
        letters = len(b.text) - b.text.count(" ")
        for i, x in enumerate((1, len(b.text), punctuation(b.text), 0)):
            row[i] += x
        row[3] += min(b.linked, letters)
    ratios = {p: (chars / nodes, marks / nodes) for p, (nodes, chars, marks, _) in total.items()}
    links = {p: linked / max(1, chars) for p, (_, chars, _, linked) in total.items()}
    series = np.array([ratios[b.path] for b in blocks], float).reshape(-1, 2)
    weight = np.convolve(np.ones(len(blocks)), KERNEL, "full")[2:-2]
    smooth = np.column_stack([np.convolve(series[:, c], KERNEL, "full")[2:-2] / weight for c in (0, 1)])
    unlinked = np.array([1 - min(1.0, links[b.path]) for b in blocks])
    # The smoothed ratios tell where on the page the text is dense; the path's own length tells it from its neighbours.
    fused = np.sqrt(smooth[:, 0] * (1 + smooth[:, 1]) * series[:, 0] * (1 + series[:, 1])) * unlinked
    sums: dict[int, list[float]] = {}
    for b, x in zip(blocks, fused):
        row = sums.setdefault(b.path, [0.0, 0])
        row[0] += x
        row[1] += 1
    return {p: s / n for p, (s, n) in sums.items()}, links, float(LAMBDA * min(fused.std(), fused.max()))


def container_of(page: Page, mass: dict[int, float]) -> Element:
    """The smallest element that holds the content; a single article or main element is one whatever it holds."""
    # Elements are numbered in page order, so children come after their parent.
    below: dict[int, list[int]] = defaultdict(list)
    total = dict(mass)
    for element in reversed(page.elements[1:]):
        own = total.get(element.number)
        if own is not None:
            total[element.parent.number] = total.get(element.parent.number, 0.0) + own
            below[element.parent.number].append(element.number)
    articles = [e for e in page.elements if e.article and not e.out and e.number in total]
    mains = [e for e in articles if e.tag == "main"]
    inner = [e for e in articles if e.tag != "main"]
    if len(inner) == 1:
        return inner[0]
    if len(mains) == 1:
        return mains[0]
    now = page.elements[0]
    while True:
        best = max(below[now.number], key=lambda c: total[c], default=None)
        if best is None or total[best] < DOMINANT * total[now.number] or page.elements[best].tag in HEADINGS | {"p", "li", "td", "th", "blockquote", "pre", "dd", "dt"}:
            return now
        now = page.elements[best]


def content(source: str) -> list[Block]:
    """The blocks of the article, in page order."""
    page = Page(source)
    blocks = [b for b in page.blocks if not b.out and not b.marked]
    if not blocks:
        # Class names that take in the whole page say nothing.
        blocks = [b for b in page.blocks if not b.out]
    if not blocks:
        return []
    score, links, threshold = path_scores(blocks)
    chosen = {p for p, s in score.items() if s >= threshold and links[p] < LINKS}
    mass: dict[int, float] = defaultdict(float)
    for b in blocks:
        mass[b.element.number] += len(b.text) * (b.path in chosen) + 1e-6
    container = container_of(page, mass)
    held = {container.number}
    for element in page.elements[container.number + 1 :]:
        if element.parent.number in held:
            held.add(element.number)
    inside = [b.element.number in held and links[b.path] < LINKS for b in blocks]
    if not container.article:
        # Without an article element the text begins at its heading or first content path and ends with the last one.
        at = [i for i, b in enumerate(blocks) if inside[i] and b.path in chosen]
        first, last = (at[0], at[-1]) if at else (0, len(blocks) - 1)
        while first and inside[first - 1] and blocks[first - 1].tag in HEADINGS:
            first -= 1
        inside = [x and first <= i <= last for i, x in enumerate(inside)]
    title = " ".join(page.title.split())
    kept = []
    for i, (b, x) in enumerate(zip(blocks, inside)):
        # The headline may stand outside the text's container; the page's title tells it from other headings.
        headline = b.tag == "h1" and title and (title.startswith(b.text) or b.text.startswith(title)) and not kept
        if x or headline:
            kept.append(b)
    return kept


def main_text(source: str) -> str:
    """The text of the article: one line for each block, parted by empty lines."""
    return "\n\n".join(b.text for b in content(source))


def text_column(column: str = "html") -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(h) for h in batch], dtype=object)

    return run(F.coalesce(F.col(column), F.lit("")))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) for every row of ``pages`` (page_id, url, html).

    The whole source is read. Null and empty html, and pages without an article, give an empty text; null ids and addresses stay null; repeated
    rows give repeated results; an empty table none. Broken markup (tags left open, cut off or crossed) is read as browsers do in the common cases.
    """
    plain = pick(pages, "page_id", "url", "html").select("page_id", "url", text_column().alias("text"))
    return plain.withColumn("n_chars", F.length("text").cast("long"))
