"""HTML extraction by tag-path ratios.

Every block of text has the path of tags from the root to it. Text length and punctuation are
aggregated per path, fused to a ratio, smoothed over the page's blocks and thresholded: the paths
above are content. The ratios pick the node: from the root, the search goes down as long as one child
holds most of the content's score. An article or main element around that node is taken whole (or the
one in it with the highest score); in it, lists of links go, and what is marked as menu, advert, comment
and the like by its element or hidden. A mark by class, id or role is only a veto: it counts if the
element holds little of the page's content. Without such an element all that lies between content
blocks of the node is the article's, whatever its path, and so are lists, tables and the like next to
its content; lists of links go.

A page is read once; the work grows with its length, however deeply it is nested.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A token: comment, declaration, raw element, tag, text or a stray bracket.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|textarea|template|iframe|svg|title|select|annotation(?:-xml)?)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"([a-z-]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_WORD = re.compile(r"[a-z]+")
_PUNCTUATION = re.compile(r"[.,;:!?。，、；：！？]")

# Names of HTML elements, and words by which sites mark what isn't the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img "
    "math menclose mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
#: What an opening tag ends, if it is open.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
} | dict.fromkeys(
    "p div ul ol dl table section article aside nav header footer main form h1 h2 h3 h4 h5 h6 blockquote pre hr figure address fieldset details".split(), {"p"}
)
#: Elements that end the search for what a tag ends.
SCOPES = frozenset("table ul ol dl div section article aside nav header footer main form body td th blockquote figure".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form button menu dialog head input fieldset".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr masthead menu modal nav navbar "
    "navigation newsletter notice notification pagination pager popup promo promotion related replies reply respond share sharing sidebar social sponsor sponsored subscribe "
    "subscription toolbar widget".split()
)
#: Those of comments, which can be longer than the article.
COMMENT_WORDS = frozenset("comment comments disqus reply replies respond".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
#: Elements that are judged as a whole: links or not, next to content or not.
GROUPS = frozenset("ul ol dl table".split())
PARTS = GROUPS | frozenset("pre blockquote figure".split())
ROWS = frozenset("li dt dd caption thead tbody tfoot tr td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: A path is content if its smoothed ratio is at least this share of the length-weighted mean.
LEAST_RATIO = 0.25
#: A container keeps this share of the content's score when the search goes down into it.
LEAST_SHARE = 0.6
#: An element that class words or a role mark is kept if it holds at least this share of the page's content; one of comments.
MOST_MARKED, MOST_COMMENTS = 0.5, 0.9
#: More of a path's or list's text than this in links: a list of links.
MOST_LINKED = 0.5


class _Element:
    __slots__ = ("block", "chief", "dropped", "fallback", "goes", "header", "label", "linked", "marked", "number", "parent", "partly", "score", "tag")

    def __init__(self, tag: str, attrs: str, parent: _Element | None, number: int, labels: dict[tuple[int, str], int]) -> None:
        """``number`` counts the page's elements; ``labels`` numbers its paths of tags."""
        named = {k.lower(): v.strip("\"'").lower() for k, v in _ATTR.findall(attrs)} if attrs and not attrs.isspace() else {}
        marks = set(_WORD.findall(f"{named.get('class', '')} {named.get('id', '')}"))
        role = named.get("role", "")
        hidden = "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in named.get("style", "").replace(" ", "")
        self.tag, self.parent = tag, parent
        self.chief = tag in ("article", "main") or role in ("main", "article") or named.get("itemprop") == "articlebody"
        own = tag not in ("html", "body") and not (tag in ("article", "main") and not marks & {"comment", "comments", "reply"})
        self.dropped = bool(parent and parent.dropped) or tag in BOILERPLATE_TAGS or hidden
        #: The share of the page's content from which the mark by words or a role doesn't count; 0 if there is none.
        self.marked = 0.0
        if own and (marks & BOILERPLATE_WORDS or role in BOILERPLATE_ROLES):
            self.marked = MOST_COMMENTS if marks & COMMENT_WORDS else MOST_MARKED
        #: A marked element that a block can have in it, or in such a one.
        self.partly = tag in INLINE and (self.marked > 0 or bool(parent and parent.partly))
        self.header = bool(parent and parent.header) or tag == "header" or (own and tag not in HEADINGS and "header" in marks)
        self.label = labels.setdefault((parent.label if parent else -1, tag), len(labels))
        self.linked = tag == "a" or bool(parent and parent.linked)
        #: Shown only where scripts don't run: the article's there, a notice elsewhere.
        self.fallback = tag == "noscript" or bool(parent and parent.fallback)
        #: The innermost element around or at it that makes blocks.
        self.block: _Element = parent.block if parent and tag in INLINE else self
        self.number, self.score, self.goes = number, 0.0, False


class _Block:
    __slots__ = ("element", "linked", "parts", "text")

    def __init__(self, element: _Element, text: str, linked: int, parts: list[tuple[str, int, _Element | None]]) -> None:
        #: ``parts`` has (text, its length if linked, marked inline element around it); empty if there is no such element.
        self.element, self.text, self.linked, self.parts = element, text, linked, parts


def _spaced(parts: list[tuple[str, int, _Element | None]]) -> str:
    return " ".join("".join(p[0] for p in parts).split())


def blocks_of(page: str) -> tuple[list[_Block], list[_Element]]:
    """The page's blocks of text in order, each with its element (white space is one space), and all
    elements, those around others first."""
    out: list[_Block] = []
    labels: dict[tuple[int, str], int] = {}
    elements = [_Element("html", "", None, 0, labels)]
    stack = [elements[0]]
    #: Where in the stack the elements of each tag are, and the last that ends a search.
    places: dict[str, list[int]] = {}
    scopes = [0]
    parts: list[tuple[str, int, _Element | None]] = []

    def flush() -> None:
        if parts:
            text = _spaced(parts)
            if text:
                out.append(_Block(stack[-1].block, text, sum(p[1] for p in parts), parts.copy() if any(p[2] for p in parts) else []))
            parts.clear()

    def close(place: int) -> None:
        for e in stack[place:]:
            places[e.tag].pop()
            if e.tag in SCOPES:
                scopes.pop()
        del stack[place:]

    for m in _TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            text = html.unescape(text) if "&" in text else text
            top = stack[-1]
            if not (top.tag in INLINE and top.dropped):
                parts.append((text, len(text) if top.linked else 0, top if top.partly else None))
            continue
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag = tag.lower()
        attrs = m["attrs"] or m["attrs2"] or ""
        if tag not in INLINE:
            flush()
        if m["close"] or m["close2"]:
            if places.get(tag):
                close(places[tag][-1])
            continue
        if tag == "html" or tag in VOID:
            continue
        ended = max((places[t][-1] for t in ENDS.get(tag, ()) if places.get(t)), default=0)
        if ended and ended >= scopes[-1]:
            close(ended)
        elements.append(_Element(tag, attrs, stack[-1], len(elements), labels))
        if attrs.endswith("/") and tag in INLINE:
            continue
        places.setdefault(tag, []).append(len(stack))
        if tag in SCOPES:
            scopes.append(len(stack))
        stack.append(elements[-1])
    flush()
    return out, elements


def content_paths(blocks: list[_Block]) -> dict[int, float]:
    """The smoothed, fused ratio of each path that is content."""
    total: dict[int, list[float]] = {}
    for b in blocks:
        sums = total.setdefault(b.element.label, [0, 0, 0, 0])
        for i, x in enumerate((1, len(b.text), len(_PUNCTUATION.findall(b.text)), b.linked)):
            sums[i] += x
    fused = {p: (chars / n) * math.log2(2 + marks / n) * max(0.0, 1 - links / chars) for p, (n, chars, marks, links) in total.items()}
    row = [fused[b.element.label] for b in blocks]
    smooth: dict[int, list[float]] = {}
    for i, b in enumerate(blocks):
        near = row[max(0, i - 1) : i + 2]
        smooth.setdefault(b.element.label, []).append(0.5 * row[i] + 0.5 * sum(near) / len(near))
    ratio = {p: sum(x) / len(x) for p, x in smooth.items()}
    chars = sum(t[1] for t in total.values())
    least = LEAST_RATIO * sum(ratio[p] * total[p][1] for p in ratio) / chars if chars else 0
    return {p: r for p, r in ratio.items() if r >= least and total[p][3] <= MOST_LINKED * total[p][1]}


def _wholes(elements: list[_Element], top: _Element) -> list[_Element | None]:
    """By number, the outermost list, table or the like around (or at) each element, in ``top``; None if there is none."""
    out: list[_Element | None] = []
    for e in elements:
        around = out[e.parent.number] if e.parent else None
        out.append(None if e is top or e.number < top.number else around or (e if e.tag in PARTS else None))
    return out


def _groups(blocks: list[_Block]) -> list[object]:
    """What each block is judged with: a list or table, as (number,), where it is in one, else its path."""
    groups: list[object] = []
    of_row: dict[int, _Element] = {}
    for b in blocks:
        e, rows = b.element, []
        if e.parent and e.tag in ("p", "div") and e.parent.tag in ("li", "dt", "dd"):
            e = e.parent
        while e.parent and e.tag in ROWS and e.number not in of_row:
            rows.append(e.number)
            e = e.parent
        e = of_row.get(e.number, e)
        of_row.update(dict.fromkeys(rows, e))
        groups.append((e.number,) if e.tag in GROUPS else b.element.label)
    return groups


def link_lists(blocks: list[_Block]) -> list[bool]:
    """Whether each block is in a list of links: its own list or table where it is in one, all blocks of its path else."""
    groups = _groups(blocks)
    total: dict[object, list[int]] = {}
    for b, g in zip(blocks, groups, strict=True):
        sums = total.setdefault(g, [0, 0])
        sums[0] += b.linked
        sums[1] += len(b.text)
    return [b.element.tag not in HEADINGS and total[g][0] > MOST_LINKED * total[g][1] for b, g in zip(blocks, groups, strict=True)]


def of_article(blocks: list[_Block], paths: dict[int, float]) -> list[_Block]:
    """Of the blocks of an article element, all but lists of links and what is nothing but a link on a path that isn't content.

    Paragraphs stay, however much of them is linked. So does a list of links right below a heading of the article's
    parts: that is its sources.
    """
    groups, links = _groups(blocks), link_lists(blocks)
    named = set()
    for i, g in enumerate(groups):
        if i and g != groups[i - 1] and blocks[i - 1].element.tag in HEADINGS - {"h1"}:
            named.add(g)
    out = []
    for b, g, linked in zip(blocks, groups, links, strict=True):
        listed = isinstance(g, tuple)
        alone = b.linked >= len(b.text) and b.element.tag not in HEADINGS | {"p"} and b.element.label not in paths
        if not (linked and g not in named if listed else alone):
            out.append(b)
    return out


def between(blocks: list[_Block], paths: dict[int, float], wholes: list[_Element | None]) -> list[_Block]:
    """Of the blocks of a container: the headings, what lies between content blocks, and lists, tables and the like beside content."""
    links = link_lists(blocks)
    content = [i for i, b in enumerate(blocks) if b.element.label in paths and not links[i]]
    if not content:
        return [b for b in blocks if b.element.tag in HEADINGS]
    around = [wholes[b.element.number] for b in blocks]
    beside = {id((around[i] or blocks[i].element).parent) for i in content}
    out = []
    for i, b in enumerate(blocks):
        inner = content[0] <= i <= content[-1] or (around[i] is not None and id(around[i].parent) in beside)
        if b.element.tag in HEADINGS or (inner and not links[i]):
            out.append(b)
    return out


def _scored(blocks: list[_Block], elements: list[_Element], paths: dict[int, float]) -> float:
    """Gives every element the content's score of all in it, marked inline elements included; the whole page's."""
    for e in elements:
        e.score = 0.0
    for b in blocks:
        ratio = paths.get(b.element.label, 0.0)
        own = 0
        for text, _, e in b.parts:
            if e is not None:
                e.score += len(text) * ratio
                own += len(text)
        b.element.score += max(0, len(b.text) - own) * ratio
    for e in reversed(elements):
        if e.parent:
            e.parent.score += e.score
    return elements[0].score


def _beside_articles(blocks: list[_Block], elements: list[_Element]) -> list[bool]:
    """By number, whether an element has no unmarked article or main element in or around it, though the page has one with text."""
    filled = [False] * len(elements)
    for b in blocks:
        filled[b.element.number] = True
    for e in reversed(elements):
        if e.parent and filled[e.number]:
            filled[e.parent.number] = True
    chief = [e.chief and not e.marked and not e.dropped and filled[e.number] for e in elements]
    if not any(chief):
        return [False] * len(elements)
    around, holds = chief.copy(), chief.copy()
    for e in elements:
        around[e.number] |= bool(e.parent) and around[e.parent.number]
    for e in reversed(elements):
        if e.parent:
            holds[e.parent.number] |= holds[e.number]
    return [not a and not h for a, h in zip(around, holds, strict=True)]


def unmarked(blocks: list[_Block], elements: list[_Element]) -> list[_Block]:
    """The blocks less what is in elements marked by words or a role that hold little of the page's content, or that
    lie beside an article or main element with text, whatever they hold."""
    if not any(e.marked for e in elements):
        return blocks
    whole = _scored(blocks, elements, content_paths(blocks))
    beside = _beside_articles(blocks, elements)
    for e in elements:
        little = not whole or e.score < e.marked * whole or beside[e.number]
        e.goes = bool(e.parent and e.parent.goes) or (e.marked > 0 and little)
    out = []
    for b in blocks:
        if b.element.goes:
            continue
        if b.parts:
            left = [p for p in b.parts if p[2] is None or not p[2].goes]
            b.text, b.linked, b.parts = _spaced(left), sum(p[1] for p in left), left
        if b.text:
            out.append(b)
    return out


def picked_node(elements: list[_Element]) -> _Element:
    """From the root down, the element that still holds LEAST_SHARE of the content's score of what it is in."""
    best: dict[int, _Element] = {}
    for e in elements[1:]:
        if e.parent.number not in best or e.score > best[e.parent.number].score:
            best[e.parent.number] = e
    here = elements[0]
    while (below := best.get(here.number)) is not None and below.score >= LEAST_SHARE * here.score:
        here = below
    return here


def extract(page: str | None) -> str:
    """The main text of one page; empty if there is none."""
    blocks, elements = blocks_of(page or "")
    blocks = unmarked([b for b in blocks if not b.element.dropped], elements)
    paths = content_paths(blocks)
    if not _scored(blocks, elements, paths):
        return ""
    here = picked_node(elements)
    # the innermost article or main element around it, unless one further out holds more
    top, e = None, here
    while e is not None:
        if e.chief and (top is None or e.score > top.score):
            top = e
        e = e.parent
    if top is None:
        inside = within(elements, here)
        top = max((e for e in elements if e.chief and e.score > 0 and inside[e.number]), key=lambda e: e.score, default=None)
    if top is not None:
        inside = within(elements, top)
        picked = [b for b in blocks if inside[b.element.number]]
        return " ".join(b.text for b in of_article(picked, paths))
    while here.parent and (here.label in paths or here.tag in INLINE):  # a single block isn't the container
        here = here.parent
    inside = within(elements, here)
    return " ".join(b.text for b in between([b for b in blocks if inside[b.element.number] and not b.element.header and not b.element.fallback], paths, _wholes(elements, here)))


def within(elements: list[_Element], top: _Element) -> list[bool]:
    """By number, whether each element is ``top`` or in it."""
    out = []
    for e in elements:
        out.append(e is top or (e.parent is not None and out[e.parent.number]))
    return out


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row; a null or empty page has an empty text.

    Repeated rows, null ids and null urls are kept. Empty in, empty out. Of nodes with equal scores the first is
    taken. A page is one step of its task: a very long one takes memory for a multiple of its length, and time in proportion.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([extract(x.as_py()) for x in batch.column("html")], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), texts], names=["page_id", "url", "text"])

    return rows.mapInArrow(extracted, "page_id long, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))
