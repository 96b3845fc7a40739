"""Main text of HTML pages by line-block distribution.

Markup is stripped into lines, one for each block element. A line's mass is the length of its text outside links. The
masses are summed over a sliding window: text surges where the sum reaches a share of the page's largest one, and dives
where, to either side of that, it is zero. What lies between is a region; all regions are kept, from their first line with
mass to their last.

Elements that may be page furniture (navigation, headers, footers, sidebars, notices, adverts, forms, comments of readers;
by their name or by words in class, id and role) count as empty lines, neighbouring ones together as one, so that however
many stand in an article they don't split it. An element is no furniture, whatever it is called, if it holds half of the
page's text or more and the article or main element, the first heading or nearly all of the rest: page-wide forms, wrappers
with a class such as header-fixed, menus that are never closed. Where the page marks its article or main element, lines
outside have no mass, and all lines inside have the mass of their whole text.

The text of a line has its character references decoded and its white space made one space; lines are joined in page
order. Null and empty pages, and pages without text, give the empty text. Malformed markup is read as browsers do: a
comment or tag that is never closed runs to the end of the page. The time is in proportion to the page's length. Repeated
rows each give a row of their own; an empty table gives none.
"""

from __future__ import annotations

import html as html_entities
import re
from collections import defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Lines of the sliding window; so many lines without mass end a region.
WINDOW = 3
#: Text surges where the window sum is this share of the largest one, or so many characters.
SURGE = 0.1
SURGE_CHARS = 80
#: An element with this share of the page's text may be a wrapper; and what is left beside one, at most.
BULK = 0.5
REST = 0.1
#: Characters of a line that may be a copyright notice.
SHORT = 200

#: Fixed lists of HTML elements.
BLOCKS = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp template svg math object canvas audio video select".split())
FURNITURE = frozenset("nav header footer aside form button dialog menu noscript label".split())
MARKED = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
IN_HEAD = frozenset("head html meta link script style title base noscript template".split())
#: An open paragraph or list item ends where one of these begins.
ENDS_P = BLOCKS - {"br", "body", "html", "head", "option", "legend", "td", "th", "tr", "tbody", "thead", "tfoot", "summary", "figcaption"}
#: Words in class, id or role that mark page furniture, and those among them that mark comments of readers.
HINTS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget related recommended newsletter subscribe subscription signup login cookie cookies consent notice notices alert popup modal overlay comment comments disqus reply replies respond social share sharing toolbar search pagination pager copyright legal disclaimer complementary contentinfo".split())
COMMENTS = frozenset("comment comments disqus reply replies respond".split())
#: Words beside a hint that tell of something else: a layout with a sidebar, the header of the article.
ABOUT = frozenset("no not with without has is".split())
OWN = frozenset("article post entry story layout wrapper container page site body".split())

TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
UP_TO = re.compile(r"[^>=]*")
SPACE = re.compile(r"\s*")
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAME = re.compile(r"[a-z]+")
VALUE_END = re.compile(r"=\s*[^\s\"']+\Z")
HREF = re.compile(r"\bhref\s*=", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
COPYRIGHT = re.compile(r"\s*(?:©|\(c\)\s|copyright\s+(?:©|\(c\)|\d{4}))", re.I)


def hints(attributes: str) -> set[str]:
    """The words in class, id and role that mark furniture."""
    found: set[str] = set()
    for m in ATTRIBUTE.finditer(attributes):
        for value in (m[2] or m[3] or m[4] or "").lower().split():
            parts = NAME.findall(value)
            if not parts or parts[0] in ABOUT:
                continue
            own = OWN.intersection(parts)
            if parts[-1] in HINTS and not (own and parts[-1] in ("header", "banner")):
                found.add(parts[-1])
            elif not own:
                found |= HINTS.intersection(parts)
    return found


@dataclass
class Element:
    """An element that may be furniture; parent is the number of the one around it."""

    parent: int
    sure: bool  # never a wrapper: hidden, or comments of readers
    mass: int = 0
    leads: bool = False  # holds the article or main element, or the first heading
    furniture: bool = True


@dataclass
class Page:
    """Lines as pieces (element, text, whether in a link), each line with whether it is inside an article or main element."""

    elements: list[Element] = field(default_factory=list)
    lines: list[tuple[list[tuple[int, str, bool]], bool]] = field(default_factory=list)


def tokens(page: str):
    """(text, None, None, False), or ("", tag name, attributes, whether it closes), in order; each character is read once."""
    at, size = 0, len(page)
    missing: set[str] = set()  # what is not found any more; searched for once only

    def find(what: str, start: int) -> int:
        if what in missing:
            return -1
        found = page.find(what, start)
        if found < 0:
            missing.add(what)
        return found

    while at < size:
        opening = find("<", at)
        if opening < 0:
            yield page[at:], None, None, False
            return
        if opening > at:
            yield page[at:opening], None, None, False
        if page.startswith("<!--", opening):
            end = find("-->", opening + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith("<![CDATA[", opening):
            end = find("]]>", opening + 9)
            if end >= 0:
                yield html_entities.escape(page[opening + 9 : end]), None, None, False
                at = end + 3
                continue
        if page.startswith(("<!", "<?"), opening):
            end = find(">", opening)
            at = size if end < 0 else end + 1
            continue
        m = TAG.match(page, opening + 1)
        if m is None:
            yield "<", None, None, False
            at = opening + 1
            continue
        end = m.end()
        while True:
            end = UP_TO.match(page, end).end()
            if end >= size or page[end] == ">":
                break
            end = SPACE.match(page, end + 1).end()
            if page[end : end + 1] in ("'", '"'):
                closing = find(page[end], end + 1)
                end = closing + 1 if closing >= 0 else end + 1
        if end >= size:
            return
        name, attributes, closes = m[2].lower(), page[m.end() : end], bool(m[1])
        at = end + 1
        yield "", name, attributes, closes
        if name in RAW and not closes:
            stop = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if stop is None:
                return
            at = stop.end()


def read(page: str) -> Page:
    """The page's lines and the elements that may be furniture."""
    out = Page()
    pieces: list[tuple[int, str, bool]] = []
    stack: list[tuple[str, int, bool]] = []  # name, innermost element that may be furniture, whether in a link
    where: dict[str, list[int]] = defaultdict(list)  # places of open elements in the stack, by name
    blocks: list[int] = []  # places of block elements
    headed = False

    def inside() -> bool:
        return bool(where["article"] or where["main"])

    def flush() -> None:
        if pieces:
            out.lines.append((pieces.copy(), inside()))
            pieces.clear()

    def close(name: str) -> None:
        """Close the innermost open element of this name and all in it; an inline one only within its block."""
        if not where[name] or (name not in BLOCKS and blocks and where[name][-1] < blocks[-1]):
            return
        for _ in range(len(stack) - where[name][-1]):
            top = stack.pop()[0]
            where[top].pop()
            if top in BLOCKS:
                blocks.pop()

    for text, name, attributes, closes in tokens(page):
        if where["head"] and (name not in IN_HEAD if name else text.strip()):
            close("head")
        _, within, linked = stack[-1] if stack else ("", -1, False)
        if name is None:
            if not where["head"]:
                pieces.append((within, text, linked))
            continue
        if name in BLOCKS:
            flush()
        if closes:
            close(name)
            continue
        if name in ENDS_P and stack and stack[-1][0] == "p":
            close("p")
        if name == "a":
            close("a")
        _, within, linked = stack[-1] if stack else ("", -1, False)
        if name in MARKED or (name == "h1" and not headed):
            headed = headed or name == "h1"
            at = within
            while at >= 0 and not out.elements[at].leads:
                out.elements[at].leads = True
                at = out.elements[at].parent
        if name in VOID or name in RAW or (attributes.endswith("/") and not VALUE_END.search(attributes)):
            continue
        own = set() if name in ("body", "html", "article", "main") or not attributes else hints(attributes)
        hidden = bool(attributes) and name not in ("body", "html") and HIDDEN.search(attributes) is not None
        if own or hidden or (name in FURNITURE and not (name == "header" and inside())):
            out.elements.append(Element(within, hidden or bool(own & COMMENTS)))
            within = len(out.elements) - 1
        where[name].append(len(stack))
        if name in BLOCKS:
            blocks.append(len(stack))
        stack.append((name, within, linked or (name == "a" and HREF.search(attributes) is not None)))
    flush()
    return out


def settle(page: Page) -> None:
    """Decide which elements are furniture. Masses are characters outside links."""
    total = 0
    for pieces, _ in page.lines:
        for element, text, linked in pieces:
            n = 0 if linked else len(text.strip())
            total += n
            if element >= 0:
                page.elements[element].mass += n
    below = [0] * len(page.elements)
    for k in range(len(page.elements) - 1, -1, -1):
        e = page.elements[k]
        if e.parent >= 0:
            page.elements[e.parent].mass += e.mass
            below[e.parent] += e.mass
    rest = total - sum(e.mass for e in page.elements if e.parent < 0)  # beside all furniture so far
    for k, e in enumerate(page.elements):
        if e.parent >= 0 and page.elements[e.parent].furniture:
            continue  # all inside furniture is furniture
        alone = rest <= REST * total and e.mass >= SURGE_CHARS
        if not e.sure and e.mass and e.mass >= BULK * total and (e.leads or alone):
            e.furniture = False
            rest += e.mass - below[k]


def clean(text: str) -> str:
    return " ".join(html_entities.unescape(text).split())


def lines_of(page: str) -> list[tuple[str, int, bool]]:
    """(text, characters outside links, inside an article or main element) of each line; furniture is an empty line."""
    read_page = read(page)
    settle(read_page)
    out: list[tuple[str, int, bool]] = []
    dropped = [False] * len(read_page.elements)
    for k, e in enumerate(read_page.elements):
        dropped[k] = e.furniture or (e.parent >= 0 and dropped[e.parent])
    for pieces, marked in read_page.lines:
        stays = [(text, link) for element, text, link in pieces if element < 0 or not dropped[element]]
        text = clean("".join(t for t, _ in stays))
        if not text or (len(text) <= SHORT and not marked and COPYRIGHT.match(text)):
            if (text or any(t.strip() for _, t, _ in pieces)) and (not out or out[-1][0]):
                out.append(("", 0, marked))
        else:
            out.append((text, len(clean("".join(t for t, link in stays if not link))), marked))
    return out


def regions(masses: list[int], window: int, share: float = SURGE) -> list[tuple[int, int]]:
    """Runs of lines around each surge of the window sums, up to the dives on both sides.

    sums[i] adds up the lines i .. i + window - 1. Text surges where the sum is at least this share of the largest one
    (or SURGE_CHARS, where that is less), and dives where it is zero; a run starts with the first line that has mass and
    ends with the last.
    """
    n = len(masses)
    sums, at = [], sum(masses[:window])
    for i in range(n):
        sums.append(at)
        at += (masses[i + window] if i + window < n else 0) - masses[i]
    least = min(SURGE_CHARS, share * max(sums, default=0))
    found, start = [], None
    for i in range(n + 1):
        live = i < n and sums[i] > 0
        if live and start is None:
            start = i
        elif not live and start is not None:
            # a window in the run that surges
            if max(sums[start:i]) >= least:
                run = [k for k in range(start, min(n, i + window)) if masses[k]]
                found.append((run[0], run[-1] + 1))
            start = None
    return found


def main_text(page: str | None, window: int = WINDOW) -> str:
    """The lines of all regions, joined by line feeds."""
    lines = lines_of(page) if page else []
    marked = any(text and inside for text, _, inside in lines)
    if marked:  # nothing in it is too little to count
        found = regions([len(text) if inside else 0 for text, _, inside in lines], window, 0.0)
    else:
        masses = [mass for _, mass, _ in lines]
        found = regions(masses if any(masses) else [len(text) for text, _, _ in lines], window)
    return "\n".join(lines[k][0] for a, b in found for k in range(a, b) if lines[k][0] and (lines[k][2] or not marked))


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html", carry: tuple[str, ...] = ("url",), window: int = WINDOW) -> DataFrame:
    """Rows (id, *carry, text, n_chars), one per row of df; n_chars counts code points."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [main_text(p, window) for p in batch.column(1).to_pylist()]
            extra = [batch.column(2 + k) for k in range(len(carry))]
            return pa.RecordBatch.from_arrays([batch.column(0), *extra, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", *(f"x{k}" for k in range(len(carry))), "text", "n_chars"])

        return step

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html"), *[F.col(c).alias(f"x{k}") for k, c in enumerate(carry)])
    kinds = "".join(f", x{k} {df.schema[c].dataType.simpleString()}" for k, c in enumerate(carry))
    out = map_arrow(rows, make, f"id {kind}{kinds}, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), *[F.col(f"x{k}").alias(c) for k, c in enumerate(carry)], "text", "n_chars")
