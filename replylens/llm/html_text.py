"""Main text of web pages by line-block distribution.

Markup is stripped into blocks, the lines of the page. A line weighs as many characters as it
has outside links; lines of menus, headers, footers, sidebars, notices, adverts, forms and
comments weigh nothing, and if the page marks its article, so do lines outside it. The weights
are summed over windows of `WIDTH` lines. Text surges where a sum reaches the threshold
and dives where it falls to zero. All between two dives is kept if it surges, and if it does not,
what stands inside an element around a surge; where nothing surges, all that weighs is kept. A marked article is a
reason to expect text, so in it any text outside links surges; windows of nothing but links dive there as
elsewhere. Where nothing weighs, every line that is not dropped is kept.

Cases: null or empty html, and a page without text, give an empty text. Character references
are decoded once. Unclosed and stray tags are tolerated: a link or a dropped inline element without an end tag ends with the
next block, a link at the latest with the block it stands in; comments, scripts, styles and titles that never
end run to the end of the page, other elements without text of the page do not. Very long pages are read whole in linear
time. Repeated rows are extracted each for itself; columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# lines per window and characters that a window needs for a surge
WIDTH = 3
SURGE = 86

TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[\"'=])*+)(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
ANCHOR = re.compile(r"<(/?)a(?=[\s/>])", re.IGNORECASE)
HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s/]|$)", re.IGNORECASE)
SPACES = re.compile(r"\s+")

RAW = frozenset("script style noscript template textarea iframe xmp svg math canvas object select title noembed noframes".split())
# of these, those that swallow the rest of a page if they have no end
ENDLESS = frozenset("script style textarea iframe xmp title noembed noframes".split())
DROPPED = frozenset("nav aside footer form menu dialog button".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# blocks of text and lists, which are not what holds the article together
LEAVES = frozenset("p pre blockquote caption figcaption legend address dd dt dl li ol ul hgroup".split()) | HEADINGS
# an element of these ends where the next of its kind begins
SIBLING = {"li": {"li"}, "p": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"}}
# names in a class, id or role that mark what is not the article
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navigation navbar menu menubar breadcrumb"
    " breadcrumbs header masthead footer contentinfo sidebar aside complementary widget notice cookie cookies consent gdpr alert popup modal overlay"
    " comment comments respond reply replies disqus share sharing social related recommended newsletter subscribe signup login search pagination"
    " pager skip toolbar legal copyright paywall".split()
)
# those of them that mark an inline element; others name parts of programs and of sentences, too
INLINE_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies share sharing social newsletter subscribe"
    " skip paywall".split()
)
# words that may stand beside them in a name; beside others ('has-sidebar', 'related-work') they mark nothing
BESIDE = frozenset(
    "site page main top bottom left right upper lower primary secondary global area list box container wrapper wrap block section bar slot unit inner"
    " outer body link links button buttons form item items group panel row column posts articles stories icons google sticky fixed".split()
)
MAIN_MARKS = frozenset({"articlebody", "main"})
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Line:
    """A block: its text, how much of it lies outside links, and where it stands."""

    text: str
    free: int
    # the number of its block, and of the element around its paragraph, heading or list
    within: int
    around: int
    dropped: bool = False
    main: bool = False


@dataclass
class Element:
    """A block element: what is around it, and what its name and attributes say."""

    name: str
    above: int
    gone: bool = False
    marked: bool = False
    article: bool = False
    inside: bool = False


@lru_cache(4096)
def _is_mark(name: str, marks: frozenset[str] = MARKS) -> bool:
    """Whether all words of a name are marks, at least one, or words that stand beside them."""
    parts = WORD.findall(CAMEL.sub(" ", name).lower())
    if name.lower() in marks or "".join(parts) in marks:
        return True
    known, marked = [part in marks or part in BESIDE for part in parts], any(part in marks for part in parts)
    for i in range(len(parts) - 1):
        if parts[i] + parts[i + 1] in marks:
            known[i] = known[i + 1] = marked = True
    return marked and all(known)


def _marks(rest: str, name: str, inside: bool, marks: frozenset[str] = MARKS) -> tuple[bool, bool, bool]:
    """Whether attributes hide an element, mark it as no part of the article, and as the article."""
    hidden, marked, main = bool(HIDDEN.search(rest)), False, False
    for match in ATTRIBUTE.finditer(rest):
        kind, value = match[1].lower(), match[2] or match[3] or match[4] or ""
        if kind == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE))
        elif kind in ("hidden", "aria-hidden"):
            hidden |= value.lower() not in ("false", "until-found")
        else:
            # the ids of headings, and of sections of an article, are made of their titles
            if kind != "id" or not (name in HEADINGS or inside and name == "section"):
                marked |= any(_is_mark(token, marks) for token in value.split())
            main |= value.lower() in MAIN_MARKS
    return hidden, marked, main


def _inline_ends(page: str) -> dict[int, int]:
    """Where the inline elements of a page end, by the end of their start tags; only those with an end tag."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    for match in TAG.finditer(page):
        name = (match["name"] or "").lower()
        if not name or name in BLOCK or name in VOID:
            continue
        if not match["end"]:
            opened.setdefault(name, []).append(match.end())
        elif opened.get(name):
            ends[opened[name].pop()] = match.start()
    return ends


def _judged(elements: list[Element], lines: list[Line]) -> None:
    """Decides which elements are no part of the article and which are, then the same for their lines.

    A mark does not count on an element with most of the page's free text, nor on one with an
    article or main that is not marked itself, if all of these stand inside marked elements.
    """
    gone, around = [False] * len(elements), [False] * len(elements)
    free, holds = [0] * len(elements), [False] * len(elements)
    plain = False
    for i, e in enumerate(elements):
        gone[i] = e.gone or i > 0 and gone[e.above]
        around[i] = e.marked or i > 0 and around[e.above]
        holds[i] = e.article and not e.marked and not gone[i]
        plain |= holds[i] and not around[i]
    for line in lines:
        free[line.within] += 0 if gone[line.within] else line.free
    for i in range(len(elements) - 1, 0, -1):
        free[elements[i].above] += free[i]
        holds[elements[i].above] |= holds[i]
    dropped, main = [False] * len(elements), [False] * len(elements)
    for i, e in enumerate(elements):
        above = (dropped[e.above], main[e.above]) if i else (False, False)
        counts = e.marked and 2 * free[i] <= free[0] and (plain or not holds[i])
        dropped[i] = above[0] or e.gone or counts or e.name == "header" and not above[1]
        main[i] = not dropped[i] and (above[1] or e.article)
    for line in lines:
        line.dropped, line.main = dropped[line.within], main[line.within]


def lines_of(page: str) -> tuple[list[Line], list[int]]:
    """The blocks of a page in order, without those that have no text, and the element around each element."""
    lines: list[Line] = []
    parts: list[tuple[str, bool]] = []
    elements = [Element("", 0)]
    # numbers of the open elements
    stack = [0]
    depth: dict[str, int] = {}
    # links and dropped inline elements reach to a place, or to the next block if they have no end
    linked_to, linked, link_level = 0, False, 0
    silent_to, silent = 0, False
    ends: dict[int, int] | None = None
    # names of elements with no further end, and the place of the next end of raw data
    endless: set[str] = set()
    data_end = 0

    def add(text: str, place: int) -> None:
        if not silent and place >= silent_to:
            parts.append((text, linked or place < linked_to))

    def flush() -> None:
        text = SPACES.sub(" ", references.unescape("".join(t for t, _ in parts))).strip()
        if text:
            free = sum(len("".join(references.unescape(t).split())) for t, is_link in parts if not is_link)
            around = next((i for i in reversed(stack) if elements[i].name not in LEAVES), 0)
            lines.append(Line(text, free, stack[-1], around))
        parts.clear()

    def close(count: int) -> None:
        while len(stack) > count:
            depth[elements[stack.pop()].name] -= 1

    at = 0
    while match := TAG.search(page, at):
        if match.start() > at:
            add(page[at : match.start()], at)
        at = match.end()
        if match["name"] is None:
            if match[0] == "<![CDATA[":
                if 0 <= data_end < at:
                    data_end = page.find("]]>", at)
                # without an end it is a comment of the odd kind that ends with its tag
                end = data_end if data_end >= 0 else page.find(">", at)
                if data_end >= 0:
                    add(page[at:end], at)
                at = len(page) if end < 0 else end + (3 if data_end >= 0 else 1)
            continue
        name, ended, rest = match["name"].lower(), bool(match["end"]), match["rest"]
        if name in RAW:
            if not ended and not rest.rstrip().endswith("/") and name not in endless:
                closing = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
                if closing:
                    at = closing.end()
                elif name in ENDLESS:
                    at = len(page)
                else:
                    endless.add(name)
        elif name in ("br", "wbr", "img", "input"):
            add(" " if name != "wbr" else "", match.start())
        elif name in BLOCK:
            flush()
            linked = silent = False
            if ended:
                if depth.get(name):
                    close(next(i for i in range(len(stack) - 1, -1, -1) if elements[stack[i]].name == name))
            elif name not in VOID:
                if elements[stack[-1]].name in SIBLING.get(name, ()) or elements[stack[-1]].name == "p":
                    close(len(stack) - 1)
                inside = elements[stack[-1]].inside
                hidden, marked, main = _marks(rest, name, inside) if rest else (False, False, False)
                whole = name in ("html", "body")
                article = main or name in ("article", "main")
                gone = name in DROPPED or name == "head" or hidden and not whole
                elements.append(Element(name, stack[-1], gone, marked and not whole and name != "main", article, inside or article))
                stack.append(len(elements) - 1)
                depth[name] = depth.get(name, 0) + 1
            if len(stack) < link_level:
                linked_to = 0
        else:
            if name == "a":
                linked, linked_to, link_level = False, 0, len(stack)
                if not ended:
                    anchor = ANCHOR.search(page, at)
                    if anchor and anchor[1]:
                        linked_to = anchor.start()
                    else:
                        linked = True
            if rest and not ended and at > silent_to and any(_marks(rest, name, True, INLINE_MARKS)[:2]):
                if ends is None:
                    ends = _inline_ends(page)
                if at in ends:
                    silent_to = ends[at]
                else:
                    silent = True
    if at < len(page):
        add(page[at:], at)
    flush()
    _judged(elements, lines)
    return lines, [e.above for e in elements]


def kept_lines(lines: list[Line], above: list[int], width: int = WIDTH, surge: int = SURGE) -> list[str]:
    """The texts between dive points that surge or stand where others do. `above`: the element around each element."""
    marked = any(line.main for line in lines)
    inside = [not line.dropped and (line.main or not marked) for line in lines]
    weights = [line.free if ok else 0 for line, ok in zip(lines, inside, strict=True)]
    if not any(weights):
        return [line.text for line, ok in zip(lines, inside, strict=True) if ok]
    sums = [0] * len(lines)
    total = 0
    for i in range(len(lines) - 1, -1, -1):
        total += weights[i] - (weights[i + width] if i + width < len(lines) else 0)
        sums[i] = total
    enough = 1 if marked or max(sums, default=0) < surge else surge
    runs: list[tuple[int, int, bool]] = []
    holds = [False] * len(above)
    at = 0
    while at < len(lines):
        if not sums[at]:
            at += 1
            continue
        dive = at
        while dive < len(lines) and sums[dive]:
            dive += 1
        weighed = [i for i in range(at, min(dive + width - 1, len(lines))) if weights[i]]
        surges = False
        for i in range(at, dive):
            if sums[i] >= enough:
                surges = True
                for line, weight in zip(lines[i : i + width], weights[i : i + width], strict=True):
                    holds[line.around] |= weight > 0
        runs.append((weighed[0], weighed[-1], surges))
        at = max(weighed[-1] + 1, dive)
    for i in range(1, len(above)):
        holds[i] |= holds[above[i]]
    kept: list[str] = []
    for first, last, surges in runs:
        # lines of links alone stay only between lines of text
        if surges:
            kept += [lines[i].text for i in range(first, last + 1) if inside[i]]
        else:
            kept += [lines[i].text for i in range(first, last + 1) if weights[i] and holds[lines[i].within]]
    return kept


def extract(page: str | None) -> str:
    return "\n".join(kept_lines(*lines_of(page))) if page else ""


def _extracted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(page) for page in batch.column(2).to_pylist()]
        columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per page."""
    chosen = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    return chosen.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
