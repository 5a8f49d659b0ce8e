"""HTML extraction by line-block distribution (operator 9).

Markup is stripped to lines: each block element (p, li, h1, td ...) is a line, and the edge of a container (div, main,
section ...) leaves GAP empty lines. Elements that are never main text (scripts, styles, navigation, forms, asides,
containers whose class or id names a menu, advert, notice or comment list) leave nothing but a line's end. A block is the
sum of the text lengths of GAP lines in a row; lines that are mostly links count nothing. Where block lengths rise from
nothing a stretch begins, where they dive to nothing it ends, and it is text if they surge to SURGE in between (or to
the page's largest block, if that is less). Everything from the first such stretch to the last is kept.

What surges only finds the text; its ends follow the markup, so that short and link-rich parts at the ends stay. Where
the page marks its article (article, main, role=main or itemprop=articleBody), only lines in such elements count, and an
element with a stretch is kept whole; before the first and after the last of these, others stay unless they are mostly
links. Else the text reaches to the ends of the innermost container, sections not counted, that holds all stretches of
at least a third of the longest one's length; if that is the page's body, to the ends of its sections.

A null or empty page, and a page without text, gives an empty text. Pages are whole: nothing is cut or capped. Repeated
rows give repeated results; a null id or url is passed on. No rows give no rows.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import read_table

GAP = 3
SURGE = 40
LINK_SHARE = 0.5

#: HTML's element names by role.
OPAQUE = frozenset("script style noscript template svg math iframe object canvas audio video head select textarea button".split())
ASIDE = frozenset("nav footer aside form dialog menu".split())
CONTAINER = frozenset("html body div main section article header fieldset details".split())
BLOCK = frozenset("ul ol dl table tbody thead tfoot figure hgroup p li h1 h2 h3 h4 h5 h6 tr td th dt dd pre blockquote figcaption caption summary address hr option legend".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are parts of what holds them.
PARTS = frozenset("section header fieldset details".split())
#: Elements whose class and id names are looked at.
NAMING = (CONTAINER - frozenset("html body article main".split())) | frozenset("ul ol dl table".split())
#: Words in a class or id that mark what isn't the article; a name is made of nothing but these and words of place.
_WORDS = (
    r"(?:ads?|advert\w*|banner|breadcrumbs?|comments?|comment-?list|cookies?|consent|disqus|footer|gdpr|masthead|menu|modal|nav\w*|newsletter|notice|pager|pagination|popup|promo\w*|related|replies|respond|share|sharing|sidebar|site-?header|social|sponsor\w*|subscribe|toolbar|widget)"
)
NAMED = re.compile(
    rf"(?:(?:site|main|page|top|bottom|left|right|primary|secondary|global|post|article|blog)[_-])*{_WORDS}(?:[_-](?:{_WORDS}|list|area|section|box|bar|block|container|wrapper|wrap|inner|links?|items?|form|top|bottom|left|right|primary|secondary|\d+))*",
    re.IGNORECASE,
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())

_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.DOTALL)
_ATTR = re.compile(r"([^\s\"'>/=][^\s>/=]*)(?:\s*=\s*(\"[^\"]*(?:\"|$)|'[^']*(?:'|$)|[^\s>]+))?")
_RAW_END = {name: re.compile(rf"</{name}\s*(?:>|$)|$", re.IGNORECASE) for name in ("script", "style", "textarea", "noscript", "template", "iframe", "svg", "title")}
_SPACE = re.compile(r"\s+")


class _Page:
    """Lines of a page: (text, characters in links, outermost marked element or 0, open containers); an empty text is a gap."""

    def __init__(self) -> None:
        self.lines: list[tuple[str, int, int, tuple]] = []
        self.parts: list[str] = []
        self.linked = 0
        self.article = 0
        self.region = 0
        self.path: tuple = ()

    def end_line(self, gap: bool) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.lines.append((text, self.linked, self.region if self.article else 0, self.path))
        self.parts.clear()
        self.linked = 0
        if gap and self.lines and self.lines[-1][0]:
            self.lines += [("", 0, 0, ())] * GAP


def _attributes(raw: str) -> dict[str, str]:
    """Values by whole lower-case names; of a name that repeats the first counts, as in browsers."""
    found: dict[str, str] = {}
    for m in _ATTR.finditer(raw) if raw else ():
        value = m[2] or ""
        if value[:1] in ('"', "'"):
            value = value[1:-1] if value[-1] == value[0] and len(value) > 1 else value[1:]
        found.setdefault(m[1].lower(), entities.unescape(value))
    return found


def page_lines(page: str) -> list[tuple[str, int, int, tuple]]:
    out, stack, at, skip, links = _Page(), [], 0, 0, 0
    for tag in iter(lambda: _TAG.search(page, at), None):
        if not skip and tag.start() > at:
            text = entities.unescape(page[at : tag.start()])
            out.parts.append(text)
            out.linked += len(text.strip()) if links else 0
        at = tag.end()
        if tag.end() == tag.start():
            break
        if tag[1] is not None and not skip:
            out.parts.append(tag[1])
        if not tag[3]:
            continue
        name, raw = tag[3].lower(), tag[4] or ""
        if tag[2]:
            if any(x[0] == name for x in stack):
                while stack:
                    open_name, hides, article = stack.pop()
                    skip -= hides
                    links -= open_name == "a"
                    if skip == 0 and (open_name in CONTAINER or open_name in BLOCK or hides):
                        out.end_line(gap=open_name in CONTAINER and not hides)
                    if open_name in CONTAINER:
                        out.path = out.path[:-1]
                    out.article -= article
                    if open_name == name:
                        break
            continue
        attributes = _attributes(raw)
        named = name in NAMING and any(map(NAMED.fullmatch, f"{attributes.get('class', '')} {attributes.get('id', '')}".split()))
        in_article = out.article > 0
        hides = name in OPAQUE or name in ASIDE or (name == "header" and not in_article) or "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role", "").lower() in ROLES or named
        article = name in ("article", "main") or attributes.get("role") == "main" or "articleBody" in attributes.get("itemprop", "")
        if name in _RAW_END:
            at = _RAW_END[name].search(page, at).end()
            out.end_line(gap=False) if name not in ("svg",) and skip == 0 and name in ("title",) else None
            continue
        if skip == 0 and (name in CONTAINER or name in BLOCK or hides):
            out.end_line(gap=name in CONTAINER and not hides)
        if name == "br" and not skip:
            out.parts.append(" ")
        if name in VOID or raw.rstrip().endswith("/"):
            continue
        if name in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1][0] == name:
            stack.pop()
        skip += hides
        links += name == "a"
        if article and not skip:
            out.region += out.article == 0
            out.article += 1
        if name in CONTAINER:
            out.path += ((name, tag.start()),)
        stack.append((name, int(hides), int(article and not skip)))
    if at < len(page) and not skip:
        out.parts.append(entities.unescape(page[at:]))
    out.end_line(gap=False)
    return out.lines


def _weight(line: tuple[str, int, int, tuple]) -> int:
    """Characters of a line, but none of one that is mostly links."""
    return len(line[0]) if line[1] <= LINK_SHARE * len(line[0]) else 0


def stretches(lines: list[tuple[str, int, int, tuple]]) -> list[tuple[int, int]]:
    """Places of the lines from each rise of the block lengths to their dive, if they surge in between."""
    weights = list(map(_weight, lines))
    blocks = [sum(weights[i : i + GAP]) for i in range(len(weights))]
    if not any(blocks):  # links only, or nothing
        weights = [len(x[0]) for x in lines]
        blocks = [sum(weights[i : i + GAP]) for i in range(len(weights))]
    enough = min(SURGE, max(blocks, default=0))
    found, begin, surges = [], None, False
    for i, block in enumerate([*blocks, 0]):
        if block and begin is None and weights[i]:
            begin, surges = i, False
        surges = surges or block >= enough
        if block == 0 and begin is not None:
            if surges:
                found.append((begin, max(k for k in range(begin, i) if weights[k]) + 1))
            begin = None
    return found


def _marked_ends(lines: list[tuple[str, int, int, tuple]], found: list[tuple[int, int]]) -> tuple[int, int]:
    """The marked elements, but for those at the ends that have no stretch and are mostly links."""
    held = {lines[i][2] for begin, end in found for i in range(begin, end)}
    size = lambda region, column: sum(column(x) for x in lines if x[2] == region)
    regions = {x[2] for x in lines if x[0]}
    good = held | {r for r in regions - held if size(r, lambda x: x[1]) <= LINK_SHARE * size(r, lambda x: len(x[0]))}
    places = [i for i, x in enumerate(lines) if x[0] and x[2] in good]
    return places[0], places[-1] + 1


def _container_ends(lines: list[tuple[str, int, int, tuple]], found: list[tuple[int, int]]) -> tuple[int, int]:
    """The ends of the container that holds the large stretches, or of the stretches where they reach further."""
    sizes = [sum(len(x[0]) for x in lines[begin:end]) for begin, end in found]
    large = [i for i, n in enumerate(sizes) if 3 * n >= max(sizes)]
    paths = [x[3] for i in large for x in lines[found[i][0] : found[i][1]] if x[0]]
    depth = 0
    while all(len(p) > depth and p[depth] == paths[0][depth] for p in paths):
        depth += 1
    while depth and paths[0][depth - 1][0] in PARTS:
        depth -= 1
    shared = paths[0][:depth]
    body = not shared or shared[-1][0] in ("html", "body")
    inside = lambda p: p[:depth] == shared and (not body or (len(p) > depth and p[depth][0] in PARTS))
    places = [i for i, x in enumerate(lines) if x[0] and inside(x[3])]
    return min([found[0][0], *places]), max([found[-1][1], *(i + 1 for i in places)])


def main_text(page: str | None) -> str:
    lines = page_lines(page or "")
    marked = any(region for _, _, region, _ in lines)
    if marked:
        lines = [x if x[2] or not x[0] else ("", 0, 0, ()) for x in lines]
    found = stretches(lines)
    if not found:
        return ""
    begin, end = (_marked_ends if marked else _container_ends)(lines, found)
    return "\n".join(x[0] for x in lines[begin:end] if x[0])


def _extract(batches):
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages``."""
    id_type = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", "url", "html").mapInArrow(_extract, f"page_id {id_type}, url string, text string")
    return rows.withColumn("n_chars", F.length("text").cast("long"))


def op9_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
