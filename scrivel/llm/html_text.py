"""Main text of web pages by scoring the element tree.

Each paragraph earns points for its length and its commas and passes them to its ancestors, less at each step up.
A container's points are discounted by the share of its text that is links. The best container is kept, with those
siblings that score well or read like prose; their blocks are the page's text. Parts that say what they are by tag,
role, class or id (menus, footers, sidebars, notices, adverts, forms, comments, ...) are left out from the start. A class
that tells of a state (no-sidebar, comments-open, overflow-hidden) names no part, and a part told by one word of a longer
class alone stays if it holds most of the page's text, unless it is one of readers' comments.

Reading a page takes time in proportion to its length, whatever its markup: tags are scanned once, ancestors are looked
for only if one is open, and the tree is no deeper than MOST_DEPTH.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivel.llm.common import lean, prepare

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption legend optgroup option".split()
)
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot caption legend optgroup option body html".split())
#: An element that ends when one of these begins, looked for no further up than the given limits.
ENDED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
DROP = frozenset("script style textarea title iframe noembed noframes noscript template head nav footer aside select option menu dialog svg canvas object audio video input".split())
#: Dropped unless most of the page stands in them.
FORMS = frozenset("form fieldset".split())
#: Text of a paragraph where they stand in one, controls elsewhere.
CONTROLS = frozenset("button label".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words of a class or id that name a part other than the article.
PARTS = frozenset(
    "ad ads advert advertisement advertising adsense adslot banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "copyright disqus disclaimer footer foot gdpr header masthead hidden login menu modal nav navbar navigation newsletter notice notification "
    "outbrain pager pagination paywall popup promo promotion recommended related reply replies respond rss share sharing sidebar sidenav signup "
    "skip social sponsor sponsored subscribe subscription taboola tags toolbar topbar trending widget".split()
)
HEADER_WORDS = frozenset("header foot footer tags".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond".split())
#: Words for a part of an article or for its readers' comments: these if something below tells of their writers.
TALK_WORDS = frozenset("discussion discussions responses reactions conversation thread".split())
WRITER_WORDS = COMMENT_WORDS | frozenset("author avatar user username commenter vote votes upvote byline timestamp posted".split())
#: A class that begins or ends with one of these tells of a state or a layout.
STATE_BEGINS = frozenset("no not without with has have is hide show overflow can".split())
STATE_ENDS = frozenset("open closed on off enabled disabled active allowed hidden visible".split())
HIDDEN = frozenset("hidden visually-hidden visuallyhidden sr-only screen-reader-text".split())
#: Shares of the page's text, comments aside, from which a part stays that is named by a word of a class, or by a whole one.
MOST_SHARE, WHOLE_SHARE, MOST_DEPTH = 0.6, 0.8, 1000
PRIOR = {"article": 25.0, "main": 20.0, "section": 5.0, "div": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0, "address": -3.0, "ol": -3.0, "ul": -3.0, "dl": -3.0, "dd": -3.0, "dt": -3.0, "li": -3.0, "th": -5.0}
GOOD = frozenset("article body content entry main page post story text blog hentry".split())
LEAST_PARAGRAPH, LEVELS = 25, 5


class Element:
    __slots__ = ("attributes", "children", "depth", "link_chars", "parent", "parts", "points", "tag", "talk", "text_chars")

    def __init__(self, tag: str, parent: Element | None, attributes: dict[str, str]):
        self.tag, self.parent, self.attributes = tag, parent, attributes
        self.children: list[Element | str] = []
        self.depth = parent.depth + 1 if parent else 0
        self.points: float | None = None
        self.text_chars = self.link_chars = 0
        self.parts: tuple[set[str], set[str]] = set(), set()
        self.talk = False


def tag_end(page: str, at: int, last: int) -> int:
    """The place of the > that ends the tag whose name ends at `at`, or -1; quotes count where a value begins. last: the page's last >."""
    while at <= last:
        m = _STOP.search(page, at)
        if m is None or m[0] == ">":
            return m.start() if m else -1
        at = m.end()
        if page[max(0, m.start() - 20) : m.start()].rstrip().endswith("=") and (k := page.find(m[0], at)) >= 0 and k < last:
            at = k + 1
    return -1


def parse(page: str) -> Element:
    """A tree of the page, as browsers would read it in the main: ends that are missing are put in, stray ones ignored, a tag that breaks off is no text."""
    root = now = Element("#root", None, {})
    at, n, last = 0, len(page), page.rfind(">")
    opened: dict[str, int] = {}

    def text(piece: str) -> None:
        if piece:
            now.children.append(html.unescape(piece) if "&" in piece else piece)

    def up_to(names: set[str] | frozenset[str], limits: set[str] | frozenset[str]) -> Element | None:
        if not any(opened.get(x) for x in names):
            return None
        e = now
        while e is not root and e.tag not in limits:
            if e.tag in names:
                return e
            e = e.parent
        return None

    def close(element: Element) -> Element:
        e = now
        while e is not element.parent:
            opened[e.tag] -= 1
            e = e.parent
        return e

    while at < n:
        start = page.find("<", at)
        if start < 0:
            text(page[at:])
            break
        if page[start + 1 : start + 2] in ("!", "?"):
            text(page[at:start])
            mark = "-->" if page.startswith("<!--", start) else ">"
            k = page.find(mark, start + 2)
            at = k + len(mark) if k >= 0 else n
            continue
        m = _NAME.match(page, start + 1)
        if m is None:
            text(page[at : start + 1])
            at = start + 1
            continue
        text(page[at:start])
        end = page.find(">", m.end())
        inside = page[m.end() : end] if end >= 0 else ""
        if '"' in inside or "'" in inside:
            end = tag_end(page, m.end(), last)
            inside = page[m.end() : end]
        if end < 0:
            break
        at, name = end + 1, m[2].lower()
        if m[1]:
            found = up_to({name}, frozenset() if name in BLOCK else BLOCK)
            if found is not None:
                now = close(found)
            continue
        if name in CLOSES_P and (p := up_to({"p"}, {"table", "td", "th", "button", "object"})):
            now = close(p)
        if name in ENDED_BY and (e := up_to(*ENDED_BY[name])):
            now = close(e)
        element = Element(name, now, {a.lower(): html.unescape(x or y or z or "") for a, x, y, z in _ATTRIBUTE.findall(inside)} if inside.strip(" /\n\t") else {})
        now.children.append(element)
        if name in RAW:
            stop = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = stop.end() if stop else n
        elif name not in VOID and not inside.endswith("/"):
            if now.depth >= MOST_DEPTH:  # deeper ones are laid side by side
                element.parent, element.depth = now.parent, now.depth
                now.children.pop()
                now.parent.children.append(element)
                opened[now.tag] -= 1
            now = element
            opened[name] = opened.get(name, 0) + 1
    return root


def _words(element: Element) -> set[str]:
    both = f"{element.attributes.get('class', '')} {element.attributes.get('id', '')}"
    return set(re.split(r"[\s_\-]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", both).lower()))


def named_parts(element: Element) -> tuple[set[str], set[str]]:
    """The words of PARTS that are a whole class or id, and those that are one word of a longer one; classes of a state have none."""
    whole, part = set(), set()
    for token in f"{element.attributes.get('class', '')} {element.attributes.get('id', '')}".split():
        low = token.lower()
        if low in HIDDEN or low in PARTS:
            whole.add(low if low in PARTS else "hidden")
            continue
        words = re.split(r"[_\-:]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", token).lower())
        if words[0] not in STATE_BEGINS and words[-1] not in STATE_ENDS:
            part |= PARTS.intersection(words) - {"hidden"}
    return whole, part


def is_comments(element: Element) -> bool:
    """Whether the part holds readers' comments by its name, or by its name and what is below."""
    whole, part = element.parts
    if (whole | part) & COMMENT_WORDS:
        return True
    return element.talk and bool(_words(element) & TALK_WORDS) and element.tag not in ("html", "body", "article", "main")


def unwanted(element: Element, inside_article: bool, inside_paragraph: bool, share: float) -> bool:
    """share: of the page's text."""
    if element.tag in DROP or element.tag in CONTROLS and not inside_paragraph or element.tag in FORMS and share < MOST_SHARE:
        return True
    if element.tag == "header":
        return not inside_article
    a = element.attributes
    if not a or element.tag in ("html", "body", "article", "main"):
        return False
    if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in ROLES or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
        return True
    if "class" in a or "id" in a:
        whole, part = element.parts
        if inside_article:
            whole, part = whole - HEADER_WORDS, part - HEADER_WORDS
        return is_comments(element) or bool(whole) and share < WHOLE_SHARE or bool(part) and share < MOST_SHARE
    return False


def prune(root: Element) -> list[Element]:
    """Takes unwanted parts out; the elements left, parents before children."""
    order, at = [root], 0
    while at < len(order):
        order += [c for c in order[at].children if not isinstance(c, str) and c.tag not in DROP]
        at += 1
    for e in order:
        e.text_chars = sum(len(c.strip()) for c in e.children if isinstance(c, str))
        if "class" in e.attributes or "id" in e.attributes:
            e.parts = named_parts(e)
        e.talk = any(not isinstance(c, str) and c.tag == "textarea" for c in e.children)
    for e in reversed(order):
        if e.parent is not None:
            e.parent.text_chars += 0 if is_comments(e) else e.text_chars
            e.parent.talk = e.parent.talk or e.talk or e.tag == "form" or bool(e.attributes) and bool(_words(e) & WRITER_WORDS)
    total = max(root.text_chars, 1)
    out, stack = [], [(root, False, False)]
    while stack:
        element, inside, paragraph = stack.pop()
        inside = inside or element.tag in ("article", "main")
        paragraph = paragraph or element.tag == "p"
        element.children = [c for c in element.children if isinstance(c, str) or not unwanted(c, inside, paragraph, c.text_chars / total)]
        out.append(element)
        stack += [(c, inside, paragraph) for c in reversed(element.children) if not isinstance(c, str)]
    return out


def _own_text(element: Element) -> str:
    """The text of an element up to the blocks in it."""
    parts, stack = [], list(reversed(element.children))
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            parts.append(c)
        elif c.tag not in BLOCK:
            parts.append(" " if c.tag == "br" else "")
            stack += reversed(c.children)
    return " ".join("".join(parts).split())


def score(elements: list[Element], least: int) -> Element | None:
    """The container with the most points."""
    for e in elements:
        e.points, e.text_chars, e.link_chars = None, 0, 0
    for e in reversed(elements):
        e.text_chars += sum(len(c.strip()) for c in e.children if isinstance(c, str))
        if e.tag == "a":
            e.link_chars = e.text_chars
        if e.parent is not None:
            e.parent.text_chars += e.text_chars
            e.parent.link_chars += e.link_chars
    for e in elements:
        if e.tag not in BLOCK and e.parent is not None or e.tag == "html":
            continue
        own = _own_text(e)
        if len(own) < least:
            continue
        points = 1 + own.count(",") + own.count("、") + own.count("，") + min(len(own) / 100, 3)
        up = e.parent if e.tag in ("p", "pre", "li", "td", "dd", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote") else e
        for level in range(LEVELS):
            if up is None or up.tag == "#root" and level:
                break
            if up.points is None:
                up.points = PRIOR.get(up.tag, 0.0) + (5 if _words(up) & GOOD else 0)
            up.points += points / (1, 2, 6, 9, 12)[level]
            up = up.parent
    best, most = None, 0.0
    for e in elements:
        if e.points is not None:
            e.points *= 1 - e.link_chars / max(e.text_chars, 1)
            if best is None or e.points > most:
                best, most = e, e.points
    return best


def kept(best: Element) -> list[Element]:
    """The best container and those of its siblings that belong to the article."""
    if best.parent is None or best.tag in ("body", "html", "article", "main"):
        return [best]
    bar, out = max(10.0, 0.2 * (best.points or 0)), []
    kind = best.attributes.get("class")
    for e in best.parent.children:
        if isinstance(e, str):
            continue
        if e is best or (e.points or 0) + (0.2 * (best.points or 0) if kind and e.attributes.get("class") == kind else 0) >= bar:
            out.append(e)
        elif e.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote"):
            links, own = e.link_chars / max(e.text_chars, 1), _own_text(e)
            if e.tag != "p" and not links or len(own) > 80 and links < 0.25 or own and not links and re.search(r"[.!?…。]", own):
                out.append(e)
    return out


def blocks(parts: list[Element]) -> list[str]:
    """The blocks of text in page order; white space in a block is one space. Lists of links are menus where the whole page is the container, cited works within an article."""
    menus = any(p.tag in ("#root", "html", "body") for p in parts)
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        if line and (text := " ".join("".join(line).split())):
            out.append(text)
        line.clear()

    stack: list = list(reversed(parts))
    while stack:
        c = stack.pop()
        if c is None:
            end()
        elif isinstance(c, str):
            line.append(c)
        elif c.tag in BLOCK:
            end()
            if menus and c.tag in ("ul", "ol", "table", "div", "section") and c.link_chars > 0.5 * c.text_chars:
                continue  # a list of links
            stack.append(None)
            stack += reversed(c.children)
        else:
            if c.tag == "br":
                line.append(" ")
            stack += reversed(c.children)
    end()
    return out


def main_text(page: str | None) -> str:
    """The article of a page, blocks joined by an empty line; empty without any."""
    if not page or not page.strip():
        return ""
    elements = prune(parse(page))
    best = score(elements, LEAST_PARAGRAPH) or score(elements, 1)
    return "\n\n".join(blocks(kept(best))) if best else ""


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) for every row.

    A null or empty page, and one without text, has the empty text. Whole pages are read, however long. Of containers with
    equal points the first counts. Repeated rows stay; further columns are ignored; no rows give no rows. No shuffle: each page is its own work.
    """
    prepare(pages.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), F.col(html_column).cast("string").alias("html"))
    return rows.mapInArrow(lean(read), "page_id long, url string, text string, n_chars long")


__all__ = ["blocks", "extract", "main_text", "parse", "prune", "score"]
