"""Main text of web pages by composite text density.

A page is read into a tree.  What markup names as a menu, header, footer,
sidebar, notice, advert, form or reader comments is cut off first.  For every
node left the density is the number of characters for each tag below it,
weighed down by the share that lies in links; a node's sum is the total of its
children's densities.  The least density on the way from the node of the
largest sum up to the body is the threshold: under every node that reaches it,
the subtree of the largest sum is main text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from math import e, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element and class names of HTML and of common page templates.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
#: Inside these a slash ends an empty element; elsewhere it means nothing.
FOREIGN = frozenset("svg math".split())
#: Controls without blocks inside: a block's start tag ends one that was left open.
CONTROLS = frozenset("button select".split())
IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of these closes an open p.
CLOSES_P = BLOCK - frozenset("body html tr td th thead tbody tfoot caption option legend".split())
#: Start tag: the open elements that it closes, and those that such a search doesn't leave.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
SIDE_TAGS = frozenset("nav footer aside form dialog head menu button select option datalist".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
SIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising advertorial adsense adbox adslot banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice "
    "alert popup modal overlay newsletter subscribe subscription signup sidebar sidenav rail widget widgets menu nav navbar navigation breadcrumb breadcrumbs "
    "footer foot comment comments commentlist respond disqus replies share sharing social related recommended recommendations login search pager pagination toolbar paywall skip".split()
)
#: These name a page's head or its readers' talk, unless they stand inside the article.
HEAD_WORDS = frozenset("discussion header masthead topbar".split())
#: A name with other words besides (search-methods, related-work) is not a side element's.
PLAIN_WORDS = frozenset(
    "a and area at bar bg block body bottom box btn buttons card class col column container content div el element feed fixed float form global group hidden holder id inner in item items js "
    "large left link links list local main media menu middle mobile module my new of on outer page panel part post primary right row secondary section site slot small stack sticky story style sub "
    "tabs text the to top ui unit us user view web with wrap wrapper zone".split()
)
#: Said of a paragraph, these may just as well mark its text.
SOFT_WORDS = frozenset("alert banner menu notice popup promo recommended related search share skip widget".split())
ARTICLE_TAGS = frozenset("article main".split())
#: Only these can be the subtree of the largest sum: a text's own blocks can't stand for all of it.
CONTAINERS = frozenset("html body main article section div center table tbody tr td".split())
#: Right before main text these begin it: its title, byline and lead.
OPENINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup header p blockquote".split())

MARKUP = re.compile(
    r"""<!--(?:>|->|(?P<comment>.*?)(?:--!?>|\Z))|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?/][^>]*+(?:>|\Z)""",
    re.S,
)
#: The rest of a tag: a quote opens a value only after an equals sign.
ATTRS = re.compile(r"""((?:[^=>]|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])))*+)>""")
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_PART = re.compile(r"[a-z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Tags:
    """Ends of tags.

    A value whose quote is never closed would hide the rest of the page.  Once
    such a tag is met, tags end at the next ``>`` whatever their quotes, so the
    page is read through for attributes once and a second time at most.
    """

    def __init__(self, page: str) -> None:
        self.page, self.quotes = page, True

    def end(self, at: int) -> tuple[str, int] | None:
        """The attributes from ``at`` on and where the tag ends; None if no ``>`` follows."""
        if self.quotes:
            if found := ATTRS.match(self.page, at):
                return found[1], found.end()
            self.quotes = False
        stop = self.page.find(">", at)
        return None if stop < 0 else (self.page[at:stop], stop + 1)

    def after_raw(self, name: str, at: int) -> int:
        """Where the text of a raw element that begins at ``at``, with its end tag, is over."""
        close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(self.page, at)
        stop = self.page.find(">", close.end()) if close else -1
        return stop + 1 if stop >= 0 else len(self.page)


class _Tree:
    """Nodes in page order; parts of a node are strings and numbers of children."""

    def __init__(self) -> None:
        self.tag = ["html"]
        self.parent = [-1]
        self.parts: list[list[str | int]] = [[]]
        self.side = [False]
        self.place = [0]  # among the parts of the parent


def _names_side(name: str, value: str, inside_article: bool) -> bool:
    """Whether a class or an id tells that an element is no main text."""
    for part in value.lower().split():
        words = set(NAME_PART.findall(part))
        side = words & SIDE_WORDS if inside_article else words & (SIDE_WORDS | HEAD_WORDS)
        if name == "p":
            side -= SOFT_WORDS
        if side and words - side <= PLAIN_WORDS | SIDE_WORDS | HEAD_WORDS:
            return True
    return False


def _is_side(name: str, attrs: str, inside_article: bool) -> bool:
    if name in SIDE_TAGS:
        return True
    if name == "header" and not inside_article:
        return True
    if not attrs or attrs.isspace() or name in ("html", "body", "article", "main"):
        return False
    for key, *values in ATTRIBUTE.findall(attrs):
        key, value = key.lower(), "".join(values)
        if key in ("class", "id"):
            if _names_side(name, value, inside_article):
                return True
        elif key == "role" and value.lower() in SIDE_ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and HIDDEN.search(value):
            return True
    return False


class _Open:
    """The open elements, with their number by name, so that a search that can't succeed isn't begun."""

    def __init__(self, tree: _Tree) -> None:
        self.tag, self.stack, self.count = tree.tag, [0], {"html": 1}

    def push(self, node: int) -> None:
        self.stack.append(node)
        name = self.tag[node]
        self.count[name] = self.count.get(name, 0) + 1

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.count[self.tag[self.stack.pop()]] -= 1

    def has(self, names: frozenset[str] | set[str]) -> int:
        return sum(self.count.get(n, 0) for n in names)

    def close(self, shut: set[str] | frozenset[str], walls: set[str] | frozenset[str], outermost: bool) -> None:
        """Closes the innermost or outermost open element of ``shut`` that no element of ``walls`` stands before."""
        left, lowest = self.has(shut), 0
        for depth in range(len(self.stack) - 1, 0, -1):
            if not left:
                break
            t = self.tag[self.stack[depth]]
            if t in shut:
                lowest, left = depth, left - 1
                if not outermost:
                    break
            elif t in walls:
                break
        if lowest:
            self.pop_to(lowest)


def parse(page: str) -> _Tree:
    """The page's tree, with open paragraphs, list items, cells and controls closed as browsers do."""
    tree = _Tree()
    tag, parent, parts, side = tree.tag, tree.parent, tree.parts, tree.side
    still, at, end, body, tags = _Open(tree), 0, len(page), False, _Tags(page)
    while at < end:
        found = MARKUP.search(page, at)
        stop = found.start() if found else end
        if stop > at:
            parts[still.stack[-1]].append(html.unescape(page[at:stop]))
        if not found:
            break
        at = found.end()
        if (text := found["cdata"]) is not None:
            parts[still.stack[-1]].append(text)
        if not (name := found["name"]):
            continue
        if (rest := tags.end(at)) is None:
            # No tag can end any more: what is left is text.
            parts[still.stack[-1]].append(html.unescape(page[stop:]))
            break
        attrs, at = rest
        name = name.lower()
        if found["close"]:
            still.close({name}, frozenset() if name in BLOCK else BLOCK, False)
            continue
        if name in RAW:
            at = tags.after_raw(name, at)
            continue
        if name not in IN_HEAD and still.has({"head"}):
            still.close({"head"}, frozenset(), False)
        if name in CLOSES_P:
            still.close({"p"}, BLOCK - {"p"}, False)
        if name in BLOCK and name != "option" and still.has(CONTROLS):
            still.close(CONTROLS, frozenset(), True)
        if name in CLOSES:
            still.close(*CLOSES[name], True)
        if name == "html" or name == "body" and body:
            continue
        body |= name == "body"
        node = len(tag)
        tag.append(name)
        parent.append(still.stack[-1])
        parts.append([])
        side.append(_is_side(name, attrs, still.has(ARTICLE_TAGS) > 0))
        tree.place.append(len(parts[still.stack[-1]]))
        parts[still.stack[-1]].append(node)
        if name not in VOID and not (attrs.endswith("/") and still.has(FOREIGN)):
            still.push(node)
    return tree


def _densities(tree: _Tree) -> tuple[list[float], list[float]]:
    """Composite density and sum of child densities of every node; cut-off nodes have none."""
    n = len(tree.tag)
    chars, linked, tags, links = [0] * n, [0] * n, [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        if tree.side[i]:
            chars[i] = linked[i] = tags[i] = links[i] = 0
            continue
        chars[i] += sum(len("".join(x.split())) for x in tree.parts[i] if isinstance(x, str))
        if tree.tag[i] == "a":
            linked[i], links[i] = chars[i], links[i] + 1
        if i:
            up = tree.parent[i]
            chars[up] += chars[i]
            linked[up] += linked[i]
            tags[up] += tags[i] + 1
            links[up] += links[i]
    body_chars, body_linked = max(chars[0], 1), linked[0]
    density = [0.0] * n
    total = [0.0] * n
    for i in range(n - 1, -1, -1):
        if c := chars[i]:
            lc, t, lt = max(linked[i], 1), max(tags[i], 1), max(links[i], 1)
            base = log(c / max(c - linked[i], 1) * linked[i] + body_linked / body_chars * c + e)
            density[i] = c / t * log(c / lc * t / lt + 1e-9, base) if base > 1 else c / t * log(c / lc * t / lt + 1e-9)
            density[i] = max(density[i], 0.0)
        if i:
            total[tree.parent[i]] += density[i]
    return density, total


def _content(tree: _Tree) -> list[bool]:
    """Which nodes are roots of main text."""
    density, total = _densities(tree)
    n = len(tree.tag)
    best = list(range(n))  # the container of the largest sum in each subtree, the outer one of equals
    for i in range(n - 1, 0, -1):
        up = tree.parent[i]
        if not tree.side[i] and tree.tag[best[i]] in CONTAINERS and (tree.tag[best[up]] not in CONTAINERS or total[best[i]] > total[best[up]]):
            best[up] = best[i]
    roots = [False] * n
    top = best[0]
    threshold, i = density[top], top
    while i >= 0:
        if density[i] > 0:
            threshold = min(threshold, density[i])
        i = tree.parent[i]
    for i in range(n):
        if not tree.side[i] and density[i] > 0 and density[i] >= threshold:
            found = best[i]
            roots[found if total[found] > 0 else i] = True
    roots[top] = True
    for i in np.flatnonzero(roots).tolist():
        if tree.tag[i] in CONTAINERS and i:
            for before in _openings(tree, i):
                roots[before] = True
    return roots


def _openings(tree: _Tree, node: int) -> Iterator[int]:
    """Titles and paragraphs among the siblings right before ``node``, back to the first other element or text."""
    parts = tree.parts[tree.parent[node]]
    for part in reversed(parts[: tree.place[node]]):
        if isinstance(part, str):
            if not part.isspace():
                return
        elif tree.tag[part] in OPENINGS and not tree.side[part]:
            yield part
        elif not tree.side[part] and tree.tag[part] not in VOID:
            return


def main_text(page: str | None) -> str:
    """The page's main text: one line for every block, in page order; empty if there is none."""
    if not page:
        return ""
    tree = parse(page)
    roots = _content(tree)
    lines: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(line).split()):
            lines.append(text)
        line.clear()

    # (node, next part, whether its text counts)
    walk: list[list] = [[0, 0, roots[0]]]
    while walk:
        top = walk[-1]
        node, k, inside = top
        if k == 0 and tree.tag[node] in BLOCK:
            flush()
        if k >= len(tree.parts[node]):
            walk.pop()
            if tree.tag[node] in BLOCK:
                flush()
            elif tree.tag[node] == "br":
                line.append(" ")
            continue
        top[1] = k + 1
        part = tree.parts[node][k]
        if isinstance(part, str):
            if inside:
                line.append(part)
        elif not tree.side[part]:
            walk.append([part, 0, inside or roots[part]])
        elif tree.tag[part] in BLOCK:
            flush()
    flush()
    return "\n".join(lines)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``; no row needs another.

    Null, empty and wholly cut-off pages give an empty text.  Null ids and urls
    stay null, repeated rows are repeated, an empty table gives an empty one,
    other columns are not read.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_batches, "page_id long, url string, text string, n_chars long")
