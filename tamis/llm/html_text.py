"""Main text of web pages by composite text density.

A page becomes a tree of its tags. A node's density is its characters per tag,
adjusted by the share of them that is linked: text in links weighs the less,
the more of the page it makes up. Every node's children's densities are summed;
the node with the largest sum marks the main content, and the least density on
its path to the body is the threshold that a subtree must reach. The chosen
subtree is then read block by block without what is no article text. The body is
such a subtree like any other: sections and the first heading that lie in it side
by side are read together, without children that are mostly links.

After Sun, Song and Liao, DOM Based Content Extraction via Text Density (2011).
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from tamis.llm.text import arrow_map, named, utf8

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot
    th thead tr ul""".split()
)
ENDS_P = BLOCK - frozenset("body html li dd dt td th tr tbody thead tfoot".split())
NOT_TEXT = frozenset(
    """aside button canvas datalist dialog footer form head header iframe input menu nav noembed noframes noscript
    object option script select style svg template textarea title video audio""".split()
)
# Names of class, id and role that mark what is no article text, and words that say only which or where.
_OFF = frozenset(
    """ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies
    consent copyright disqus dropdown footer header masthead menu nav navbar navigation newsletter notice popup promo
    promoted related replies reply respond share sharing sidebar social sponsor sponsored subscribe toolbar widget
    contentinfo complementary search alert disclaimer modal overlay pagination pager gdpr""".split()
)
# Parts that mark a name whatever else it says, unless it only tells a state.
_SURELY_OFF = frozenset("adsbygoogle advert adverts advertisement comment comments commentlist disqus newsletter sponsored".split())
_STATE = frozenset("with has no without is not open closed enabled disabled".split())
_WHERE = frozenset(
    """area articles bar bottom box block button buttons center column container content form global group inner item
    items left links list main mobile news outer page post posts primary right secondary section site slot sticky stories
    text top unit wrap wrapper""".split()
)
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^<>])*))>",
    re.S,
)
_ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[_:-]+")
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_UNSEEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)", re.I)
_NO_DISPLAY = re.compile(r"(?:^|\s)style\s*=\s*(?:\"[^\"]*|'[^']*|\S*)display\s*:\s*none", re.I)
_NEVER_OFF = frozenset("html body main article".split())
_SPACE = re.compile(r"\s+")
# An open element of the first kind ends where one of the second begins.
_CLOSED_BY = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "thead", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
}
_ENDED_BY = {late: [k for k, v in _CLOSED_BY.items() if late in v] for late in frozenset().union(*_CLOSED_BY.values())}
_ITEMS = frozenset("p li dd dt".split())
_SCOPE = frozenset("ul ol dl table html body article section div td th blockquote".split())


class Node:
    __slots__ = ("name", "off", "marked", "items", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, name: str, off: bool = False, marked: bool = False):
        self.name, self.off, self.marked = name, off, marked  # off by its kind or role; marked by class or id
        self.items: list[Node | str] = []


def _off_name(name: str) -> bool:
    """Whether a whole name says so: ``ad``, ``site-footer``, ``ad-728``; not ``with-sidebar`` or ``entry-header``."""
    parts = [p for p in _PARTS.split(name) if p and not p.isdigit()]
    if not _SURELY_OFF.isdisjoint(parts) and _STATE.isdisjoint(parts):
        return True
    return any(p in _OFF for p in parts) and all(p in _OFF or p in _WHERE for p in parts)


def _marked_off(rest: str) -> set[str]:
    """Those of ``class``, ``id`` and ``role`` that mark an element as no article text."""
    found = ((m[1].lower(), (m[2] or m[3] or m[4] or "").lower().split()) for m in _ATTR.finditer(rest))
    return {kind for kind, names in found if any(map(_off_name, names))}


def _unseen(rest: str) -> bool:
    """Whether the attributes hide the element."""
    low = rest.lower()
    return "hidden" in low and _UNSEEN.search(_QUOTED.sub("", rest)) is not None or "display" in low and _NO_DISPLAY.search(rest) is not None


class _Open:
    """The open elements, with a count per name so that a search that must fail is not begun."""

    def __init__(self, root: Node):
        self.nodes, self.count = [root], Counter()

    def push(self, node: Node) -> None:
        self.nodes.append(node)
        self.count[node.name] += 1

    def cut(self, i: int) -> None:
        self.count.subtract(n.name for n in self.nodes[i:])
        del self.nodes[i:]

    def close(self, name: str) -> None:
        """An end tag. Inline ones close nothing outside their block, ``p`` and items nothing outside their list."""
        if not self.count[name]:
            return
        for i in range(len(self.nodes) - 1, 0, -1):
            open_ = self.nodes[i].name
            if open_ == name:
                return self.cut(i)
            if name not in BLOCK and open_ in BLOCK or name in _ITEMS and open_ in _SCOPE:
                return None

    def end_paragraph(self) -> None:
        if not self.count["p"]:
            return
        for i in range(len(self.nodes) - 1, 0, -1):
            if self.nodes[i].name == "p":
                return self.cut(i)
            if self.nodes[i].name in BLOCK:
                return None

    def end_siblings(self, name: str) -> None:
        if not any(self.count[s] for s in _ENDED_BY.get(name, ())):
            return
        for i in range(len(self.nodes) - 1, 0, -1):
            open_ = self.nodes[i].name
            if name in _CLOSED_BY.get(open_, ()):
                return self.cut(i)
            if open_ in _SCOPE:
                return None


def parse(source: str) -> Node:
    """Tree of a page; unknown, unclosed and stray tags are tolerated."""
    root = Node("html")
    tree, at, length = _Open(root), 0, len(source)
    while (m := _TAG.search(source, at)) is not None:
        if m.start() > at:
            tree.nodes[-1].items.append(source[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            if source.startswith("<![CDATA[", m.start()):
                tree.nodes[-1].items.append(m[0][9:].removesuffix("]]>"))
            continue
        name = name.lower()
        if m["end"]:
            tree.close(name)
            continue
        if name == "html" or name == "body" and tree.count["body"]:
            continue
        if name in ENDS_P:
            tree.end_paragraph()
        tree.end_siblings(name)
        rest = m["rest"]
        marks = _marked_off(rest) if "=" in rest and name not in _NEVER_OFF else ()
        own_header = name == "header" and (tree.count["article"] or tree.count["main"])  # may hold the article's heading
        off = name in NOT_TEXT and not own_header or "role" in marks or bool(rest) and _unseen(rest)
        node = Node(name, off, bool(marks) or bool(own_header))
        tree.nodes[-1].items.append(node)
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(source, at)
            node.items.append(source[at : end.start() if end else length])
            at = end.end() if end else length
        elif name not in VOID and (not rest.endswith("/") or name in BLOCK):
            tree.push(node)
    if at < length:
        tree.nodes[-1].items.append(source[at:])
    return root


def _text(raw: str) -> str:
    return html.unescape(raw) if "&" in raw else raw


def _measure(root: Node) -> list[tuple[Node, Node | None]]:
    """Sets each node's counts; nodes with their parents, children after parents."""
    order: list[tuple[Node, Node | None]] = [(root, None)]
    for node, _ in order:
        order += [(c, node) for c in node.items if isinstance(c, Node)]
    for node, _ in reversed(order):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        if node.name in RAW:
            continue
        for c in node.items:
            if isinstance(c, str):
                node.chars += len("".join(_text(c).split()))
            else:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags
        if node.name == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
    return order


def _leave_out(order: list[tuple[Node, Node | None]]) -> None:
    """Marked nodes are off, but those that hold the page's heading, a main or its article.

    Only where that leaves no unlinked text at all, those with most of it stay.
    """
    marked = [n for n, _ in order if n.marked and not n.off]
    if not marked:
        return
    root, parents = order[0][0], {id(n): p for n, p in order}
    holders = [n for n, _ in order if n.name == "main"]
    holders += [n for n, _ in order if n.name == "h1"][:1]
    below: set[int] = set()  # marked nodes and what they hold
    for n, parent in order:
        if n.marked or id(parent) in below:
            below.add(id(n))
    articles = [n for n, _ in order if n.name == "article"]
    articles = [n for n in articles if id(n) not in below] or articles
    holders += [max(articles, key=lambda n: n.chars - n.link_chars)] if articles else []
    held: set[int] = set()
    for node in holders:
        while node is not None and id(node) not in held:
            held.add(id(node))
            node = parents[id(node)]
    for n in marked:
        n.off = id(n) not in held
    gone: set[int] = set()
    for n, parent in order:
        if n.off or n.name == "a" or id(parent) in gone:
            gone.add(id(n))
        elif n.chars > sum(c.chars for c in n.items if isinstance(c, Node)):
            return
    for n in marked:
        n.off = n.off and 2 * (n.chars - n.link_chars) <= root.chars - root.link_chars


def _densities(order: list[tuple[Node, Node | None]], body: Node) -> None:
    body_share = body.link_chars / body.chars if body.chars else 0.0
    for node, _ in order:
        c, t, lc, lt = node.chars, node.tags or 1, node.link_chars or 1, node.link_tags or 1
        if not c:
            node.density = 0.0
            continue
        plain = max(c - node.link_chars, 1)
        base = math.log(c / plain * node.link_chars + body_share * c + math.e)
        node.density = c / t * math.log(max(c / lc * t / lt, 1.0) + 1e-9) / math.log(max(base, 1.0) + 1.0)
    for node, _ in order:
        node.total = sum(c.density for c in node.items if isinstance(c, Node) and not c.off)


def _blocks(node: Node) -> Iterator[str]:
    """Texts of the blocks below ``node`` in page order."""
    held: list[str] = []
    todo: list = [node]
    while todo:
        item = todo.pop()
        if item is None or isinstance(item, Node) and item.name in BLOCK:
            text = _SPACE.sub(" ", _text("".join(held))).strip()
            if text:
                yield text
            held.clear()
            if item is None or item.off and item is not node:
                continue
            todo.append(None)
            todo.extend(reversed(item.items))
        elif isinstance(item, str):
            held.append(item)
        elif item.name == "br":
            held.append(" ")
        elif not item.off:
            todo.extend(reversed(item.items))
    text = _SPACE.sub(" ", _text("".join(held))).strip()
    if text:
        yield text


def _mostly_links(node: Node) -> bool:
    return node.name != "h1" and 2 * node.link_chars > node.chars


def main_text(source: str) -> str:
    """The article of a page, blocks joined by line breaks; empty if there is none."""
    root = parse(source)
    order = _measure(root)
    _leave_out(order)
    parents = {id(n): p for n, p in order}
    body = next((n for n, _ in order if n.name == "body"), root)
    _densities(order, body)

    inside: set[int] = set()  # below the body, and no part of what is left out
    for n, parent in order:
        if not n.off and (n is body or id(parent) in inside):
            inside.add(id(n))
    own = [n for n, _ in order if n.chars and n.name in BLOCK and id(n) in inside]
    if not own:
        return ""
    best = max(own, key=lambda n: n.total)
    path, node = [], best
    while node is not None:
        path.append(node)
        if node is body:
            break
        node = parents[id(node)]
    threshold = min(n.density for n in path)
    title = next((n for n, _ in order if n.name == "h1" and id(n) in inside), None)
    chosen = best
    for node in path[1:]:  # the article that holds the densest node, not the node alone
        parts = [c for c in node.items if isinstance(c, Node) and not c.off and not (node is body and _mostly_links(c))]
        others = sum(c.chars for c in parts if c.density >= threshold or c is title)
        if node.name in ("article", "main") or others > chosen.chars:
            chosen = node
    if chosen is body and best is not body:
        for c in body.items:
            if isinstance(c, Node) and c.name in BLOCK and _mostly_links(c):
                c.off = True
    return "\n".join(_blocks(chosen))


def extract(pages: DataFrame, html_col: str = "html", name: str = "text") -> DataFrame:
    """``pages`` without its html, with the main text of the whole page.

    A null page, or one without text outside menus and the like, has an empty
    text. Character references are decoded, white space inside a block becomes
    one space. Repeated rows repeat their result, an empty table stays empty,
    other columns pass through.
    """
    body = named(pages, "__body")
    keep = [c for c in pages.columns if c not in (html_col, name)]

    def each(chunk) -> dict:
        return {name: [main_text(t.decode("utf-8", "replace")) for t in chunk.column(body).to_pylist()]}

    return arrow_map(pages.select(*keep, utf8(F.col(html_col)).alias(body)), each, f"`{name}` string", body, keep)
