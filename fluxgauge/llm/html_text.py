"""Main text of web pages by tree scoring.

A page becomes a tree (unclosed and crossed tags as browsers mend them, roughly). Menus, forms, notices
and the like are left out by element, by role, and where the whole name of a box (class or id) says so.
Every paragraph then has points for itself, its commas and its length, and passes them to its ancestors,
fewer the farther they are; an ancestor's sum is discounted by its link density. The best container is
the article (if it is in an article element, that one), with siblings that score well themselves; of
equal ones the first counts. Its text comes out block by block, links, formulas and all.

Null and empty pages have the empty text; so have pages of which everything is left out. Pages of any
length and depth take time in proportion. Repeated rows stay; an empty table gives no rows. Only the
columns asked for and the page are read, whatever the others' names.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right

from pyspark.sql import DataFrame

from .common import per_text

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/"']+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
#: Fixed values of HTML: elements without content, with raw content, and that stand as blocks.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - set("body html caption tbody td tfoot th thead tr option optgroup legend".split())
#: A start tag ends an open element of these, if none of the bounds is open within it.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "option": ({"option"}, {"select"}),
}
#: What is never part of an article.
LEFT_OUT = RAW | set(
    "head nav footer aside form button select input dialog menu search".split()
)
LEFT_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
LEFT_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs comment comments "
    "disqus consent cookie cookies gdpr footer foot header masthead menu menus nav navbar navigation newsletter notice notices "
    "overlay pager pagination popup modal promo promos promotion promoted recommended recommendations related reply replies "
    "respond share sharing sidebar sidebars sidenav signup login skip social sponsor sponsored sponsors subscribe subscription "
    "toolbar topbar widget widgets aside alert alerts disclaimer paywall privacy discussion feedback outbrain taboola".split()
)
#: Words that stand beside these in a name without changing what it says.
FILLER = set(
    "area bar block body bottom box btn button buttons col column container content cta fixed form global group holder icons inline inner item items "
    "js left link links list main module name note page panel post primary right row section site slot top tray unit wrap wrapper".split()
)
#: Elements whose names count: boxes, not paragraphs or words of the article.
BOXES = set("div section ul ol dl table header figure span article main center details fieldset".split())
#: Words of reader comments, which may be articles themselves.
COMMENT_WORDS = set("comment comments disqus discussion reply replies respond".split())
HARMLESS = set("has with no is without".split())
GOOD_WORDS = set("article body content entry main post story text blog page".split())
PARAGRAPHS = set("p pre td blockquote li dd h1 h2 h3 h4 h5 h6 div section article main body".split())
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    __slots__ = ("tag", "words", "left", "out", "parent", "children", "text", "linked", "links", "points", "holds")

    def __init__(self, tag: str, parent: Node | None, words: set[str] = frozenset(), out: bool = False):
        self.tag, self.parent, self.words, self.out = tag, parent, words, out
        self.children: list[Node | str] = []
        self.text = self.linked = self.links = 0  # characters of text below, those in links, and the links
        self.left = False  # its name says that it is no article
        self.points = 0.0
        self.holds = False  # an article or main element, or is one


def _attributes(raw: str) -> dict[str, str]:
    if "=" not in raw and "hidden" not in raw:
        return {}
    return {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in ATTRIBUTE.finditer(raw)}


def _start(tag: str, raw: str, parent: Node, in_article: bool) -> Node:
    words, left, out = set(), False, tag in LEFT_OUT
    if tag == "header":
        out = not in_article  # an article's own header holds its title
    if raw and not out:
        a = _attributes(raw)
        if a:
            for name in f"{a.get('class', '')} {a.get('id', '')}".split():
                parts = {x.lower() for x in NAME_PARTS.findall(name)}
                if not HARMLESS & parts:
                    words |= parts
                    # All of a name must say so: related-work is no list of related pages.
                    left |= bool(parts & LEFT_WORDS) and parts <= LEFT_WORDS | FILLER
            out = (
                "hidden" in a
                or a.get("aria-hidden", "").lower() == "true"
                or "display:none" in a.get("style", "").replace(" ", "").lower()
                or a.get("role", "").lower() in LEFT_ROLES
            ) and tag not in ("html", "body")
    node = Node(tag, parent, words, out)
    node.left = left and tag in BOXES
    return node


class _Open:
    """The open elements, by depth and by tag, so that what an end tag ends is found at once."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.of: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, node: Node) -> None:
        self.of.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def close(self, depth: int) -> None:
        """End the element at a depth and all within it."""
        while len(self.stack) > depth:
            node = self.stack.pop()
            self.of[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()

    def nearest(self, tags) -> int:
        return max((self.of[t][-1] for t in tags if self.of.get(t)), default=0)

    def end(self, tag: str) -> None:
        depth = self.nearest((tag,))
        # Crossed tags: a block isn't ended by an inline one.
        if depth and (tag in BLOCK or not self.blocks or self.blocks[-1] < depth):
            self.close(depth)

    def imply(self, tag: str) -> None:
        """End what a start tag ends."""
        if tag in CLOSES_P and self.blocks and self.stack[self.blocks[-1]].tag == "p":
            self.close(self.blocks[-1])
        if tag in IMPLIED:
            ended, bounds = IMPLIED[tag]
            bound = self.nearest(bounds)
            found = [d[bisect_right(d, bound)] for t in ended if (d := self.of.get(t)) and d[-1] > bound]
            if found:
                self.close(min(found))


def parse(page: str) -> Node:
    """The tree of a page, comments and raw content left out."""
    root = Node("#root", None)
    opened, at = _Open(root), 0
    n = len(page)
    while at < n:
        m = TOKEN.search(page, at)
        end = m.start() if m else n
        if end > at:
            opened.stack[-1].children.append(html.unescape(page[at:end]))
        if not m:
            break
        at = m.end()
        if not (name := m[2] or m[5]):
            continue
        tag, closing, raw = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            opened.end(tag)
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else n
            continue
        opened.imply(tag)
        here = opened.stack[-1]
        node = _start(tag, raw, here, bool(opened.nearest(("article", "main"))))
        here.children.append(node)
        # A slash doesn't end a block.
        if tag not in VOID and (tag in BLOCK or not raw.endswith("/")):
            opened.push(node)
    return root


def _measure(root: Node) -> list[Node]:
    """Nodes in page order, children after parents; sums lengths and finds what is left out."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in reversed(node.children) if isinstance(c, Node)]
    holders = [x for x in order if x.tag in ("article", "main")]
    plain = [x for x in holders if not x.words & COMMENT_WORDS]
    for node in plain or holders:
        node.holds = True
    for node in reversed(order):
        node.text += sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str))
        if node.tag == "a":
            node.linked = node.text
            node.links += 1
        # A name counts against an element unless the article itself is in it.
        if node.left and not node.holds:
            node.out = True
        up = node.parent
        if up is not None and not node.out:
            up.text += node.text
            up.linked += node.linked
            up.links += node.links
            up.holds |= node.holds
    return order


def _density(node: Node) -> float:
    return node.linked / node.text if node.text else 0.0


def _left(node: Node) -> bool:
    """Whether a node beside the article is left out: also a list or box of little but links."""
    if node.out:
        return True
    boxes = node.tag in ("ul", "ol", "div", "section", "table", "dl")
    return boxes and not node.holds and node.text > 0 and _density(node) > 0.8 and node.links > 1


def _own_text(node: Node) -> str:
    """Text in a node and its inline descendants."""
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x is node or (x.tag not in BLOCK and not x.out):
            stack += reversed(x.children)
    return " ".join("".join(out).split())


def best_containers(root: Node) -> list[Node]:
    """The container with the highest score, with siblings that belong to it, in page order."""
    order = _measure(root)
    gone: set[int] = set()
    scored: dict[int, Node] = {}
    for node in order:
        if node.out or (node.parent is not None and id(node.parent) in gone):
            gone.add(id(node))
            continue
        if node.tag not in PARAGRAPHS:
            continue
        own = _own_text(node)
        if not own:
            continue
        points = 1 + own.count(",") + min(len(own) / 100, 3)
        # The paragraph's container has all the points, the next half, and so on; a container of its own text too.
        up = node if node.tag in ("div", "section", "article", "main", "body") else node.parent
        share = 1.0
        while up is not None and up.tag not in ("#root", "html") and share > 0.05:
            if id(up) not in scored:
                scored[id(up)] = up
                up.points += 25 * (up.tag in ("article", "main")) + 10 * bool(up.words & GOOD_WORDS)
            up.points += points * share
            share = share / 2 if share > 0.4 else share * 2 / 3
            up = up.parent
    if not scored:
        top = [c for c in order if c.tag == "body" and not c.out] or [root]
        return top[:1]
    value = {k: x.points * (1 - _density(x)) for k, x in scored.items()}
    best = max(scored.values(), key=lambda x: value[id(x)])
    up = best
    while up is not None:  # an article is whole
        if up.tag in ("article", "main") and not up.out:
            best = up
            if up.tag == "article":
                break
        up = up.parent
    if best.parent is None or best.tag in ("body", "main"):
        return [best]
    floor = max(10.0, 0.2 * value.get(id(best), 0.0))
    out = []
    for x in best.parent.children:
        if x is best:
            out.append(x)
        elif isinstance(x, Node) and not _left(x) and id(x) not in gone and best.tag not in ("article", "main"):
            own = x.tag == "p" and x.text > 80 and _density(x) < 0.25
            if own or x.tag in ("h1", "h2") or value.get(id(x), 0.0) >= floor:
                out.append(x)
    return out


def blocks(node: Node) -> list[str]:
    """Texts of the blocks in page order, white space made single."""
    out: list[str] = []
    parts: list[str] = []

    def flush():
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            out.append(text)

    stack: list[Node | str | None] = [node]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            parts.append(x)
        elif x is node or not x.out:
            if x.tag == "br":
                parts.append(" ")
            if x.tag in BLOCK:
                flush()
                stack.append(None)
            stack += reversed(x.children)
    flush()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    return "\n".join(b for node in best_containers(parse(page)) for b in blocks(node))


def extract(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """The columns of keep, text and n_chars of each page."""

    def make():
        def run(texts):
            found = [main_text(t) for t in texts]
            return [found, [len(t) for t in found]]

        return run

    return per_text(pages, keep, html_col, "text string, n_chars bigint", make)
