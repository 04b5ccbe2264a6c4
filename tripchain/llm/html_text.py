"""Main text of web pages by composite text density.

A page becomes a tree of its block elements. Each node has its characters, tags, link characters and link tags; its density is characters
per tag, adjusted for links and for the share of links in the body. Every node sums the densities of its children (running text is a child
of its own). The node of the largest sum marks the main text; the least density on its path up to the body is the threshold. The
text is the outermost ``article`` or ``main`` element that holds the marked node, as that element says where the article begins and ends;
without one it is the marked node and those of its siblings, on each level of the path, that are headings or reach the threshold.

Elements that are never article text are not put into the tree: by tag (scripts, styles, menus, footers, forms, ...), by role, and hidden ones. Such an
element ends like any other, also where its end tag is omitted. Names in class and id have a say only where they name the element itself (``sidebar``,
``related-posts``; not ``with-sidebar``), and not for one that wraps the article: one that holds an ``article`` or ``main`` element or, where none stands beside it, more than ``WRAPPED`` of
the page's characters. What is named so is taken out of the tree before densities are measured, unless nothing would be left.
Character references are decoded, white space inside a block becomes one space, blocks are joined by one.

Defined cases: null and empty pages have an empty text; broken markup ends where the page ends, and an end tag without a start is passed over;
a page without elements is its own text; pages are independent of each other, so repeated rows stay; an empty table stays empty; whole pages are read.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripchain.llm.common import tidy

# Elements by their part in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label".split())
NEVER = frozenset("head title script style noscript template nav footer aside form button select option textarea input iframe svg canvas object audio video dialog menu".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_CELLS, _ROWS = ({"td", "th"},), ({"td", "th"}, {"tr"})
_PARTS = (*_ROWS, {"tbody", "thead", "tfoot"})
# What a start tag ends, one after the other.
SAME_END = {"li": ({"li"},), "dt": ({"dt", "dd"},), "dd": ({"dt", "dd"},), "tr": _ROWS, "td": _CELLS, "th": _CELLS, "option": ({"option"},),
            "tbody": _PARTS, "thead": _PARTS, "tfoot": _PARTS}
IN_HEAD = frozenset("head base basefont bgsound link meta noframes noscript script style template title".split())
# Tags inside these end nothing outside; these go on inside a block that ends the paragraph round them.
SEALED = frozenset("title textarea template iframe noscript select object svg canvas audio video script style".split())
FORMATTING = frozenset("a b big code em font i s small strike strong tt u".split())
HOLDS = frozenset("ul ol dl table tbody thead tfoot tr article section div body main".split())
ENDS_AT = HOLDS | SEALED
P_ENDS_AT = SEALED | {"table", "button"}
ITEMS_END_AT = SEALED | {"ul", "ol", "dl", "table"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# Words of class and id that name what is around an article.
NEVER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "footer masthead comment comments discussion replies disqus cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended widget toolbar pagination pager alert".split())
# Words that may stand beside one of these in a name without changing whose name it is.
BESIDE = frozenset(
    "area bar block body bottom box button buttons container content count footer form group header icons inner item items list left link links "
    "main module outer page pages panel post posts primary right row secondary section site top wrap wrapper".split())
#: Share of the page's characters above which a named element counts as a wrapper.
WRAPPED = 0.75
_WORDS = re.compile(r"[a-z]+")


def names_surroundings(names: str) -> bool:
    """Whether a name among those of class and id says that the element stands around an article."""
    for name in names.lower().split():
        words = set(_WORDS.findall(name))
        if words & NEVER_WORDS and words <= NEVER_WORDS | BESIDE:
            return True
    return False


class Node:
    __slots__ = ("tag", "parts", "parent", "named", "chars", "tags", "link_chars", "link_tags", "density", "sum")

    def __init__(self, tag: str, parent: Node | None, named: bool = False):
        self.tag, self.parent, self.named, self.parts = tag, parent, named, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0


class PageTree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.node = Node("body", None)
        # Of the open elements, those from place ``skipped`` on are not in the tree.
        self.open: list[tuple[str, Node]] = []
        self.skipped: int | None = None
        # Places of the open elements by tag, and of those formatting ones that are named as surroundings.
        self.places: defaultdict[str, list[int]] = defaultdict(list)
        self.fenced: list[int] = []
        self.links = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.skipped is not None and self.open[self.skipped][0] == "head" and tag not in IN_HEAD:
            self._close({"head"}, SEALED)
        if tag in CLOSES_P:
            if self.skipped is not None and self.open[self.skipped][0] in FORMATTING:
                least = self.skipped
            else:
                least = self.fenced[-1] if self.fenced else 0
            self._close({"p"}, P_ENDS_AT, least)
        elif tag in SAME_END:
            for ended in SAME_END[tag]:
                self._close(ended, ITEMS_END_AT)
        if tag in ("html", "body"):
            return
        if self.skipped is not None:
            if tag not in VOID:
                self._push(tag, self.node)
            return
        attributes = dict(attrs)
        if tag in NEVER or self._around(tag, attributes):
            if tag not in VOID:
                self.skipped = len(self.open)
                self._push(tag, self.node)
            return
        named = tag not in VOID and tag not in ("article", "main") and bool(attributes) and names_surroundings(
            f"{attributes.get('class') or ''} {attributes.get('id') or ''}")
        if tag == "a":
            self.links += 1
            self.node.link_tags += 1
        if tag in INLINE and not named and tag not in VOID:
            self.node.tags += 1
            self._push(tag, self.node)
            return
        if tag in VOID:
            self.node.tags += 1
            if tag in ("br", "hr"):
                self.node.parts.append("\n")
            return
        child = Node(tag, self.node, named)
        self.node.parts.append(child)
        self.node = child
        if named and tag in FORMATTING:
            self.fenced.append(len(self.open))
        self._push(tag, child)

    def _push(self, tag: str, node: Node) -> None:
        self.places[tag].append(len(self.open))
        self.open.append((tag, node))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # A slash at the end means nothing in HTML, but for elements that end at once anyway, and for drawings and what is in them.
        if tag == "svg" or self.places["svg"]:
            return
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            if self.skipped is None:
                self.node.parts.append("\n")
        elif tag not in ("html", "body"):
            if self.skipped is not None and tag == self.open[self.skipped][0]:
                self._close({tag}, set())
            else:
                self._close({tag}, SEALED if tag in HOLDS else ENDS_AT)

    def handle_data(self, data: str) -> None:
        if self.skipped is not None and self.open[-1][0] == "head" and data.strip():
            self._close({"head"}, set())
        if self.skipped is None:
            self.node.parts.append(data)
            if self.links:
                self.node.link_chars += len(data)

    def _close(self, tags: set[str] | frozenset[str], stop: set[str] | frozenset[str], least: int = 0) -> None:
        """End the innermost open element of ``tags`` and all in it, if none of ``stop`` and not place ``least`` comes first."""
        found = max((self.places[t][-1] for t in tags if self.places[t]), default=-1)
        if found < least or any(self.places[t] and self.places[t][-1] > found for t in stop if t not in tags):
            return
        for at in range(len(self.open) - 1, found - 1, -1):
            name = self.open[at][0]
            self.places[name].pop()
            self.links -= name == "a" and (self.skipped is None or at < self.skipped)
        del self.open[found:]
        while self.fenced and self.fenced[-1] >= found:
            self.fenced.pop()
        if self.skipped is not None and found <= self.skipped:
            self.skipped = None
        self.node = self.open[-1][1] if self.open else self.root

    def _around(self, tag: str, attrs: dict[str, str | None]) -> bool:
        """Whether an element stands around the article rather than in it."""
        inside = bool(self.places["article"] or self.places["main"])
        if tag == "header" and not inside:
            return True
        if not attrs:
            return False
        if "hidden" in attrs or "display:none" in (attrs.get("style") or "").replace(" ", "").lower() or (attrs.get("aria-hidden") or "").lower() == "true":
            return True
        return (attrs.get("role") or "").lower() in NEVER_ROLES


def without_surroundings(root: Node) -> Node:
    """The tree without the elements whose names say that they stand around the article, unless they wrap it."""
    nodes, at = [root], 0
    while at < len(nodes):
        nodes += [p for p in nodes[at].parts if isinstance(p, Node)]
        at += 1
    chars, holds = {}, set()
    for node in reversed(nodes):
        chars[id(node)] = sum(len(p.strip()) if isinstance(p, str) else chars[id(p)] for p in node.parts)
        if node.tag in ("article", "main") or any(id(p) in holds for p in node.parts):
            holds.add(id(node))
    most = WRAPPED * chars[id(root)]
    inside: set[int] = set()
    for node in nodes:
        if node.parent is not None and (id(node.parent) in inside or node.parent.tag in ("article", "main")):
            inside.add(id(node))
    # Beside an article it is no wrapper, however much it holds.
    beside = lambda node: id(root) in holds and id(node) not in inside
    goes = {id(n) for n in nodes if n.named and id(n) not in holds and (chars[id(n)] <= most or beside(n))}
    left = chars[id(root)]
    gone: set[int] = set()
    for node in nodes:
        if node.parent is not None and id(node.parent) in gone:
            gone.add(id(node))
        elif id(node) in goes:
            gone.add(id(node))
            left -= chars[id(node)]
    if left > 0:
        for node in nodes:
            if any(id(p) in goes for p in node.parts):
                node.parts = [p for p in node.parts if id(p) not in goes]
    return root


def measure(root: Node) -> list[Node]:
    """Densities and density sums of all nodes, parents first in the list."""
    nodes, at = [root], 0
    while at < len(nodes):
        nodes += [p for p in nodes[at].parts if isinstance(p, Node)]
        at += 1
    for node in reversed(nodes):
        node.chars += sum(len(p.strip()) for p in node.parts if isinstance(p, str))
        if node.parent is not None:
            up = node.parent
            up.chars, up.tags = up.chars + node.chars, up.tags + node.tags + 1
            up.link_chars, up.link_tags = up.link_chars + node.link_chars, up.link_tags + node.link_tags
    share = root.link_chars / max(1, root.chars)

    def density(chars: int, tags: int, link_chars: int, link_tags: int) -> float:
        if not chars:
            return 0.0
        tags = max(1, tags)
        base = math.log(max(1.0, chars / max(1, chars - link_chars) * link_chars + share * chars) + math.e)
        return chars / tags * math.log(max(1.0, chars / max(1, link_chars) * tags / max(1, link_tags))) / math.log(base)

    for node in nodes:
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags)
    for node in nodes:
        inner = [p for p in node.parts if isinstance(p, Node)]
        own = node.chars - sum(p.chars for p in inner)
        links = node.link_chars - sum(p.link_chars for p in inner), node.link_tags - sum(p.link_tags for p in inner)
        node.sum = sum(p.density for p in inner) + density(own, 1, *links)
    return nodes


def chosen(root: Node) -> list[Node]:
    """The nodes that hold the main text, in page order."""
    nodes = measure(root)
    best = max(nodes, key=lambda n: n.sum)  # of equal ones the one nearest to the body
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    for node in reversed(path):
        if node.tag in ("article", "main"):
            return [node]
    least = min(n.density for n in path)
    kept: list[Node] = []
    for node, up in zip(path, path[1:]):
        beside = [p for p in up.parts if isinstance(p, Node)]
        here = beside.index(node)
        good = [p is node or p.tag in HEADINGS or (p.chars > 0 and p.density >= least) for p in beside]
        before = [p for p, ok in zip(beside[:here], good[:here]) if ok]
        after = [p for p, ok in zip(beside[here + 1 :], good[here + 1 :]) if ok]
        kept = before + (kept or [node]) + after
    return kept or [best]


def _blocks(node: Node, out: list[str]) -> None:
    stack: list[object] = [node]
    while stack:
        part = stack.pop()
        if isinstance(part, str):
            out.append(part)
        else:
            out.append("\n")
            stack.append("\n")
            stack.extend(reversed(part.parts))


def main_text(html: str) -> str:
    tree = PageTree()
    tree.feed(html)
    tree.close()
    out: list[str] = []
    for node in chosen(without_surroundings(tree.root)):
        _blocks(node, out)
    return " ".join("".join(out).split())


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [main_text(h) if h else "" for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(tidy(run), f"page_id {kinds['page_id']}, url {kinds['url']}, text string").withColumn("n_chars", F.length("text").cast("long"))
