"""Main text of web pages by composite text density.

Every node of a page's tree gets its characters per tag, adjusted for how much of it is link text; a node's density sum
adds the densities of its children. The node with the largest sum is the core of the article, and the least density on its
way up to the body is the threshold that neighbouring parts have to reach to be part of it as well. Menus, forms, notices
and the like are left out of the tree before any density is computed, unless the page's own text lies within them: a marked
part that wraps the page stays, and marks count below it only. <article> and <main> widen the core, they never narrow it.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the page language.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title noscript template iframe textarea xmp noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot"
    " th thead tr ul".split()
)
_CLOSES_P = _BLOCK - frozenset("body caption html td th tr tbody thead tfoot".split())
_ALIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}
_ALIKE |= {"option": ("option",)}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table")}
_SCOPE |= {"th": ("tr", "table"), "option": ("select",)}
_P_SCOPE = ("button", "td", "th", "caption", "object")
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements, roles and words of class and id that mark what is no part of an article.
_NEVER = frozenset("button select svg canvas object audio video datalist".split())
_NO_ARTICLE = frozenset("nav footer aside form dialog menu search".split())
_NO_ROLE = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())
_COMMENTS = frozenset("comment comments commentlist reply replies respond disqus discussion responses".split())
_NO_WORD = _COMMENTS | frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies"
    " consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup sidebar"
    " sidebars menu menus nav navbar navigation breadcrumb breadcrumbs masthead footer share sharing social related"
    " recommended recommendations widget widgets toolbar pagination pager login paywall skip".split()
)
# Marks of parts that list other articles, and words that make a class the state of a page ("has-sidebar").
_TEASERS = frozenset("<nav> <footer> <aside> complementary related recommended recommendations promo promotion sponsor sponsored".split())
_STATE = frozenset("has with no without is open opened closed on off enabled disabled visible collapsed expanded".split())
_PARAGRAPH = _HEADING | frozenset("p blockquote pre".split())
_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)[\"']*>?",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")


class _Node:
    __slots__ = (
        *("tag", "up", "out", "main", "comment", "marks", "named", "first", "last", "chars", "linked", "tags", "links"),
        *("density", "total", "children", "within"),
    )

    def __init__(self, tag: str, up: _Node | None, first: int) -> None:
        self.tag, self.up, self.first, self.last = tag, up, first, -1
        self.out = self.main = self.comment = self.named = self.within = False
        self.marks: set[str] = set()
        self.chars = self.linked = self.tags = self.links = 0
        self.density = self.total = 0.0
        self.children: list[_Node] = []


def _judge(node: _Node, text: str) -> None:
    """Set what a node's name and attributes say about it."""
    attributes = {}
    if text and not text.isspace():
        for name, a, b, c in _ATTRIBUTE.findall(text):
            attributes.setdefault(name.lower(), entities.unescape(a or b or c))
    tokens = [{x.lower() for x in _WORD.findall(t)} for t in f"{attributes.get('class', '')} {attributes.get('id', '')}".split()]
    names = set().union(*tokens)
    own = set().union(*(t for t in tokens if not t & _STATE))
    role = attributes.get("role", "").strip().lower()
    node.comment = bool(own & _COMMENTS)
    node.main = (node.tag in ("article", "main") or role in ("main", "article")) and not node.comment
    hidden = "hidden" in attributes or re.search(r"display\s*:\s*none", attributes.get("style", "")) is not None
    if node.tag in ("html", "body") or node.main:
        node.out = hidden and node.tag not in ("html", "body")
        return
    node.out = hidden or node.tag in _NEVER
    node.marks = names & _NO_WORD
    node.named = bool(own & _NO_WORD)
    if node.tag in _NO_ARTICLE:
        node.marks.add(f"<{node.tag}>")
    if role in _NO_ROLE:
        node.marks.add(role)
    if node.tag == "header" or (names & {"header"} and not names & {"article", "post", "entry", "story", "title"}):
        # A heading line within the article is part of it; any other page header isn't.
        if not node.within:
            node.marks.add("header")
    node.named = node.named or bool(node.marks - names)


def parse(page: str) -> tuple[list[_Node], list[str | None]]:
    """Return the nodes of a page and its text in order; None stands for the bounds of blocks. Hidden parts have no text."""
    root = _Node("html", None, 0)
    nodes, flow, stack = [root], [], [root]
    # Places in the stack of the open nodes per tag, so that no tag has to walk the stack.
    places: dict[str, list[int]] = {}

    def text(raw: str) -> None:
        if raw and not stack[-1].out:
            flow.append(entities.unescape(raw) if "&" in raw else raw)

    def innermost(tag: str) -> int:
        """Return the place of the innermost open node of a tag, 0 if there is none."""
        found = places.get(tag)
        return found[-1] if found else 0

    def close(k: int) -> None:
        """End the nodes of the stack from index ``k`` on."""
        for node in reversed(stack[k:]):
            if node.tag in _BLOCK:
                flow.append(None)
            node.last = len(flow)
            if node is not root:
                places[node.tag].pop()
        del stack[k:]

    at = 0
    while found := _TOKEN.search(page, at):
        text(page[at : found.start()])
        at, tag = found.end(), (found[2] or "").lower()
        if found[0].startswith("<![CDATA["):
            text(found[0][9:-3].replace("&", "&amp;"))
        if not tag:
            continue
        if found[1]:
            if tag not in ("html", "body") and (k := innermost(tag)):
                close(k)
            continue
        if tag == "html" or tag == "body" and innermost("body"):
            continue
        if tag in _RAW:
            # In the page as it is: other cases of a letter may differ from it in length.
            end = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE | re.ASCII).search(page, at)
            at = len(page) if end is None else end.end()
            at = len(page) if end is None or (gt := page.find(">", at)) < 0 else gt + 1
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in _CLOSES_P and (k := innermost("p")) > max(map(innermost, _P_SCOPE)):
            close(k)
        for other in _ALIKE.get(tag, ()):
            if (k := innermost(other)) > max(map(innermost, _SCOPE[tag])):
                close(k)
        if tag == "body" and places.get("head"):
            close(places["head"][0])
        node = _Node(tag, stack[-1], len(flow))
        node.within = node.up.within or node.up.main
        if tag in _BLOCK:
            flow.append(None)
            node.first = len(flow)
        if stack[-1].out:
            node.out = True
        else:
            _judge(node, found[3])
        if tag == "head":
            node.out = True
        if not node.out:
            node.up.children.append(node)
            nodes.append(node)
        if tag in _VOID or found[3].endswith("/") and tag not in _BLOCK:
            node.last = len(flow)
        else:
            places.setdefault(tag, []).append(len(stack))
            stack.append(node)
    text(page[at:])
    close(0)
    root.last = len(flow)
    return nodes, flow


def _measure(nodes: list[_Node], flow: list[str | None]) -> None:
    """Fill characters and link characters of all nodes."""
    lengths = [0]
    for x in flow:
        lengths.append(lengths[-1] + (len("".join(x.split())) if x else 0))
    for node in nodes:
        node.chars = lengths[node.last] - lengths[node.first]
    for node in reversed(nodes):  # children come after their parents
        node.linked = node.chars if node.tag == "a" else sum(x.linked for x in node.children)


def leave_out(nodes: list[_Node], flow: list[str | None]) -> list[_Node]:
    """Return the nodes without marked parts, whose text is emptied in ``flow``.

    A marked part stays if it wraps the page: if it has most of the unlinked text, or holds an article. Parts that list
    other articles have to hold half of all article text. Discussions, and parts named by their mark that stand beside an
    article, are often longer than it: they need nine tenths of the text, and a discussion beside an article never stays.
    Marks that many parts share ("widget") are judged by what these parts have together.
    """
    if not any(x.marks for x in nodes):
        return nodes
    _measure(nodes, flow)
    size = {id(x): x.chars - x.linked for x in nodes}
    whole = size[id(nodes[0])]
    held: dict[int, int] = {}  # unlinked text of the outermost articles within a node
    around: set[int] = set()  # nodes below an article
    plain = False  # an article that no mark is above of
    below: set[int] = set()  # nodes at or below a mark
    for node in nodes:
        up = node.up
        if up is not None and (up.main or id(up) in around):
            around.add(id(node))
        if node.marks or up is not None and id(up) in below:
            below.add(id(node))
        elif node.main and size[id(node)]:
            plain = True
    for node in reversed(nodes):
        held[id(node)] = size[id(node)] if node.main else sum(held[id(x)] for x in node.children)
    articles = held[id(nodes[0])]

    def tenths(node: _Node) -> int:
        beside = node.named and plain and id(node) not in around
        return 10 if node.comment and beside else 9 if node.comment or beside else 5

    def wraps(node: _Node) -> bool:
        inside = sum(held[id(x)] for x in node.children)
        if inside and (not node.marks & _TEASERS and not node.comment or 2 * inside >= articles):
            return True
        return 10 * size[id(node)] > tenths(node) * whole

    marked = [x for x in nodes if x.marks and not wraps(x)]
    shared: dict[str, list[int]] = {}
    ends: dict[str, int] = {}
    for node in marked:
        for mark in node.marks:
            if node.first >= ends.get(mark, 0):  # the outermost ones, in page order
                ends[mark] = node.last
                total = shared.setdefault(mark, [0, 0])
                total[0] += size[id(node)]
                total[1] = max(total[1], tenths(node))
    void = {mark for mark, (total, least) in shared.items() if 10 * total > least * whole}
    for node in marked:
        node.out = bool(node.marks - void)
    kept = []
    for node in nodes:
        if node.up is not None and node.up.out:
            node.out = True
        elif node.out:
            for k in range(node.first, node.last):
                if flow[k] is not None:
                    flow[k] = ""
        if not node.out:
            node.children = [x for x in node.children if not x.out]
            kept.append(node)
    return kept


def densities(nodes: list[_Node], flow: list[str | None]) -> None:
    """Fill characters, tags, densities and density sums of all nodes."""
    _measure(nodes, flow)
    for node in reversed(nodes):
        node.tags = len(node.children) + sum(x.tags for x in node.children)
        node.links = sum((x.tag == "a") + x.links for x in node.children)
    body = nodes[0]
    share = body.linked / max(body.chars, 1)
    for node in nodes:
        if not node.chars:
            continue
        tags = max(node.tags, 1)
        base = math.log(node.chars / max(node.chars - node.linked, 1) * node.linked + share * node.chars + math.e)
        inner = node.chars / max(node.linked, 1) * tags / max(node.links, 1)
        # The base is 1 for a text without links, whose adjustment would be unbounded: it counts in natural logarithms.
        node.density = node.chars / tags * math.log(max(inner, 1.0)) / (math.log(base) if base > math.e else 1.0)
    for node in nodes:
        node.total = sum(x.density for x in node.children)


def _content(nodes: list[_Node]) -> list[_Node]:
    """Return the nodes that make up the article, in page order.

    The node of the largest density sum and the least density from it to the body decide. The nearest <article> or <main>
    around that node comes along as a whole, and paragraphs beside it within an outer one; siblings that reach the
    threshold stay whatever the tags are.
    """
    best = max(nodes, key=lambda x: x.total)  # the first of equal ones
    if best.total <= 0:
        best = nodes[0]
    path, up = [best], best.up
    while up is not None:
        path.append(up)
        up = up.up
    top = [x for x in path if x.tag != "html"] or path
    threshold = min(x.density for x in top)
    core = next((x for x in path if x.main), None)
    within: set[int] = set()  # nodes whose unlinked children all stay
    if core is None:
        core = best
        # The body or a wrapper was chosen, for example where the article is one block: lists of links beside it are no part.
        inside = [x for x in nodes if x.main and best.first <= x.first and x.last <= best.last and not (x.up and x.up.main)]
        largest = max(inside, key=lambda x: x.chars, default=None)
        if largest is not None and 2 * largest.chars >= best.chars:
            core, up = largest, largest.up
            while up is not None and up is not best.up:
                within.add(id(up))
                up = up.up
    steps, up = [], core.up
    while up is not None:
        steps.append(up)
        up = up.up
    chosen, last = {id(core)}, core
    outer = max((k for k, x in enumerate(steps) if x.main), default=-1)
    for k, node in enumerate(steps):
        for child in node.children:
            if child is last or not child.chars:
                continue
            unlinked = 2 * child.linked < child.chars
            if child.tag in _HEADING and child.first < core.first or unlinked and (
                child.density >= threshold or id(node) in within or k <= outer and child.tag in _PARAGRAPH
            ):
                chosen.add(id(child))
        last = node
    return [x for x in nodes if id(x) in chosen]


def main_text(page: str | None) -> str:
    """Return the article of a page: its blocks in page order, one per line; empty if there is none."""
    if not page or not page.strip():
        return ""
    nodes, flow = parse(page)
    nodes = leave_out(nodes, flow)
    densities(nodes, flow)
    lines = []
    for node in _content(nodes):
        block: list[str] = []
        for x in [*flow[node.first : node.last], None]:
            if x is not None:
                block.append(x)
            elif block:
                if line := " ".join("".join(block).split()):
                    lines.append(line)
                block = []
    return "\n".join(lines)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Return (page_id, url, text, n_chars) for every row of ``pages``, whole pages throughout.

    ``text`` is the article with character references decoded, white space within a block turned into one blank and blocks
    joined by line feeds; ``n_chars`` counts its code points. A null, empty or textless page has an empty text. Ids and
    addresses may be null or repeat; further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                text = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")
    )
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
