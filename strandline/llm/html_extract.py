"""Main text of web pages by composite text density.

For every node of the page's tree: characters, tags, and those of both that lie in links.
A node's density is characters per tag, adjusted by the share of link characters and tags,
so that menus fall behind prose. Tags that only mark words of a line (b, br, span, ...) are
no tags here: bold words make a paragraph no thinner. The sum of the children's densities is
greatest at the node that holds the article; the least density on the path from body to it
is the threshold. Every other node of that density holds a part of the article as well, at
its own greatest sum, and the article is the least subtree that has them all. What is thinner
than the threshold falls: lists of links anywhere, and in a subtree wider than the densest
node every container that has no part.

Elements that HTML itself keeps for menus, footers, forms, scripts and the like are cut
before, and so are elements with a class, id or role that names one of these.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Elements of HTML by their part in the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body canvas center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset(
    "nav header footer aside form script style head title noscript template iframe object embed svg button select option "
    "textarea input dialog canvas audio video map".split()
)
#: Tags that mark words within a line; they count for no density and split no block.
INLINE = frozenset(
    "abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math q rb rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that hold text themselves, as against containers of blocks.
TEXT_BLOCKS = HEADINGS | frozenset("p pre blockquote dl ol ul table figure center".split())
CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot".split())
#: What an opening tag closes, up to the elements where looking stops.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: What a tag's end tag or a cell ends a search for an open paragraph at.
P_SCOPES = frozenset("td th caption button object".split())
#: Words of class, id and role that name menus, headers, footers, sidebars, notices,
#: adverts, forms or reader comments: whole ones, and ones that count as parts of words as well.
NOISE = frozenset(
    "advertising sponsor sponsored promo consent notice gdpr popup modal subscribe navigation menu main-menu header site-header page-header "
    "site-footer page-footer toolbar pagination pager search search-form login signup complementary contentinfo".split()
)
NOISE_PART = re.compile(
    r"(?:^|-)(?<!\bhas-)(?<!\bno-)(?<!\bwith-)(?<!\bwithout-)(?:ads?|advert|adverts|advertisement|banner|cookies?|newsletter|nav|navbar|breadcrumbs?|sidebar|footer|masthead|comments?|disqus)(?:$|-)"
)
KEPT_TAGS = frozenset("html body article main".split()) | HEADINGS
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)\s*(=\s*)?")
_BARE = re.compile(r"[^\s>]*")
_CLOSE = re.compile(r"[\s/]*>")
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW}


class Page:
    """Reads tags as HTML does, in time linear in the page."""

    def __init__(self, text: str):
        self.text = text
        self.last = text.rfind(">")
        #: Whether quotes hold values together; no more after one that no tag's end follows.
        self.quotes = True
        #: From here on there is no such quote.
        self.none = {'"': len(text), "'": len(text)}

    def attributes(self, at: int) -> tuple[list[tuple[str, str]], int]:
        """Names and values from ``at`` on, and the place behind the tag's end."""
        text, found = self.text, []
        start = at
        while True:
            end = _CLOSE.match(text, at)
            if end:
                return found, end.end()
            m = _ATTRIBUTE.match(text, at)
            if m is None:
                # only quotes can hide the end of the tag, as there is one in the page
                self.quotes = False
                found.clear()
                at = start
                continue
            at, value = m.end(), ""
            if m[2]:
                quote = text[at : at + 1]
                shut = -1
                if quote in self.none and quote and self.quotes and at < self.none[quote]:
                    shut = text.find(quote, at + 1)
                    if shut < 0:
                        self.none[quote] = at
                if shut >= 0:
                    value, at = text[at + 1 : shut], shut + 1
                else:
                    m2 = _BARE.match(text, at)
                    value, at = m2[0], m2.end()
            found.append((m[1].lower(), value))


def _marks(attributes: list[tuple[str, str]], tag: str) -> tuple[bool, bool]:
    """Whether an element is hidden, and whether its class, id or role is a word of NOISE."""
    hidden = noise = False
    for name, value in attributes:
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and _UNSEEN.search(value):
            hidden = hidden or tag not in ("html", "body", "article", "main")
        elif name in ("class", "id", "role") and tag not in KEPT_TAGS:
            noise = noise or any(w in NOISE or NOISE_PART.search(w) for w in value.lower().replace("_", "-").split())
    return hidden, noise


class Node:
    __slots__ = ("tag", "items", "parent", "noise", "marked", "paragraph", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: "Node | None", noise: bool = False, marked: bool = False):
        self.tag, self.parent, self.noise, self.marked = tag, parent, noise, marked
        #: The open paragraph that a block would end.
        self.paragraph: Node | None = self if tag == "p" else parent.paragraph if parent and tag not in P_SCOPES else None
        self.items: list = []  # Node or str
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def parse(text: str) -> Node:
    """The page's tree; open elements end where HTML lets them. Any text gives some tree, and
    nothing but markup is lost: what begins like a tag and never ends is text."""
    root = at = Node("#root", None)
    page = Page(text)
    depth: dict[str, int] = {}
    pos, n = 0, len(text)

    def shut(node: Node) -> Node:
        """Ends all that is open down to ``node`` and itself; what is around it."""
        cur = at
        while True:
            depth[cur.tag] -= 1
            if cur is node:
                return cur.parent
            cur = cur.parent

    while pos < n:
        lt = text.find("<", pos)
        if lt < 0 or lt > page.last and not text.startswith("<!--", lt):
            at.items.append(html.unescape(text[pos:]))
            break
        if lt > pos:
            at.items.append(html.unescape(text[pos:lt]))
        if text.startswith("<!--", lt):
            if text.startswith(">", lt + 4) or text.startswith("->", lt + 4):
                pos = text.index(">", lt) + 1
                continue
            end = text.find("-->", lt + 4)
            pos = end + 3 if end >= 0 else n
            continue
        closing = text.startswith("/", lt + 1)
        name = _NAME.match(text, lt + 1 + closing)
        if name is None:
            if closing or text[lt + 1] in "!?":
                pos = text.index(">", lt) + 1
            else:
                at.items.append("<")
                pos = lt + 1
            continue
        tag = name[0].lower()
        if closing:
            pos = text.index(">", lt) + 1
            if tag == "p" and at.paragraph is None:
                at.items.append(Node("p", at))
            elif depth.get(tag):
                node = at
                while node.tag != tag:
                    node = node.parent
                at = shut(node)
            continue
        attributes, pos = page.attributes(name.end())
        if tag in CLOSES_P and at.paragraph is not None:
            at = shut(at.paragraph)
        if tag in IMPLIED:
            ends, stops = IMPLIED[tag]
            node, hit, left = at, None, sum(depth.get(e, 0) for e in ends)
            while left and node.tag not in stops:
                if node.tag in ends:
                    hit, left = node, left - 1
                node = node.parent
            if hit is not None:
                at = shut(hit)
        if tag == "body" and depth.get("head"):
            node = at
            while node.tag != "head":
                node = node.parent
            at = shut(node)
        noise, marked = tag in DROPPED, False
        if not noise and attributes:
            noise, marked = _marks(attributes, tag)
        node = Node(tag, at, noise, marked)
        at.items.append(node)
        if tag in VOID or tag not in BLOCK and tag not in RAW and text.endswith("/>", lt, pos):
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(text, pos)
            pos = end.end() if end else n
            continue
        at = node
        depth[tag] = depth.get(tag, 0) + 1
    return root


def prune(root: Node) -> None:
    """Makes noise of marked elements that hold no article or main element and at most half
    of the page's text, or more where an article, a main element or a heading stands apart."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(x for x in node.items if isinstance(x, Node) and not x.noise)
    if not any(x.marked for x in order):
        return
    chars: dict[Node, int] = {}
    holds: set[Node] = set()
    for node in reversed(order):
        chars[node] = sum(len("".join(x.split())) if isinstance(x, str) else chars.get(x, 0) for x in node.items)
        if node.tag in ("article", "main") and chars[node] or any(isinstance(x, Node) and x in holds for x in node.items):
            holds.add(node)
    headed, stack = False, [root]
    while stack and not headed:
        node = stack.pop()
        headed = node.tag in HEADINGS and chars[node] > 0
        stack.extend(x for x in node.items if isinstance(x, Node) and x in chars and not x.marked)
    for node in order:
        if node.marked and node not in holds and (2 * chars[node] <= chars[root] or headed or _outside(node, holds)):
            node.noise = True


def _outside(node: Node, holds: set[Node]) -> bool:
    """Whether a page that has article or main elements keeps them all apart from the node."""
    up = node.parent
    while up is not None:
        if up.tag in ("article", "main"):
            return False
        if up in holds:
            return True
        up = up.parent
    return False


def measure(root: Node) -> list[Node]:
    """Counts and densities, children first; noise counts for nothing. The nodes in page order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(x for x in reversed(node.items) if isinstance(x, Node) and not x.noise)
    for node in reversed(order):
        for x in node.items:
            if isinstance(x, str):
                node.chars += len("".join(x.split()))
            elif not x.noise:
                own = x.tag not in INLINE
                node.chars += x.chars
                node.tags += x.tags + own
                node.link_chars += x.chars if x.tag == "a" else x.link_chars
                node.link_tags += own + x.tags if x.tag == "a" else x.link_tags
    ratio = root.link_chars / max(1, root.chars)
    for node in reversed(order):
        c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, max(1, node.link_tags)
        if c:
            # the base of the logarithm grows with link text, which lowers the density
            base = math.log(c / max(1, c - lc) * lc + ratio * c + math.e)
            node.density = c / t * math.log(max(1.0, c / max(1, lc) * t / lt) + 1) / base
        # words of a line are no part of their own
        node.total = sum(x.density for x in node.items if isinstance(x, Node) and not x.noise and x.tag not in INLINE)
    return order


def parts_of(body: Node) -> tuple[Node, float, list[Node]]:
    """The node of the greatest sum under body, the threshold, and all nodes that are parts:
    of each subtree as dense as the threshold the node of the greatest sum."""
    inside = _below(body)
    # a node that is a text of its own sums to its own density
    worth: dict[Node, tuple[float, Node]] = {}
    for node in reversed(inside):
        best = (node.total or node.density, node) if node.tag not in INLINE else None
        for x in node.items:
            if isinstance(x, Node) and x in worth and (best is None or worth[x][0] > best[0]):
                best = worth[x]
        if best is not None:
            worth[node] = best
    best = worth[body][1]
    least, up = best.density, best
    while up is not body:
        up = up.parent
        least = min(least, up.density)
    parts: list[Node] = []
    stack = [body]
    while stack:
        node = stack.pop()
        top = worth[node][1]
        if node.tag not in INLINE and node.density >= least and 2 * top.link_chars <= top.chars:
            parts.append(top)
        stack.extend(x for x in node.items if isinstance(x, Node) and x in worth and x.density >= least and x is not best)
    # body as a whole says nothing where some of it is dense enough
    return best, least, [x for x in parts if x is not body] or [best]


def around(parts: list[Node], body: Node) -> Node:
    """The least subtree of body that has all parts, and the headings that stand alone beside it."""
    count: dict[Node, int] = {}
    for x in parts:
        while True:
            count[x] = count.get(x, 0) + 1
            if x is body:
                break
            x = x.parent
    node = body
    while True:
        deeper = next((x for x in node.items if isinstance(x, Node) and count.get(x) == len(parts)), None)
        if deeper is None or node in parts:
            break
        node = deeper
    while node is not body:
        beside = [x for x in node.parent.items if x is not node and (x.strip() if isinstance(x, str) else x.chars and not x.noise)]
        if any(isinstance(x, str) or x.tag not in HEADINGS for x in beside):
            break
        node = node.parent
    return node


def blocks_of(node: Node, least: float, wide: bool = False, parts: list[Node] = ()) -> list[str]:
    """Texts of blocks under ``node`` in page order, without noise and without blocks that are
    links for the most part and thinner than the threshold. wide: also without thinner
    containers that have no part."""
    out: list[str] = []
    run: list[str] = []
    holds = set(parts)
    for x in parts:
        while x is not node and x.parent not in holds:
            x = x.parent
            holds.add(x)
    inside = set(parts)

    def flush() -> None:
        text = " ".join("".join(run).split())
        if text:
            out.append(text)
        run.clear()

    stack: list = [(node, node in inside)]
    while stack:
        x, part = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif x.noise:
            if x.tag in BLOCK:
                flush()
        elif x.tag == "br":
            run.append(" ")
        elif x is not node and x.tag in BLOCK and x.density < least and (2 * x.link_chars > x.chars or wide and not part and x not in holds and x.tag not in TEXT_BLOCKS):
            flush()
        else:
            part = part or x in inside
            split = x.tag in BLOCK or x is node
            if split:
                flush()
                stack.append((None, False))
            stack.extend((y, part) for y in reversed(x.items))
    flush()
    return out


def extract_text(page: str | None) -> str:
    """The article's blocks, joined by two line feeds; empty for null, empty or textless pages."""
    if not page:
        return ""
    root = parse(page)
    prune(root)
    order = measure(root)
    if not root.chars:
        return ""
    body = next((x for x in order if x.tag == "body" and x.chars), root)
    # HTML says of its one main or article element that all of it belongs together, and nothing else
    region = _only(body, "main") or _only(body, "article")
    best, least, parts = parts_of(region or body)
    up = region or body
    while up is not body:
        up = up.parent
        least = min(least, up.density)
    whole = region or around(parts, body)
    return "\n\n".join(blocks_of(whole, least, whole is not best and whole is not region, parts))


def _only(body: Node, tag: str) -> Node | None:
    """The outermost element of this tag under body that has text, if there is one alone."""
    found, stack = [], [body]
    while stack and len(found) < 2:
        x = stack.pop()
        if x.tag == tag and x.chars:
            found.append(x)
        else:
            stack.extend(y for y in x.items if isinstance(y, Node) and not y.noise)
    return found[0] if len(found) == 1 else None


def _below(node: Node) -> list[Node]:
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        out.append(x)
        stack.extend(y for y in reversed(x.items) if isinstance(y, Node) and not y.noise)
    return out


def extract(df: DataFrame, page: str = "html", text: str = "text") -> DataFrame:
    """Adds ``text``; narrow, one page at a time, whole pages. A column of that name is replaced."""
    keep = df.drop(text)
    schema = T.StructType([*keep.schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(b.schema.get_field_index(page))
            made = pa.array([extract_text(v.as_py()) for v in col], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, made], names=[f.name for f in schema.fields])

    return keep.mapInArrow(run, schema)
