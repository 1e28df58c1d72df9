"""Main text of HTML pages by minimum-cut labelling of text blocks.

A page becomes a sequence of blocks, the runs of text between block-level tags, each with its chain of open elements. A naive
Bayes classifier on a block's surroundings (elements, class and id names, share of linked text, length) gives log odds of content
against boilerplate from stated densities; these are the capacities to the two terminals. Smoothness edges tie neighbours, the
more the nearer they stand in the element tree, and blocks below one parent; they are log odds too, of two blocks being of one
kind, so that what stands around it can outweigh a block's own signs unless these are strong. The minimum cut, found by augmenting
paths, parts content from boilerplate; where more than CUT_NODES blocks are undecided together, the same minimum is found by
eliminating blocks with at most two ties, of which a page's nested ties always leave one, in linear time. Which part is the main one
is decided by structure alone (main, article, h1, controls of forms), never by how much of the text a part has. Blocks whose own odds exceed all their ties keep their side in any minimum cut and are
taken out of the graph beforehand.

Defined results: a null page gives an empty text and 0 characters; unclosed and stray tags are taken as browsers take the common
ones (a block tag closes a paragraph, an element's end closes what is open inside it); null ids and urls are kept; repeated
rows give their result each; an empty table gives no rows; other columns are left out, whatever they are called; very long pages are
read whole. A text without any sign against itself or its neighbours is content, however short.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict, deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value lists: element names of the HTML standard and the usual names of page parts.
BLOCKS = frozenset(
    "address article aside blockquote body button center caption dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style template noscript iframe object svg math canvas select option textarea button audio video head title".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
CLOSES_P = BLOCKS - frozenset("body head html title option optgroup button td th tr tbody thead tfoot caption".split())
AGAINST_ELEMENTS = frozenset("nav footer aside form menu dialog header fieldset label".split())
FOR_ELEMENTS = frozenset("article main".split())
#: Words that speak against content wherever they stand in a class name or id, and words that do so only alone or among words for parts of a page: "tags", "post-tags" and "search-box", but
#: not "tag-news", "format-standard", "related-work" or "search-methods", whose other words say what a text is about.
_STRONG = re.compile(
    r"ads?|adbox|adsense|advert\w*|sponsor\w*|promos?|promot(?:ed|ions?)|banners?|nav|navs|navbar\w*|navigation|menus?|menubar|submenu|breadcrumbs?|sidebars?|footers?|masthead|topbar|cookies?|cookiebar|consent|gdpr|popups?|modals?|"
    r"overlays?|newsletters?|subscri(?:be|ption)\w*|signup|signin|login|comments?|commentlist|respond|replies|disqus\w*|pagination|pager|toolbar|copyright|disclaimer|widgets?|headers?"
)
_WEAK = re.compile(r"related|recommend(?:ed|ations?)|shar(?:e|ing)|shares|socials?|sides?|asides?|legal|forms?|tags?|tagcloud|reply|search|searchform|searchbox|skip|notices?|alerts?")
_PARTS = re.compile(
    r"box|bar|list|links?|posts?|entry|articles?|stories|items?|area|block|section|panel|content|inner|outer|left|right|top|bottom|middle|main|col|column|row|group|buttons?|btn|icons?|input|field|text|title|heading|container|cloud|"
    r"meta|count|media|more|info|products?|videos?|site|page|global|sub|mini|small|large|primary|secondary|\d+"
)
_FOR = re.compile(r"(?:^|[\s_-])(?:article\w*|content|main|post|entry|story|body[\s_-]?text|maincontent)(?:$|[\s_-])", re.I)
#: Class names that say how a page is laid out, not what a part is.
_LAYOUT = re.compile(r"(?:^|(?<=\s))(?:has|no|with|without)[_-]\S*", re.I)
_WRAPS = re.compile(r"(?:^|[\s_-])layout(?:$|[\s_-])|(?:^|\s)(?:content|main|page|site)[\w-]*[_-]wrap(?:per)?(?:$|\s)", re.I)
#: Elements that are against content whatever they hold.
NEVER_MAIN = frozenset("nav footer aside menu dialog header label".split())
_ROLES_AGAINST = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar note".split())
_ROLES_FOR = frozenset("main article".split())

_HEADER = re.compile(r"headers?")
#: Visible controls, by which a form is one to be filled in.
_CONTROLS = frozenset("select textarea button input".split())
#: The classifier's densities: of content blocks and of boilerplate blocks, the share that stands in a part for content, in one against it, is a paragraph, a
#: heading, all links, or long (LONG characters; shorter ones in proportion).
DENSITIES = {"for": (0.60, 0.08), "against": (0.01, 0.50), "paragraph": (0.60, 0.20), "heading": (0.10, 0.06), "linked": (0.05, 0.45), "long": (0.45, 0.10)}
PRIOR, LONG = math.log(0.55 / 0.45), 120
SIGN = {name: math.log(content / rest) for name, (content, rest) in DENSITIES.items()}
PROSE, HEADINGS = frozenset(("p", "pre", "blockquote", "body", "html", "")), frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Ties, as log odds: of neighbours, divided by half their distance in the element tree; and of blocks that follow each other below one parent.
NEXT_TO, SIBLING = 0.8, 0.2

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/>]|$)", re.I)
_WHITE = re.compile(r"\s+")


class _Node:
    """An open element: its parent, what it says itself, and with what is around it how much it speaks for content. heads: the h1 in it; mains: the main elements in it; controls: whether it is or has a
    visible control of a form."""

    __slots__ = ("name", "parent", "own", "main", "core", "lean", "link", "unseen", "heads", "mains", "controls", "depth", "header", "place", "paragraphs")

    def __init__(self, name: str, parent: _Node | None, own: float, unseen: bool):
        self.name, self.parent, self.own, self.lean, self.unseen = name, parent, own, own, unseen
        self.link = name == "a" or (parent is not None and parent.link)
        self.main, self.core, self.header = name == "main", name in FOR_ELEMENTS, name == "header"
        self.heads = self.mains = self.place = 0
        self.controls = False
        self.depth = 0 if parent is None else parent.depth + 1
        self.paragraphs: list[int] | None = None


def _said(names: str) -> tuple[float, bool]:
    """What a class or id says: against content, for it or nothing; and whether it is against content only as a header."""
    against, header = False, False
    for name in _LAYOUT.sub(" ", names).split():
        if _WRAPS.search(name):
            continue
        words = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", name)]
        strong = [w for w in words if _STRONG.fullmatch(w)]
        if any(not _HEADER.fullmatch(w) for w in strong):
            return SIGN["against"], False
        header = header or bool(strong)
        weak = sum(_WEAK.fullmatch(w) is not None for w in words)
        against = against or (weak > 0 and all(_WEAK.fullmatch(w) or _PARTS.fullmatch(w) for w in words))
    if against or header:
        return SIGN["against"], header and not against
    return (SIGN["for"] if _FOR.search(names) else 0.0), False


def _open(name: str, attributes: str, parent: _Node) -> _Node:
    node = _Node(name, parent, SIGN["against"] if name in AGAINST_ELEMENTS else SIGN["for"] if name in FOR_ELEMENTS else 0.0, parent.unseen or name in UNSEEN)
    if attributes and ("=" in attributes or "hidden" in attributes):
        for key, *values in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), "".join(values)
            if key in ("class", "id") and name not in ("body", "html"):
                if _WRAPS.search(_LAYOUT.sub(" ", value)):
                    continue
                sign, header = _said(value)
                node.own = min(node.own, sign) if sign < 0 else node.own if node.own < 0 else max(node.own, sign)
                node.header = node.header or header
            elif key == "role":
                node.own = SIGN["against"] if value.lower() in _ROLES_AGAINST else SIGN["for"] if value.lower() in _ROLES_FOR else node.own
                node.core, node.main = node.core or value.lower() in _ROLES_FOR, node.main or value.lower() == "main"
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
                node.unseen = True
    return node


def _lean(nodes: list[_Node]) -> None:
    """Sets each node's lean; nodes: parents first. A part against content is so everywhere, unless it holds the page's main element or is a form around the h1 or without any control; a part for
    content inside one against it stays against it, unless it is a main element or an article with the h1, outside of asides and the like. An article's own header says nothing against it."""
    never = {id(nodes[0]): False}
    for node in nodes[1:]:
        never[id(node)] = node.name in NEVER_MAIN or never[id(node.parent)]
    for node in reversed(nodes[1:]):
        node.parent.heads += node.heads + (node.name == "h1" and not node.unseen)
        if not never[id(node)]:
            node.parent.mains += node.mains + node.main
        node.parent.controls = node.parent.controls or node.controls
    for node in nodes[1:]:
        own, above = node.own, node.parent.lean
        wraps = node.name not in NEVER_MAIN and (node.mains or (node.name == "form" and (node.heads or not node.controls)))
        if own < 0 and (wraps or (node.header and above > 0)):
            own = 0.0
        if above < 0 and not never[id(node)] and (node.main or (node.core and node.heads)):
            above = 0.0
        node.lean = min(own, above) if above < 0 or own < 0 else max(own, above)


class Block:
    __slots__ = ("text", "node", "linked", "total", "embedded")

    def __init__(self, text: str, node: _Node, linked: int, total: int):
        self.text, self.node, self.linked, self.total, self.embedded = text, node, linked, total, False


def _embedded(found: list[Block]) -> None:
    """Marks the blocks of lists and tables that stand between two paragraphs of one part: they belong to its text, links or not."""
    for k, b in enumerate(found):
        if b.node.name == "p":
            parent = b.node.parent
            parent.paragraphs = [k, k] if parent.paragraphs is None else [parent.paragraphs[0], k]
    for k, b in enumerate(found):
        node, top = b.node, None
        while node.parent is not None and top is None:
            if node.name in ("ul", "ol", "dl", "table"):
                top = node
            node = node.parent
        if top is not None and (own := top.parent.paragraphs) is not None:
            b.embedded = own[0] < k < own[1]


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    root = node = _Node("", None, 0.0, False)
    nodes = [root]
    out: list[Block] = []
    parts: list[str] = []
    linked = 0
    place = node

    def close() -> None:
        nonlocal parts, linked
        if parts:
            text = _WHITE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append(Block(text, place, linked, sum(map(len, parts))))
            parts, linked = [], 0

    def say(text: str) -> None:
        nonlocal linked, place
        if text and not node.unseen:
            if not parts:
                place = node
                while place.name not in BLOCKS and place.parent is not None:
                    place = place.parent
            parts.append(text)
            if node.link:
                linked += len(text)

    at, skip_to = 0, -1
    for m in _TOKEN.finditer(page):
        if m.start() < skip_to:
            continue
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if m[1] is not None:
            say(m[1])
            continue
        name = m[3] or m[6]
        if not name:
            continue
        name = name.lower()
        if m[2] or m[5]:
            found = node
            while found.parent is not None and found.name != name:
                found = found.parent
            if name in BLOCKS:
                close()
            if found.parent is not None and (name in BLOCKS or not _crosses_block(node, found)):
                node = found.parent
            continue
        if name == "br":
            say(" ")
            continue
        if name in BLOCKS:
            close()
            node = _implied(node, name)
        if name in VOID:
            if name == "input" and not re.search(r"type\s*=\s*[\"']?hidden", m[4] or m[7] or "", re.I):
                node.controls = True
            continue
        node = _open(name, m[4] or m[7] or "", node)
        nodes.append(node)
        node.controls = name in _CONTROLS
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = skip_to = end.end() if end else len(page)
            node = node.parent
    if at < len(page):
        say(page[at:])
    close()
    _lean(nodes)
    _embedded(out)
    return out


def _crosses_block(node: _Node, found: _Node) -> bool:
    while node is not found:
        if node.name in BLOCKS:
            return True
        node = node.parent
    return False


_ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}


def _implied(node: _Node, name: str) -> _Node:
    """Where a block tag opens, after the ends that it implies: of an open paragraph, list item, cell or row."""
    if name in CLOSES_P:
        found = node
        while found.parent is not None and found.name not in ("p", "td", "th", "table", "button", "div", "article", "section", "body"):
            found = found.parent
        if found.name == "p":
            node = found.parent
    if name in _ENDED_BY:
        found = node
        while found.parent is not None and found.name not in _SCOPES[name]:
            if found.name in _ENDED_BY[name]:
                node = found.parent
            found = found.parent
    return node


def costs(block: Block) -> float:
    """The log odds of content by the block's own signs. Links inside a part for content, and length inside one against it, say nothing."""
    share, lean, name = block.linked / max(1, block.total), block.node.lean, block.node.name
    odds = PRIOR + lean + SIGN["paragraph"] * (name in PROSE) + SIGN["heading"] * (name in HEADINGS)
    return odds + SIGN["linked"] * share * (lean <= 0 and not block.embedded) + SIGN["long"] * min(1.0, len(block.text) / LONG) * (lean >= 0) * (share < 0.5)


def _apart(a: _Node, b: _Node) -> int:
    """Steps between two elements in the tree."""
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


def graph(found: list[Block]) -> tuple[list[float], list[dict[int, float]]]:
    """The blocks' own log odds and their ties."""
    n = len(found)
    ties: list[dict[int, float]] = [{} for _ in range(n)]
    last: dict[int, int] = {}
    for k, b in enumerate(found):
        if k:
            ties[k][k - 1] = ties[k - 1][k] = NEXT_TO / max(1.0, _apart(found[k - 1].node, b.node) / 2)
        parent = id(b.node.parent if b.node.parent is not None else b.node)
        j = last.get(parent)
        if j is not None:
            w = ties[k].get(j, 0.0) + SIBLING
            ties[k][j] = ties[j][k] = w
        last[parent] = k
    return [costs(b) for b in found], ties


def labels(found: list[Block]) -> list[bool]:
    """Whether each block is content, by a minimum cut."""
    unary, ties = graph(found)
    n = len(found)
    side: list[bool | None] = [None] * n
    waiting = deque(range(n))
    pull = [sum(t.values()) for t in ties]
    while waiting:  # decided by their own cost, whatever their neighbours are; then these pull on the others
        k = waiting.popleft()
        if side[k] is None and abs(unary[k]) >= pull[k]:
            side[k] = unary[k] > 0
            for j, w in ties[k].items():
                if side[j] is None:
                    unary[j] += w if side[k] else -w
                    pull[j] -= w
                    waiting.append(j)
    rest = [k for k in range(n) if side[k] is None]
    if rest:
        content = _cut(rest, unary, ties) if len(rest) <= CUT_NODES else _eliminated(rest, unary, ties)
        for k in rest:
            side[k] = k in content
    return [bool(x) for x in side]


def _cut(nodes: list[int], unary: list[float], ties: list[dict[int, float]]) -> set[int]:
    """Nodes on the content side of a minimum cut, by shortest augmenting paths."""
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = defaultdict(dict)
    own = set(nodes)
    for k in nodes:
        if unary[k] > 0:
            room[source][k], room[k][source] = unary[k], 0.0
        elif unary[k] < 0:
            room[k][sink], room[sink][k] = -unary[k], 0.0
        for j, w in ties[k].items():
            if j in own:
                room[k][j] = w
    while True:
        back = {source: source}
        queue = deque([source])
        while queue and sink not in back:
            k = queue.popleft()
            for j, r in room[k].items():
                if r > 1e-12 and j not in back:
                    back[j] = k
                    queue.append(j)
        if sink not in back:
            return set(back) - {source}
        path, k = [], sink
        while k != source:
            path.append((back[k], k))
            k = back[k]
        flow = min(room[a][b] for a, b in path)
        for a, b in path:
            room[a][b] -= flow
            room[b][a] = room[b].get(a, 0.0) + flow


#: Undecided blocks up to which the cut is found by augmenting paths, whose time grows with the square of their number.
CUT_NODES = 400


def _eliminated(nodes: list[int], unary: list[float], ties: list[dict[int, float]]) -> set[int]:
    """The same minimum as _cut's, by eliminating nodes of the fewest ties: what a node costs at best is written into its neighbours' costs. A page's ties join neighbours and nested siblings, so that a
    node with at most two ties is always left, and each step is of fixed size."""
    own = set(nodes)
    cost = {k: [max(unary[k], 0.0), max(-unary[k], 0.0)] for k in nodes}  # as boilerplate, as content
    pair: dict[int, dict[int, list[float]]] = {k: {j: [0.0, w, w, 0.0] for j, w in ties[k].items() if j in own} for k in nodes}  # at 2 * own side + other side
    waiting = {0: [], 1: [], 2: []}
    for k in nodes:
        waiting.setdefault(min(len(pair[k]), 3), []).append(k)
    order: list[tuple[int, list[int], list[float]]] = []
    done: set[int] = set()
    while len(done) < len(nodes):
        degree = next(d for d in (0, 1, 2, 3) if waiting.get(d))
        k = waiting[degree].pop()
        if k in done or min(len(pair[k]), 3) != degree:
            continue
        around = list(pair[k])
        done.add(k)
        table, choice = [], []
        for x in range(1 << len(around)):
            side = [x >> i & 1 for i in range(len(around))]
            at = [cost[k][v] + sum(pair[k][j][2 * v + side[i]] for i, j in enumerate(around)) for v in (0, 1)]
            table.append(min(at))
            choice.append(float(at[1] < at[0] - 1e-12))
        order.append((k, around, choice))
        for j in around:
            del pair[j][k]
        if len(around) == 1:
            cost[around[0]][0] += table[0]
            cost[around[0]][1] += table[1]
        elif len(around) == 2:
            a, b = around
            known = pair[a].get(b, [0.0] * 4)
            pair[a][b] = [known[2 * x + y] + table[x + 2 * y] for x in (0, 1) for y in (0, 1)]
            pair[b][a] = [pair[a][b][2 * y + x] for x in (0, 1) for y in (0, 1)]
        elif around:
            raise AssertionError("ties of a page are nested")
        for j in around:
            waiting.setdefault(min(len(pair[j]), 3), []).append(j)
    side: dict[int, int] = {}
    for k, around, choice in reversed(order):
        side[k] = int(choice[sum(side[j] << i for i, j in enumerate(around))])
    return {k for k, v in side.items() if v}


def main_text(page: str | None) -> str:
    """The content blocks of a page, two line feeds between them."""
    found = blocks(page or "")
    return "\n\n".join(b.text for b, keep in zip(found, labels(found), strict=True) if keep)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for each row of pages."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["id", "url", "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    out = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    return out.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
