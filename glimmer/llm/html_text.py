"""Main text of web pages by composite text density over the DOM.

Every node's density is its characters per tag, adjusted by the share of link text; a node's
density sum adds its children's densities. The node with the largest density sum is the densest
subtree. What tags and classes mark as boilerplate only counts less in that choice, and nothing
that holds the densest subtree is ever left out for its name. The body's threshold is the least
density on the path from the body to the densest subtree; it decides which ancestors add text of the
article's kind, and the article's root is the widest of those. Inside the root, text stays: only
marked nodes go, and what is mostly links before the first or after the last text that is not.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from .shared import slices, table

# How HTML elements behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg textarea title xmp noframes annotation annotation-xml".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr object "
    "math mfrac mi mn mo mover mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
SKIPPED = frozenset("nav footer aside form button select menu dialog header head datalist".split())
# An element's end is implied by the start of these, up to the given ancestors.
CLOSED_BY = {
    "p": frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "tbody", "thead", "tfoot"}), "td": frozenset({"td", "th", "tr", "tbody", "thead", "tfoot"}), "th": frozenset({"td", "th", "tr", "tbody", "thead", "tfoot"}),
    "option": frozenset({"option", "optgroup"}),
}
#: The elements whose end a tag implies.
ENDS = {tag: [e for e, by in CLOSED_BY.items() if tag in by] for tag in {t for by in CLOSED_BY.values() for t in by}}
BARRIERS = frozenset("table td th ul ol dl article section div main body html aside nav footer header form blockquote".split())
BARRIER_LIST = sorted(BARRIERS)
#: Elements that group blocks; those of mostly links go at an article's ends.
CONTAINERS, LISTS = frozenset("div section center fieldset".split()), frozenset("ul ol dl table".split())
#: What a node's own tag and attributes say: text, boilerplate, never shown, or perhaps boilerplate.
PLAIN, MARKED, HIDDEN, HINTED = 0, 1, 2, 3
# Words in class or id that name boilerplate, and words that may stand beside them
# in one hyphenated name; a name with any other word in it marks nothing.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement adbox adsense banner promo promotion sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs sidebar side footer header masthead "
    "cookie cookies consent gdpr notice popup modal newsletter subscribe subscription signup login share sharing social related recommended comment comments reply replies disqus respond "
    "pagination pager skip copyright legal".split()
)
#: Of these, the ones that name parts of an article as well: dense prose so named stays between other text.
WEAK = frozenset("legal copyright side header related comment reply".split())
#: Characters of a sparse container's plain text from which it counts as text of its own.
PROSE = 80
BESIDE = frozenset(
    "article bar block blog body bottom box button buttons col column container content entry fixed form global google group icons inner item items left link links list main message module "
    "outer overlay page panel part post posts primary reader right rail row secondary section site slot sticky story sub text thread top unit user widget widgets wrap wrapper".split()
)
#: Names of an article's own head are no boilerplate.
OWN = frozenset("article blog entry post story".split())
#: What a marked node's density, and the density sums below it, count for.
PENALTY = 0.02
HEADINGS, HEADED = frozenset({"h1", "h2"}), frozenset({"h1", "h2", "h3", "h4"})
#: On the stack of open blocks: the end of what stays only between other text.
END_EDGE = object()
# a quote opens a value right after "=" only, and one that never closes opens nothing
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/>\x00]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+)|=)*+)(>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""", re.S)
SPACE = re.compile(r"\s+")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    __slots__ = ("tag", "names", "depth", "children", "parent", "mark", "under", "skip", "edge", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, mark: int, names: str = "") -> None:
        self.tag, self.parent, self.mark, self.names = tag, parent, mark, names
        self.depth = parent.depth + 1 if parent else 0
        self.children: list = []  # nodes and texts
        self.under = self.skip = self.edge = False
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def attributes(source: str) -> dict[str, str]:
    return {name.lower(): html.unescape(a or b or c) for name, a, b, c in ATTRIBUTE.findall(source)}


def mark_of(tag: str, have: dict[str, str]) -> int:
    """What a tag and its attributes say: MARKED if it holds no article text, HINTED if only a weak name
    says so, HIDDEN if it is not shown."""
    if tag in RAW or tag in {"head", "datalist"}:
        return HIDDEN
    by_tag = MARKED if tag in SKIPPED else PLAIN
    if not have:
        return by_tag
    if "hidden" in have or have.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", have.get("style", ""), re.I):
        return HIDDEN
    if have.get("role", "").lower() in {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar"}:
        return MARKED
    if tag not in {"html", "body", "article", "main"}:
        named = [one for k in ("class", "id") for one in have.get(k, "").split() if names_boilerplate(one)]
        if named:
            return HINTED if by_tag == PLAIN and all(words_of(one) & BOILERPLATE <= WEAK for one in named) else MARKED
    return by_tag


def words_of(name: str) -> set[str]:
    """The words of a class or id, split at hyphens, digits and capitals."""
    return {w.lower() for w in NAME.findall(name) if not w.isdigit()}


def names_boilerplate(name: str) -> bool:
    """Whether one class or id says nothing but boilerplate."""
    words = words_of(name)
    named = words & BOILERPLATE
    return bool(named) and words <= BOILERPLATE | BESIDE and not (named == {"header"} and words & OWN)


class Open:
    """The elements that are open, by tag, so that no token walks up the tree: what it closes is looked
    up, and every element is closed once."""

    def __init__(self) -> None:
        self.here = self.root = Node("html", None, PLAIN)
        self.by_tag: dict[str, list[Node]] = {}
        self.blocks: list[Node] = []

    def push(self, node: Node) -> None:
        self.here = node
        self.by_tag.setdefault(node.tag, []).append(node)
        if node.tag not in INLINE:
            self.blocks.append(node)

    def deepest(self, tags: Iterable[str]) -> Node | None:
        found = [self.by_tag[t][-1] for t in tags if self.by_tag.get(t)]
        return max(found, key=lambda n: n.depth, default=None)

    def close(self, node: Node) -> None:
        """Close ``node`` and all in it."""
        while self.here is not node.parent:
            gone = self.here
            self.by_tag[gone.tag].pop()
            if gone.tag not in INLINE:
                self.blocks.pop()
            self.here = gone.parent

    def end_tag(self, tag: str) -> None:
        """Close the innermost element of the tag; the end of an inline element does not leave its block."""
        node = self.deepest((tag,))
        if node and not (tag in INLINE and self.blocks and self.blocks[-1].depth > node.depth):
            self.close(node)

    def start_tag(self, tag: str) -> None:
        """Close the innermost element whose end the tag implies, unless a barrier is nearer."""
        closes = ENDS.get(tag)
        node = self.deepest(closes) if closes else None
        if node:
            barrier = self.deepest(BARRIER_LIST)
            if barrier is None or barrier.depth <= node.depth or barrier.tag == tag and (self.deepest(t for t in BARRIER_LIST if t != tag) or self.root).depth <= node.depth:
                self.close(node)


def parse(source: str) -> Node:
    """A tree that follows the elements' implied ends; stray end tags are dropped."""
    tree = Open()
    at = 0
    for start, end, closing, tag, rest in iter_tokens(source):
        if start > at:
            tree.here.children.append(source[at:start])
        at = end
        if tag is None:
            continue
        if closing:
            tree.end_tag(tag)
            continue
        if tag in {"html", "body"} and tree.here is tree.root:
            continue
        tree.start_tag(tag)
        have = attributes(rest) if rest and ("=" in rest or "hidden" in rest) else {}
        new = Node(tag, tree.here, mark_of(tag, have), have.get("class", ""))
        tree.here.children.append(new)
        if tag not in RAW and tag not in VOID and not rest.rstrip().endswith("/"):
            tree.push(new)
    if at < len(source):
        tree.here.children.append(source[at:])
    return tree.root


def iter_tokens(source: str):
    """(start, end, closing, tag, attributes) of every markup token; an element with raw contents is one token."""
    at, low = 0, None
    while found := TOKEN.search(source, at):
        tag, at = found[2].lower() if found[2] else None, found.end()
        if tag in RAW and not found[1]:
            low = low or source.lower()
            stop = low.find(f"</{tag}", at)
            at = len(source) if stop < 0 else (source.find(">", stop) + 1 or len(source))
        yield found.start(), at, bool(found[1]), tag, found[3] or ""


def plain(node: Node) -> int:
    """Characters outside links."""
    return node.chars - node.link_chars


def count(order: list[Node]) -> None:
    """Characters and tags from the leaves up, without the texts of skipped nodes."""
    for node in reversed(order):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for c in node.children:
            if isinstance(c, Node):
                node.tags += c.tags + 1
                node.chars += c.chars
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags + (c.tag == "a")
            elif not node.skip:
                node.chars += len(c) - c.count(" ") if c.strip() else 0
        if node.tag == "a":
            node.link_chars = node.chars


def densities(order: list[Node]) -> None:
    """Composite density of every node: characters per tag, times a logarithm of how little of the
    text and of the tags are links, to a base that grows with the links of node and body. One is
    added within the base's logarithm, so that a page without links stays finite."""
    root = order[0]
    body_links = max(1, root.link_chars) / max(1, root.chars)
    for node in order:
        node.density = 0.0
        if node.chars and not node.skip:
            tags, links = max(1, node.tags), max(1, node.link_chars)
            base = node.chars / max(1, plain(node)) * node.link_chars + body_links * node.chars + math.e
            few = node.chars / links * tags / max(1, node.link_tags)
            node.density = node.chars / tags * math.log(max(1.0001, few)) / math.log(math.log(base) + 1.0001)


def measure(root: Node) -> list[Node]:
    """Counts, densities and density sums, without recursion; all nodes in page order. A marked
    node's density counts PENALTY in its parent's sum, and so do the sums of nodes in marked ones."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    for node in order:
        above = node.parent
        node.skip = node.mark == HIDDEN or above is not None and above.skip
        node.under = node.mark in (MARKED, HINTED) or above is not None and above.under
    count(order)
    densities(order)
    for node in order:
        held = sum(c.density * (PENALTY if c.mark in (MARKED, HINTED) else 1) for c in node.children if isinstance(c, Node))
        node.total = (held or node.density) * (PENALTY if node.under else 1)
    return order


def article_root(root: Node) -> Node:
    """The widest ancestor of the densest subtree that belongs to it. Sets ``skip`` for marked nodes
    beside the densest subtree, and ``edge`` for what stays only between other text: containers of
    mostly links, and dense prose with a weak name."""
    whole = measure(root)
    order = [n for n in whole if not n.skip and n.chars]
    if not order:
        return root
    best = max(order, key=lambda n: n.total)
    path, node = [], best
    while node is not None:
        path.append(node)
        node = node.parent
    holders = set(path)
    threshold = min((n.density for n in path if n.density > 0), default=0.0)
    for n in whole:
        if n.parent is not None and n.parent.skip:
            n.skip = True
        elif n not in holders and n.mark in (MARKED, HINTED):
            n.edge = n.mark == HINTED and 2 * n.link_chars <= n.chars and n.density >= threshold and plain(n) >= PROSE
            n.skip |= not n.edge
    count(whole)
    densities(whole)
    threshold = min((n.density for n in path if n.density > 0), default=0.0)
    for n in order:
        n.edge |= n not in holders and n.tag in CONTAINERS | LISTS and 2 * n.link_chars > n.chars
    # plain text of the path's nodes without sparse containers, each of which is taken off once, from below
    off: dict[Node, int] = {}
    for n in reversed(whole):
        off[n] = sum(off[c] for c in n.children if isinstance(c, Node))
        sparse = n.density < threshold and n.tag in CONTAINERS and plain(n) < PROSE
        if n not in holders and (n.edge or sparse):
            off[n] = plain(n)
    kept = {n: plain(n) - off[n] for n in path}
    for below, n in zip(path, path[1:]):  # noqa: B905
        headed = n is not root and n.tag != "body" and any(isinstance(c, Node) and c.tag in HEADINGS and c.chars for c in n.children)
        if n.tag in {"article", "main"} or headed or kept[n] > 1.2 * kept[best] and n.tag not in {"p", "span"} or any(alike(c, below, threshold) for c in n.children):
            best = n
    return best


def alike(one: Node | str, other: Node, threshold: float) -> bool:
    """Whether a container beside ``other`` is a part of the same article: of its tag and class, more
    text than links, and with a heading or prose of half the threshold's density."""
    if isinstance(one, str) or one is other or one.skip or one.edge or one.tag not in CONTAINERS or (one.tag, one.names) != (other.tag, other.names):
        return False
    headed = any(isinstance(c, Node) and c.tag in HEADED and c.chars for c in one.children)
    return headed and plain(one) > 0 or plain(one) >= PROSE and one.density >= threshold / 2


def blocks(node: Node) -> list[str]:
    """Texts of the blocks below a node in page order: references decoded, white space made one space,
    trimmed; without the edges before the first and after the last other block."""
    out: list[tuple[str, bool]] = []
    run: list[str] = []
    within = 0  # open edges

    def flush() -> None:
        if run:
            line = SPACE.sub(" ", html.unescape("".join(run))).strip()
            if line:
                out.append((line, within > 0))
            run.clear()

    stack: list = [node]
    while stack:
        one = stack.pop()
        if one is None or one is END_EDGE:
            flush()
            within -= one is END_EDGE
        elif isinstance(one, str):
            run.append(one)
        elif one.skip:
            if one.tag not in INLINE and one.tag not in RAW:
                flush()
        elif one.tag == "br":
            run.append(" ")
        elif one.tag in INLINE:
            stack.extend(reversed(one.children))
        else:
            flush()
            opens = one.edge and one is not node
            within += opens
            stack.append(END_EDGE if opens else None)
            stack.extend(reversed(one.children))
    flush()
    text = [k for k, (_, edge) in enumerate(out) if not edge]
    return [line for line, _ in out[text[0] : text[-1] + 1]] if text else [line for line, _ in out]


def main_text(source: str | None) -> str:
    """Main text of one page; empty for null or empty input and for pages without article text."""
    if not source:
        return ""
    return "\n".join(blocks(article_root(parse(source))))


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), source: str = "html") -> DataFrame:
    """The columns ``keep`` of every page with its main text and the text's code points.

    Null, empty and broken pages keep their row; so do repeated ones. Deep nesting costs no
    recursion, and time grows with a page's length, however many tags stay open; pages of any length
    are read whole. Of subtrees with equal density sums the first in page order is taken. Other columns
    are not read. An empty table gives an empty result.
    """
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, source):
                found = [main_text(x) for x in batch.column(source).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in keep), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], [*keep, "text", "n_chars"]
                )

    return pages.select(*keep, source).mapInArrow(run, f"{kinds}, text string, n_chars bigint")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op6_html_extraction": op6_html_extraction}
ORACLES: dict = {}
