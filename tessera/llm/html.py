"""Main text of web pages by tag-path ratios.

A page is scanned once into blocks, each with its root-to-leaf tag path. Text outside links and sentence
punctuation are summed a path; both are smoothed over the page's block order and fused to the path's ratio,
the text times the root of one more than the marks. A path whose text is all links has none.

Ratios choose. Paths that reach STRONG times the best ratio are content paths; the content node is the
deepest element that holds MOST of their text, raised to the article or main around it. Below it (and below
articles of the same path) every block stays whose path has a ratio. Around it, as far as parents add no links and
no named part, a path must reach LEAST of the best ratio; elsewhere it must be a content path, or be a heading right
before the content. The result is the blocks that stay, in page order.

Tags and names help where ratios can't tell. A named part (adverts, comments, footers, notices, forms, page headers,
sidebars) counts NAMED of its ratio, and leads only if no other text does; below the content node a named part is
dropped, as a reader's comment or an advert reads like an article. Looser marks (forms, page headers, widgets) over
half of the text name a layout and count for nothing. Menus are told by their links: their names count only
below the content node and on pages that hold nothing else.

Edge cases: null or empty html gives an empty text; unclosed, stray and truncated
tags are read as browsers do, an unquoted < ends a tag; a page whose text all lies in links keeps it; time and memory follow the
length of the page however deeply it nests and whatever its tags look like; nulls in other columns, ties and repeated rows stay;
an empty table gives no row.
"""

from __future__ import annotations

import functools
import html as entities
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.llm.batches import small

#: What stands in a tag behind its name: strings follow an equals sign, other quotes are plain.
_REST = r"(?:[^<>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?|[\"'])*+"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?!(?:svg|math)(?![^\s/>]){_REST}(?<=/)>)(script|style|noscript|template|svg|iframe|object|select|textarea|title|math|canvas)(?![^\s/>]){_REST}>.*?(?:</\1\s*>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/<>]*+)({_REST})>|<[/!?][^<>]*+>|<[a-zA-Z/!?][^<>]*+\Z",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul video audio head button label datalist".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that mark no article text, whatever they hold.
FIRM_TAGS = frozenset("footer aside button fieldset head dialog label datalist audio video".split())
MENU_TAGS = frozenset(["nav", "menu"])
#: Words in class, id or role that always name such parts.
FIRM_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot sponsor sponsored comment comments commentlist disqus reply replies respond "
    "recommended recommendations cookie cookies consent gdpr modal popup overlay newsletter subscribe subscription signup paywall masthead".split()
)
MENU_WORDS = frozenset("menu menus nav navbar navigation navi breadcrumb breadcrumbs topbar toolbar".split())
#: Words that name such parts alone or beside words of layout, but may also name a wrapper.
LOOSE_WORDS = frozenset(
    "banner banners promo promotion notice notices alert header footer foot sidebar sidebars rail widget widgets related share sharing social login search form pager pagination "
    "copyright disclaimer complementary contentinfo skip".split()
)
#: Words of layout that say nothing of their own.
LAYOUT = frozenset(
    "site page global main primary secondary top bottom left right box bar block section container wrapper wrap inner outer area item items list row col column content contents "
    "posts post articles article stories links link buttons button icons media group text title heading panel module region legal info fixed sticky hidden mobile desktop".split()
)
OWN = frozenset("article entry post story content title".split())  # before "header": the article's own
HELD = frozenset("html body main article".split())  # never marked by a name
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARTS = frozenset("p li pre blockquote dd dt tr tbody thead table ul ol dl figure figcaption".split()) | HEADINGS  # parts of a text, never the whole of it
CLOSED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "tbody": frozenset(["thead", "tbody"]), "tfoot": frozenset(["tbody"]),
}
#: Marks at a word's end; those inside numbers and names of hosts are none.
PUNCTUATION = re.compile(r"[.,;:!?…](?=\s|$)|[。、，；：！？]")
STRONG, LEAST, MOST, NAMED, SMOOTH = 0.5, 0.03, 0.75, 0.5, (0.25, 0.5, 0.25)


class _Node:
    """An element: mark is what its tag and names suggest (nothing, firm, menu or loose), named whether it lies in a firm or loose part, weight and foreign sums over its blocks."""

    __slots__ = ("tag", "parent", "path", "mark", "named", "depth", "held", "weight", "foreign", "near", "inside", "barred")

    def __init__(self, tag: str, parent: _Node | None, path: int, mark: str):
        self.tag, self.parent, self.path, self.mark = tag, parent, path, mark
        self.depth = parent.depth + 1 if parent else 0
        self.held = tag in ("article", "main") or bool(parent and parent.held)  # at or below article or main
        self.named, self.weight, self.foreign, self.near, self.inside, self.barred = False, 0.0, 0, False, False, False


@functools.lru_cache(maxsize=20_000)
def named(names: str) -> str:
    """What a class, id or role suggests: firm, menu, loose or nothing."""
    found = ""
    for name in names.split():
        parts = [p.lower() for p in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", name)]
        if not parts or parts[0] in ("has", "with", "no", "without"):
            continue
        words = set(parts)
        if words & FIRM_WORDS:
            return "firm"
        if words & MENU_WORDS:
            found = "menu"
            continue
        if not words & LOOSE_WORDS or words & LOOSE_WORDS == {"header"} and words & OWN:
            continue
        if words <= LOOSE_WORDS | LAYOUT:
            found = found or "loose"
    return found


def _mark(tag: str, attributes: str, parent: _Node) -> str:
    if tag in FIRM_TAGS or tag in MENU_TAGS:
        return "firm" if tag in FIRM_TAGS else "menu"
    names, hidden = [], False
    if attributes and ("=" in attributes or "hidden" in attributes.lower()):
        for key, a, b, c in ATTRIBUTE.findall(attributes):
            key = key.lower()
            if key in ("class", "id", "role"):
                names.append(a or b or c)
            elif key == "hidden" or key == "style" and re.search(r"display\s*:\s*none", a or b or c, re.I):
                hidden = True
    mark = named(" ".join(names)) if names and tag not in HELD else ""
    if not mark and (hidden or tag == "form" or (tag == "header" and not parent.held)):
        return "loose"
    return mark


def blocks(page: str) -> tuple[list[_Node], list[tuple[_Node, str, str]]]:
    """All elements, parents first, and (element, text, text outside links) of every block with text, in page order.

    Text is decoded, its white space collapsed; in headings links count as text.
    """
    paths: dict[tuple[int, str, str], int] = {}
    node = root = _Node("", None, 0, "")
    nodes, found = [root], []
    held: list[str] = []
    plain: list[str] = []
    open_: dict[str, int] = {}  # open elements of a tag
    link: _Node | None = None  # where an open link began

    def add(text: str) -> None:
        if "&" in text:
            text = entities.unescape(text)
        held.append(text)
        if not link or node.tag in HEADINGS:
            plain.append(text)

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            if text:
                found.append((node, text, text if len(plain) == len(held) else " ".join("".join(plain).split())))
            held.clear()
            plain.clear()

    def leave(to: _Node) -> None:
        """Close all elements below one."""
        nonlocal node, link
        while node is not to:
            open_[node.tag] -= 1
            node = node.parent
        if link and node.depth < link.depth:
            link = None

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "a":
            link = None if m[2] else node
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag in ("br", "img", "input"):
                add(" ")
            continue
        if tag in ("td", "th"):
            add(" ")
            continue
        if tag not in BLOCKS:
            continue
        flush()
        if m[2]:
            if open_.get(tag):
                up = node
                while up.tag != tag:
                    up = up.parent
                leave(up.parent)
            continue
        if tag not in ("button", "label"):
            up = node
            while up.parent and (up.tag == "p" or up.tag in HEADINGS):  # a block ends an open paragraph or heading
                up = up.parent
            leave(up)
        if tag in CLOSED_BY and any(open_.get(t) for t in CLOSED_BY[tag]):
            up = node
            while up.parent and up.tag not in ("ul", "ol", "dl", "table", "menu"):
                if up.tag in CLOSED_BY[tag]:
                    leave(up.parent)
                    break
                up = up.parent
        mark = _mark(tag, m[4], node)
        node = _Node(tag, node, paths.setdefault((node.path, tag, mark), len(paths) + 1), mark)
        open_[tag] = open_.get(tag, 0) + 1
        nodes.append(node)
    if at < len(page):
        add(page[at:])
    flush()
    return nodes, found


def _sum_up(nodes: list[_Node], name: str) -> None:
    """Adds an attribute of every element to its parent's."""
    for node in reversed(nodes[1:]):
        setattr(node.parent, name, getattr(node.parent, name) + getattr(node, name))


def _name(nodes: list[_Node], found: list[tuple[_Node, str, str]]) -> None:
    """Which elements lie in named parts; a loose mark on over half of the text outside firm ones names a layout and is taken away."""
    for node in nodes:  # parents first
        node.weight, node.inside = 0.0, node.mark == "firm" or bool(node.parent and node.parent.inside)
        node.barred = node.inside or node.mark == "menu" or bool(node.parent and node.parent.barred)
    for node, _, own in found:
        if not node.inside:
            node.weight += len(own)
    _sum_up(nodes, "weight")
    total = nodes[0].weight
    for node in nodes[1:]:
        if node.mark == "loose" and 2 * node.weight > total:
            node.mark = ""
        node.named = node.parent.named or node.mark in ("firm", "loose")


def ratios(found: list[tuple[_Node, str, str]]) -> dict[int, float]:
    """Fused ratio of every path: smoothed sums of text and punctuation; 0 for paths whose text is all links."""
    sums: dict[int, list[int]] = {}
    for node, _, own in found:
        s = sums.setdefault(node.path, [0, 0, 0])
        s[0] += len(own)
        s[1] += len(PUNCTUATION.findall(own))
        s[2] += 1
    length = _smooth([sums[n.path][0] / sums[n.path][2] for n, _, _ in found])
    marks = _smooth([sums[n.path][1] / sums[n.path][2] for n, _, _ in found])
    smoothed: dict[int, list[float]] = {}
    for (node, _, _), x, y in zip(found, length, marks, strict=True):
        v = smoothed.setdefault(node.path, [0.0, 0.0])
        v[0] += x
        v[1] += y
    return {p: x * math.sqrt(1 + y) if sums[p][0] else 0.0 for p, (x, y) in smoothed.items()}


def content_node(nodes: list[_Node], found: list[tuple[_Node, str, str]], values: list[float]) -> _Node:
    """The element that holds most of the text of the paths with the best values."""
    least = STRONG * max(values)
    for node in nodes:
        node.weight = 0.0
    for (node, text, _), v in zip(found, values, strict=True):
        node.weight += len(text) if v >= least else 0
    _sum_up(nodes, "weight")
    content = max((n for n in nodes if n.weight >= MOST * nodes[0].weight), key=lambda n: n.depth)
    while content.parent and content.tag in PARTS:
        content = content.parent
    up: _Node | None = content
    while up and up.held:  # the outermost article or main around it
        content = up if up.tag in ("article", "main") else content
        up = up.parent
    return content


def surroundings(nodes: list[_Node], found: list[tuple[_Node, str, str]], fused: dict[int, float], content: _Node) -> _Node:
    """The outermost element around content that adds no block of links and no named part."""
    for node in nodes:
        node.foreign = 0
    for node, _, _ in found:
        node.foreign += node.named or not fused[node.path]
    _sum_up(nodes, "foreign")
    while content.parent and content.parent.tag not in ("body", "html", "") and content.parent.foreign == content.foreign:
        content = content.parent
    return content


def chosen(nodes: list[_Node], found: list[tuple[_Node, str, str]], fused: dict[int, float]) -> list[bool]:
    """Which blocks stay."""
    values = [fused[n.path] * (NAMED if n.named else 1.0) for n, _, _ in found]
    content = content_node(nodes, found, values)
    free = [0.0 if n.named else fused[n.path] for n, _, _ in found]
    if content.named and any(free):
        content, values = content_node(nodes, found, free), free
    around, best = surroundings(nodes, found, fused, content), max(values)
    for node in nodes:  # parents first
        above = node.parent
        node.near = node is around or bool(above and above.near)
        node.inside = node is content or (content.tag == "article" and node.path == content.path) or bool(above and above.inside)
        node.barred = bool(above and above.inside and node.inside and (above.barred or node.mark) and node.path != content.path)
    on = []
    for node, _, _ in found:
        ratio = fused[node.path]
        on.append(ratio > 0 and (not node.barred if node.inside else not node.named and ratio >= (LEAST if node.near else STRONG) * best))
    if True not in on:
        return on
    first = on.index(True)
    while first and found[first - 1][0].tag in HEADINGS and not found[first - 1][0].named and fused[found[first - 1][0].path]:
        first -= 1
        on[first] = True
    return on


def extract(page: str | None) -> str:
    """The main text of one page."""
    nodes, found = blocks(page or "")
    if not any(own for _, _, own in found):  # all text lies in links
        found = [(n, text, text) for n, text, _ in found]
    if not found:
        return ""
    _name(nodes, found)
    if all(n.barred for n, _, _ in found):  # nothing but menus, footers and the like
        return ""
    on = chosen(nodes, found, ratios(found))
    return "\n".join(text for (_, text, _), k in zip(found, on, strict=True) if k)


def _smooth(values: list[float]) -> list[float]:
    """A weighted mean over neighbouring blocks, ends repeated."""
    n = len(values)
    return [SMOOTH[0] * values[max(0, i - 1)] + SMOOTH[1] * values[i] + SMOOTH[2] * values[min(n - 1, i + 1)] for i in range(n)]


def extract_pages(pages: DataFrame, column: str = "html", out: str = "text") -> DataFrame:
    """pages without the html column, with the main text; an input column named out gives way."""
    fields = [f for f in pages.schema.fields if f.name not in (column, out)]
    names = [f.name for f in fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            text = pa.array([extract(h) for h in b.column(column).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), text], names=[*names, out])

    return pages.mapInArrow(run, T.StructType([*fields, T.StructField(out, T.StringType())]))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text and its length of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_pages(pages).selectExpr("page_id", "url", "text", "CAST(length(text) AS LONG) AS n_chars")
