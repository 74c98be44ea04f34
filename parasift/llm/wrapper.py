"""Main-text extraction by wrapper induction.

A layout is the path of elements and classes to the part of a page that holds most
of its text.  Each layout that at least two pages of a host have (else the host's
most frequent one) gets a wrapper.  Its base is its page with the most elements.
Neighbouring paragraphs, items or cells of one kind are one list slot of any length.
Every page of the host is aligned with the base of its layout (of another layout:
with the base that agrees most) by simple tree matching, by element kinds and, as
far as they agree, classes (ids and classes of a single page do not matter); equal
subtrees at both ends of two child lists are paired first, and of two lists with
over ``CELLS`` pairs of children the n-th of each shape are paired in order.  The
texts of each node are counted over all these pages, pages of equal text once: a
node with one text in ``CONSTANT`` of them is template, the others are slots that
vary.  The content slot is found from the root downwards: go to the child that
holds most of the varying text and stop where no child dominates or at a text
block; an enclosing ``article`` is taken whole.  At the edges of a slot that is no
article, an element beside the text blocks with less than ``EDGE`` of the varying
text is a slot of its own (an advert, a date line).  The wrapper is the base without
the inside of the content slot.

Every page is then aligned with its wrapper in the same way, and the text blocks in
its content slot are its text; where nothing matches, the slot is found in the page
alone.  Constant paragraphs and headings inside the slot are text that pages share
and stay; other constant elements there (buttons, link bars) are template and go.

Markup that names navigation, advertising, forms, comments and the like is left out
on top of that.  A class counts only if all of its words do (``related-posts``, not
``related-work``), never on inline elements nor on what holds the article; a form
around the whole page is no form.

Edge cases: null or empty html has the empty text; a null url is a host of its
own; a host with one page is its own reference; repeated pages give repeated
rows and teach nothing about what is constant; unclosed and misnested elements
and truncated tags are tolerated; columns other than the html pass through; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html as _html
import json
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, sized_side, text_or_empty

CONSTANT = 0.9
DOMINANT, EDGE = 0.6, 0.2
CELLS = 10_000
MAX_DEPTH = 150  # elements nested deeper become siblings at this depth; their text stays

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+|[^>]*)>"""
    r"|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^<>]*\Z",
    re.S,
)
_NAMES = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")

# HTML element kinds.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe textarea title select svg object annotation annotation-xml".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var "
    "math semantics mrow mi mn mo ms mtext mspace mfrac msqrt mroot msub msup msubsup munder mover munderover mfenced mstyle mpadded "
    "mphantom menclose mtable mtr mtd".split()
)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
TEXT_BLOCKS = set("p h1 h2 h3 h4 h5 h6 li dd dt td th blockquote pre figcaption caption".split())
# An opening tag ends an open element of the same group.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
        "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = set(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav "
    "ol p pre section table ul li dd dt".split()
)
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
          "p": {"table", "td", "th", "li", "div", "section", "article", "body"}, "option": {"select"}}
ENDS_WITHIN = {tag: SCOPES[tag] - ENDS[tag] for tag in ENDS}
P_WITHIN = SCOPES["p"] - {"div"} | {"article", "section"}
# Elements and names that mark what is not the article.
BOILERPLATE_TAGS = RAW | set("head nav footer aside form button input menu dialog".split())
BOILERPLATE_NAMES = set(
    "ad ads advert adverts advertisement advertising adbox banner breadcrumb breadcrumbs comment comments commentlist "
    "complementary contentinfo cookie cookies consent disclaimer disqus discussion footer form gdpr header login "
    "masthead menu modal nav navbar navigation navigator newsletter notice notices notification overlay pagination "
    "pager popup promo promoted promotion related reply replies respond search share sharing sidebar sidebars signup "
    "skip social sponsor sponsored subscribe subscription tags toc toolbar topbar widget widgets alert alerts".split()
)
# Words that say nothing about the kind of an element.
NEUTRAL_NAMES = set(
    "area articles bar block bottom box button buttons center column container content footer global group header icons inner item "
    "items left link links list main outer page panel post posts primary right row secondary section site text title top "
    "wrap wrapper".split()
)
PAGE_HOLDERS = {"form", "header", "aside", "dialog"}


_NONE: frozenset[str] = frozenset()


class Text:
    """A text node: it has the tag ""."""

    __slots__ = ("text",)
    tag = ""

    def __init__(self, text: str):
        self.text = text


class Node:
    __slots__ = ("blocks", "children", "classes", "mark", "names", "nodes", "off", "shape", "size", "tag", "text")

    def __init__(self, tag: str, names: str = "", classes: str = ""):
        self.tag, self.names, self.mark, self.off = tag, names, "", False
        self.classes = frozenset(classes.split()) if classes else _NONE
        self.children: list[Node | Text] = []
        self.blocks: list[Node] = []  # the elements just below it; inline ones are looked through
        self.text = ""  # of its inline inside, squeezed
        self.size = 0  # code points of its own text
        self.nodes: list[Node] | tuple[()] = ()
        self.shape = 0


@lru_cache(maxsize=100_000)
def _named(names: str) -> bool:
    """A class, id or role all of whose words name what is not the article."""
    for token in names.split():
        words = [w.lower() for w in _WORD.findall(token)]
        named = [w in BOILERPLATE_NAMES for w in words]
        if any(named) and all(n or w in NEUTRAL_NAMES for n, w in zip(named, words)):
            return True
    return False


def _visit(node: Node, off: list[tuple[Node, int, bool]]) -> tuple[int, bool, str, bool]:
    """Text kept inside, and whether an article is inside, the highest heading, whether a text block."""
    tag, held, article, top, block = node.tag, node.size, False, "h9", False
    for c in node.blocks:
        n, x, y, z = _visit(c, off)
        held, article, top, block = held + n, article or x, min(top, y), block or z
    heading = top == "h1"
    if tag in BOILERPLATE_TAGS:  # an article's own header with its title is content
        node.off = not (tag in PAGE_HOLDERS and article or tag == "form" and heading or tag == "header" and top <= "h2")
    elif node.names and tag not in ("html", "body", "article", "main") and not (article or heading):
        node.off = _named(node.names)
    if node.off:
        off.append((node, held, block))
        held = 0
    top = min(top, tag) if tag in HEADINGS else top
    return held, article or tag in ("article", "main"), top, block or tag in TEXT_BLOCKS and held > 0


def _settle(root: Node) -> Node:
    """Sets ``off`` on the elements that markup names as something else than the article."""
    off: list[tuple[Node, int, bool]] = []
    kept, article, _, _ = _visit(root, off)
    if not article:  # a form around the whole page, or all of the page in an element of such a name
        for node, held, block in off:
            if block and held > kept and (node.tag == "form" or not kept and node.tag not in BOILERPLATE_TAGS and any(
                    n.tag in HEADINGS for n in _elements(node))):
                node.off = False
    return root


def parse(page: str | None) -> Node:
    """DOM tree of a page: elements and text nodes, character references
    decoded.  Comments, declarations and the inside of raw elements go."""
    root = Node("#root")
    stack, at, page = [root], 0, page or ""
    held: defaultdict[str, int] = defaultdict(int)  # open elements by tag
    search = _TOKEN.search

    def add(node: Node | Text) -> None:
        stack[min(len(stack), MAX_DEPTH) - 1].children.append(node)

    def close(tags: set[str], scope: set[str], reach: int) -> None:
        """Ends the innermost of the ``reach`` innermost elements that has one of the tags."""
        for k in range(len(stack) - 1, max(0, len(stack) - 1 - reach), -1):
            if stack[k].tag in tags:
                for n in stack[k:]:
                    held[n.tag] -= 1
                del stack[k:]
                return
            if stack[k].tag in scope:
                return

    while True:
        found = search(page, at)
        start = found.start() if found else len(page)
        if start > at:
            raw = page[at:start]
            add(Text(_html.unescape(raw) if "&" in raw else raw))
        if not found:
            _measure(root)
            return _settle(root)
        at = found.end()
        slash, tag, inside = found.groups()
        if not tag:
            continue
        tag = tag.lower()
        if slash:
            if stack[-1].tag == tag:
                stack.pop()
                held[tag] -= 1
            elif held[tag]:
                close({tag}, {"#root"}, len(stack))
            continue
        if tag in ENDS_P and tag != "p" and held["p"]:
            close(ENDS["p"], P_WITHIN, MAX_DEPTH)
        if tag in ENDS:
            for t in ENDS[tag]:
                if held[t]:
                    close(ENDS[tag], ENDS_WITHIN[tag], MAX_DEPTH)
                    break
        if inside:
            named = [(k.lower(), a or b or c) for k, a, b, c in _NAMES.findall(inside)]
            node = Node(tag, " ".join([v for _, v in named]), " ".join([v for k, v in named if k != "id"]))
            alone = inside.endswith("/")
        else:
            node, alone = Node(tag), False
        add(node)
        if tag in RAW and not alone:
            end = _raw_end(tag).search(page, at)
            if end or tag in ("script", "style"):
                at = end.end() if end else len(page)
                continue
        if tag not in VOID and not alone:
            stack.append(node)
            held[tag] += 1


@cache
def _raw_end(tag: str) -> re.Pattern:
    """End of a raw element."""
    return re.compile(rf"</{re.escape(tag)}\s*>", re.I)


def _gather(node: Node, parts: list[str], blocks: list[Node]) -> None:
    for c in node.children:
        if not c.tag:
            parts.append(c.text)
        elif c.tag == "br":
            parts.append(" ")
        elif c.tag in INLINE:
            _gather(c, parts, blocks)
        elif c.tag not in VOID:
            blocks.append(c)


def _measure(node: Node) -> None:
    """Sets the text, its size and the blocks of all elements."""
    parts: list[str] = []
    _gather(node, parts, node.blocks)
    if parts:
        node.text = squeeze("".join(parts))
        node.size = len(node.text)
    for c in node.blocks:
        _measure(c)


def condense(node: Node) -> Node:
    """The elements that ``match`` looks at: no inline ones, and neighbouring text
    blocks of one kind without elements of their own are one node."""
    out = Node(node.tag, node.names)
    out.classes, out.nodes, out.off = node.classes, [node], node.off
    for c in node.blocks:
        new, last = condense(c), out.children[-1] if out.children else None
        if (last is not None and c.tag in TEXT_BLOCKS and last.tag == c.tag and not new.children and not last.children
                and last.off == new.off and (last.classes & new.classes or not (last.classes or new.classes))):
            last.nodes += new.nodes
        else:
            out.children.append(new)
    out.blocks = out.children
    return _shaped(out)


def _shaped(node: Node) -> Node:
    node.shape = hash((node.tag, *[c.shape for c in node.children]))
    return node


def match(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Simple tree matching of two condensed trees: the heaviest set of node pairs
    of one tag that keeps order and ancestry, by dynamic programming over the
    children of paired nodes.  A pair weighs 1, and 1 more if a class is shared
    or neither has one."""
    return _weigh(a, b)[1] if a.tag == b.tag else []


def _weight(x: Node, y: Node) -> int:
    return 2 if x.classes & y.classes or not (x.classes or y.classes) else 1


def _alike(x: Node, y: Node) -> bool:
    return x.tag == y.tag and x.shape == y.shape and _weight(x, y) == 2


def _weigh(x: Node, y: Node) -> tuple[int, list]:
    xs, ys = x.children, y.children
    total, pairs = _weight(x, y), [(x, y)]
    start, end = 0, 0
    least = min(len(xs), len(ys))
    while start < least and _alike(xs[start], ys[start]):
        start += 1
    while end < least - start and _alike(xs[-1 - end], ys[-1 - end]):
        end += 1
    chosen = [*zip(xs[:start], ys[:start]), *(zip(xs[-end:], ys[-end:]) if end else ())]
    xs, ys = xs[start : len(xs) - end], ys[start : len(ys) - end]
    kept: dict[tuple[int, int], tuple[int, list]] = {}
    if len(xs) * len(ys) > CELLS:
        chosen += _in_order(xs, ys)
    elif xs and ys:
        best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        for i, p in enumerate(xs, 1):
            for j, q in enumerate(ys, 1):
                w = 0
                if p.tag == q.tag:
                    kept[i, j] = _weigh(p, q)
                    w = kept[i, j][0]
                best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + w)
        i, j = len(xs), len(ys)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                total, pairs = total + kept[i, j][0], pairs + kept[i, j][1]
                i, j = i - 1, j - 1
    for p, q in chosen:
        w, inside = _weigh(p, q)
        total += w
        pairs += inside
    return total, pairs


def _in_order(xs: list[Node], ys: list[Node]) -> list[tuple[Node, Node]]:
    """The n-th child of a shape with the n-th of that shape, as many as keep the order."""
    places, seen = defaultdict(list), Counter()
    for j, y in enumerate(ys):
        places[y.tag, y.shape].append(j)
    found = []
    for i, x in enumerate(xs):
        key = x.tag, x.shape
        if seen[key] < len(places.get(key, ())):
            found.append((i, places[key][seen[key]]))
            seen[key] += 1
    tails, tops, before = [], [], [-1] * len(found)  # longest increasing subsequence
    for k, (_, j) in enumerate(found):
        at = bisect_left(tails, j)
        tails[at:at + 1], tops[at:at + 1] = [j], [k]
        before[k] = tops[at - 1] if at else -1
    out, k = [], tops[-1] if tops else -1
    while k >= 0:
        out.append((xs[found[k][0]], ys[found[k][1]]))
        k = before[k]
    return out


def squeeze(text: str) -> str:
    return " ".join(text.split())


def content_slot(root: Node, weight: dict[int, float] | None = None) -> Node:
    """The node that holds the varying text; ``weight`` by node id is its own
    varying text (by default all of its text)."""
    return _slot_path(root, _totals(root, weight))[-1]


def _totals(root: Node, weight: dict[int, float] | None = None) -> dict[int, float]:
    """Varying text by node id, with all below it; elements named otherwise have none."""
    sums: dict[int, float] = {}
    _total(root, weight, sums)
    return sums


def _total(node: Node, weight: dict[int, float] | None, sums: dict[int, float]) -> float:
    if node.off:
        return 0.0
    held = weight.get(id(node), 0.0) if weight is not None else float(node.size)
    sums[id(node)] = held = held + sum([_total(c, weight, sums) for c in node.blocks])
    return held


def _slot_path(root: Node, sums: dict[int, float]) -> list[Node]:
    path = [root]
    while True:
        node = path[-1]
        if node.tag == "article":
            return path
        children = [c for c in node.blocks if sums.get(id(c), 0.0) > 0 and c.tag not in TEXT_BLOCKS]
        best = max(children, key=lambda c: sums[id(c)], default=None)
        if best is None or sums[id(best)] < DOMINANT * sums[id(node)]:
            break
        path.append(best)
    articles = [n for n in _elements(path[-1]) if n.tag == "article" and id(n) in sums]
    return path + _way(path[-1], articles[0]) if len(articles) == 1 else path


def _way(node: Node, below: Node) -> list[Node]:
    """Nodes from under ``node`` down to ``below``."""
    for c in node.blocks:
        if c is below:
            return [c]
        if rest := _way(c, below):
            return [c, *rest]
    return []


def _edges(slot: Node, sums: dict[int, float]) -> list[Node]:
    """Small elements before the first and after the last text block of a slot that is no article."""
    if slot.tag in ("article", "main"):
        return []
    at = [k for k, c in enumerate(slot.children) if c.tag in TEXT_BLOCKS]
    outer = [c for k, c in enumerate(slot.children) if at and not at[0] <= k <= at[-1]]
    return [c for c in outer if c.tag in ("div", "section") and sums.get(id(c), 0.0) < EDGE * sums[id(slot)]]


def _elements(node: Node):
    """All elements below a node, in page order."""
    stack = node.blocks[::-1]
    while stack:
        c = stack.pop()
        yield c
        stack += c.blocks[::-1]


def text_code(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def layout_of(root: Node) -> str:
    """Path to the part that holds most of a page's text, with classes without digits."""
    return ">".join(".".join([n.tag, *sorted(c for c in n.classes if not any(x.isdigit() for x in c))])
                    for n in _slot_path(root, _totals(root)))


def _nearest(trees: dict[str, Node], root: Node) -> tuple[str, list[tuple[Node, Node]]]:
    """The layout of a page, or else the one that agrees most, and the matched nodes."""
    own, page = layout_of(root), condense(root)
    if own in trees:
        return own, match(trees[own], page)
    return max(((k, match(t, page)) for k, t in sorted(trees.items())), key=lambda x: len(x[1]))


def outline(node: Node, marks: dict[int, str] | None = None) -> dict:
    """A condensed tree as plain values; of a marked slot only the marked children."""
    marks = marks or {}
    out = {"t": node.tag, "n": node.names, "k": " ".join(sorted(node.classes))}
    if node.off:
        out["o"] = 1
    if mark := marks.get(id(node)):
        out["m"] = mark
    below = [outline(c, marks) for c in node.children]
    return out | ({"c": below} if below else {})


def induce(packed: str, stats: dict[int, tuple[bool, int, float]], pages: int) -> dict:
    """Wrapper of a layout from its base's outline (JSON) and, by place of a node in it:
    constant or not, code of the most frequent text, mean length of the texts."""
    base = _tree(json.loads(packed))
    nodes = [base, *_elements(base)]
    weight = {id(nodes[k]): size for k, (constant, _, size) in stats.items() if not constant}
    sums = _totals(base, weight)
    slot = _slot_path(base, sums)[-1]
    marks = {id(slot): "slot"}
    if pages > 1:
        marks |= {id(c): "edge" for c in _edges(slot, sums)}
    inside = {id(n) for n in _elements(slot)}
    # constant elements inside the slot that are no paragraphs or headings
    fixed = sorted({code for k, (constant, code, _) in stats.items()
                    if constant and id(nodes[k]) in inside and nodes[k].tag not in TEXT_BLOCKS})
    return {"tree": outline(base, marks), "fixed": fixed}


def _tree(outline: dict) -> Node:
    node = Node(outline["t"], outline["n"], outline["k"])
    node.mark, node.off = outline.get("m", ""), bool(outline.get("o"))
    node.children = node.blocks = [_tree(c) for c in outline.get("c", [])]
    return _shaped(node)


class Wrapper:
    def __init__(self, packed: str | None):
        """``packed``: wrappers of a host (JSON) by layout."""
        held = json.loads(packed) if packed else {}
        self.trees = {k: _tree(w["tree"]) for k, w in held.items()}
        self.constants = {k: set(w["fixed"]) for k, w in held.items()}

    def extract(self, page: str | None) -> str:
        """Text of a page: blocks in page order, joined by one space."""
        root = parse(page)
        layout, pairs = _nearest(self.trees, root) if self.trees else ("", [])
        slot = next((y.nodes[0] for x, y in pairs if x.mark == "slot"), None)
        edges = {id(n) for x, y in pairs if x.mark == "edge" for n in y.nodes}
        blocks = self._blocks(slot, edges, self.constants.get(layout, set())) if slot is not None else []
        if not any(blocks):
            blocks = self._blocks(content_slot(root), set(), set())
        return " ".join(b for b in blocks if b)

    def _blocks(self, slot: Node, edges: set[int], fixed: set[int]) -> list[str]:
        out, line = [], []

        def end() -> None:
            out.append(squeeze("".join(line)))
            line.clear()

        def walk(node: Node) -> None:
            for c in node.children:
                if not c.tag:
                    line.append(c.text)
                elif c.tag == "br":
                    line.append(" ")
                elif c.tag in INLINE:
                    walk(c)
                elif c.tag in VOID or c.off or id(c) in edges:
                    end()
                else:
                    end()
                    before = len(out)
                    walk(c)
                    end()
                    if fixed and c.tag not in TEXT_BLOCKS and text_code(" ".join(filter(None, out[before:]))) in fixed:
                        del out[before:]

        walk(slot)
        end()
        return out


def host_of(url: Column) -> Column:
    """Lower-case host of a url without port; empty for null."""
    return F.lower(F.regexp_extract(text_or_empty(url), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def bases(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, layout, base``: outline (JSON) of a page of each layout that a host has twice."""
    text = text_or_empty(F.col(html_col))
    mark = F.xxhash64(F.col(url_col), text).alias("mark")
    rows = pages.where(F.length(text) > 0).select(host_of(F.col(url_col)).alias("host"), text.alias("html"), mark)

    def layouts(batches):
        for batch in batches:
            found, nodes = [], []
            for page in batch.column("html"):
                root = parse(page.as_py())
                found.append(layout_of(root))
                nodes.append(sum(1 for _ in _elements(condense(root))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("host"), batch.column("mark"), pa.array(found, pa.string()), pa.array(nodes, pa.int64())],
                names=["host", "mark", "layout", "nodes"])

    # the page with the most elements, so that the base has every slot
    top = rows.mapInArrow(layouts, "host string, mark long, layout string, nodes long").groupBy("host", "layout").agg(
        F.count("*").alias("n"), F.max(F.struct("nodes", "mark"))["mark"].alias("mark"))
    top = materialise(top, "layouts")
    hosts = top.groupBy(F.col("host").alias("_host")).agg(F.max(F.struct("n", "layout"))["layout"].alias("most"))
    often = top.join(hosts, F.col("host") == F.col("_host")).where((F.col("layout") == F.col("most")) | (F.col("n") >= 2))
    often = often.select("_host", "layout", F.col("mark").alias("_mark"))
    chosen = rows.join(sized_side(often, F.lit(100)), (F.col("host") == F.col("_host")) & (F.col("_mark") == F.col("mark")))
    chosen = chosen.groupBy("host", "layout").agg(F.max("html").alias("html"))

    def outlines(batches):
        for batch in batches:
            packed = [json.dumps(outline(condense(parse(p.as_py())))) for p in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("host"), batch.column("layout"), pa.array(packed, pa.string())], names=["host", "layout", "base"])

    return chosen.mapInArrow(outlines, "host string, layout string, base string")


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, wrapper`` (JSON, by layout) from all pages of each host."""
    base = materialise(bases(pages, url_col, html_col), "bases")
    by_host = base.groupBy(F.col("host").alias("_host")).agg(F.map_from_entries(F.collect_list(F.struct("layout", "base"))).alias("bases"))
    text = text_or_empty(F.col(html_col))
    side = sized_side(materialise(by_host, "host-bases"), F.octet_length(F.to_json("bases")))
    rows = pages.where(F.length(text) > 0).select(host_of(F.col(url_col)).alias("host"), text.alias("html"))
    rows = rows.join(side, F.col("host") == F.col("_host")).select("host", "html", F.to_json("bases").alias("bases"))

    def texts(batches):
        held: dict[str, tuple[dict[str, Node], dict[int, int]]] = {}
        for batch in batches:
            out = []
            for host, page, packed in zip(*(batch.column(c) for c in ("host", "html", "bases")), strict=True):
                host = host.as_py()
                if host not in held:
                    if len(held) > 200:
                        held.clear()
                    trees = {k: _tree(json.loads(p)) for k, p in json.loads(packed.as_py()).items()}
                    held[host] = trees, {id(n): i for t in trees.values() for i, n in enumerate([t, *_elements(t)])}
                trees, place = held[host]
                root = parse(page.as_py())
                layout, pairs = _nearest(trees, root)
                whole = text_code(" ".join([n.text for n in (root, *_elements(root)) if n.text]))
                for x, y in pairs:
                    t = " ".join([n.text for n in y.nodes if n.text])
                    if t:
                        out.append((host, layout, place[id(x)], text_code(t), len(t), whole))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 6, (
                    pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64()), strict=True)],
                names=["host", "layout", "node", "code", "size", "page"])

    seen = rows.mapInArrow(texts, "host string, layout string, node int, code long, size int, page long").distinct()
    nodes = seen.groupBy("host", "layout", "node", "code").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    nodes = nodes.groupBy("host", "layout", "node").agg(
        F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("n", "code")).alias("top"))
    constant = (F.col("n") > 1) & (F.col("top.n") >= F.lit(CONSTANT) * F.col("n"))
    stats = nodes.select("host", "layout", "n", F.struct("node", constant.alias("constant"), F.col("top.code").alias("code"), "size").alias("s"))
    stats = stats.groupBy("host", "layout").agg(F.max("n").alias("pages"), F.collect_list("s").alias("stats"))
    stats = base.join(stats, ["host", "layout"], "left")

    def induced(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                held = {s["node"]: (s["constant"], s["code"], s["size"] / row["pages"]) for s in row["stats"] or []}
                out.append(json.dumps({row["layout"]: induce(row["base"], held, row["pages"] or 0)}, sort_keys=True)[1:-1])
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(out, pa.string())], names=["host", "part"])

    done = stats.select("host", "layout", "base", "pages", "stats").mapInArrow(induced, "host string, part string")
    return done.groupBy("host").agg(F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list("part")), ","), F.lit("}")).alias("wrapper"))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` without its html, with ``text`` (replacing a column of that
    name)."""
    keep = [c for c in pages.columns if c not in (html_col, "text")]
    induced = materialise(wrappers(pages, url_col, html_col), "wrappers")
    side = sized_side(induced.select(F.col("host").alias("_host"), "wrapper"), F.octet_length("wrapper") + 64)
    rows = pages.select(*[pages[c].alias(f"k{i}") for i, c in enumerate(keep)], host_of(pages[url_col]).alias("host"),
                        pages[html_col].cast("string").alias("html"))
    rows = rows.join(side, F.col("host") == F.col("_host"), "left").select(
        *[f"k{i}" for i in range(len(keep))], "wrapper", "html")
    schema = T.StructType([T.StructField(f"k{i}", pages.schema[c].dataType) for i, c in enumerate(keep)]).add("text", T.StringType())

    def run(batches):
        held: dict[str | None, Wrapper] = {}
        for batch in batches:
            out = []
            for w, page in zip(batch.column("wrapper"), batch.column("html"), strict=True):
                w = w.as_py()
                if w not in held:
                    if len(held) > 1000:
                        held.clear()
                    held[w] = Wrapper(w)
                out.append(held[w].extract(page.as_py()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(keep))), pa.array(out, pa.string())],
                names=[*(f"k{i}" for i in range(len(keep))), "text"])

    done = rows.mapInArrow(run, schema)
    return done.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "text")
