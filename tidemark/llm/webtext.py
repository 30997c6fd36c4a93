"""HTML extraction by wrapper induction: DOM trees of same-host pages aligned by simple tree matching.

Every page of a host is aligned with reference pages of that host.  For each node of a reference its pages' texts are
counted: a node that most different pages hold with one text is template, and the others are varying slots.  The
deepest node below which most of the host's varying text lies is where the content is.  Names of elements and classes
decide only what this leaves open: which of several varying parts are comments, adverts and the like, and all of a
host with too few pages to compare.
"""

from __future__ import annotations

import functools
import html as html_lib
import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fits_broadcast, give_back, small_batches, split_join, written
from .urlgraph import host_and_path

# Element names of HTML, by how a text extractor treats them.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "title", "svg", "math", "iframe", "object", "select", "audio", "video", "canvas")
CLOSES_P = BLOCKS - {"body", "html", "head"}
BOILER_TAGS = frozenset("nav footer aside form menu button head dialog".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
BOILER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot adsense sponsor sponsored promo promotion banner nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager "
    "header masthead topbar footer colophon sidebar aside rail widget widgets cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup "
    "login share sharing social related recommended recommendations comment comments commentlist disqus respond reply replies search form".split()
)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S,
)
ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.S)
NO_BRACKETS = str.maketrans("", "", "()")  # outlines of pages travel with brackets around children
NAME_PARTS = re.compile(r"[a-z]+")
# Elements and names that never wrap a page.
SURE_TAGS = frozenset("nav footer aside head header menu button dialog".split())
SURE_NAMES = frozenset("comment comments commentlist disqus respond reply replies footer nav navbar navigation menu submenu".split())
#: Share of a page's text from which a node is a wrapper and no boilerplate.
WRAPPER_SHARE = 0.8
# Elements that hold a piece of text, and so are no place of a whole content.
TEXT_TAGS = frozenset("#text p td th li dt dd h1 h2 h3 h4 h5 h6 pre blockquote caption".split())
#: Characters of attributes that are read once and remembered.
MOST_CACHED = 200
# Open elements that another one of their kind closes.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}


@dataclass
class Options:
    """references: pages of a host that every page is aligned with.  main_share: of a host's varying text, the share
    that must lie below the content's place.  max_cells: size of an alignment table from which it is not held
    whole but halved until it fits; the alignment stays a largest one.  fit_share: a page counts for every reference that
    fits it at least so well, as a share of the best fit.  least_pages, held_share: a node is template
    if at least so many different pages of the host, and this share of those that have it, hold it with the same text.
    vary_share: of the texts at a reference's nodes, the share that must vary; else the pages are near copies.  names: whether names of elements and classes decide what the alignment leaves open."""

    references: int = 2
    main_share: float = 0.7
    max_cells: int = 1_000_000
    fit_share: float = 0.7
    least_pages: int = 3
    held_share: float = 0.6
    vary_share: float = 0.5
    names: bool = True


class Shape:
    """Label, hash of the text and children of a node, and of the tree below it: nodes, score when matched with itself, and
    hashes of the labels alone and of labels and texts.  number: place in page order, for a reference."""

    __slots__ = ("children", "full", "label", "labels", "nodes", "number", "score", "text")

    def __init__(self, label: str, text: int, children: list[Shape]):
        self.label, self.text, self.children, self.number = label, text, children, -1
        if children:
            self.nodes = 1 + sum([c.nodes for c in children])
            self.score = 1 + (text != 0) + sum([c.score for c in children])
            self.labels = hash((label, *[c.labels for c in children]))
            self.full = hash((label, text, *[c.full for c in children]))
        else:
            self.nodes, self.score = 1, 1 + (text != 0)
            self.labels, self.full = hash((label,)), hash((label, text))

    def all(self) -> list[Shape]:
        """The node and all below it, in page order."""
        out, stack = [], [self]
        while stack:
            shape = stack.pop()
            out.append(shape)
            if shape.children:
                stack += shape.children[::-1]
        return out


@dataclass(slots=True)
class Node:
    """A block of the page; text without markup of the stretches between its child blocks."""

    tag: str
    boiler: bool = False
    main: bool = False
    children: list[Node] = field(default_factory=list)
    text: str = ""
    at: int = -1
    template: bool = False

    def nodes(self) -> list[Node]:
        """The node and all below it, in page order."""
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            out.append(node)
            if node.children:
                stack += node.children[::-1]
        return out

    def shape(self) -> Shape:
        """What an alignment with another page needs."""
        shapes: dict[int, Shape] = {}
        for node in reversed(self.nodes()):
            text = xxhash.xxh32_intdigest(node.text.encode("utf-8", "surrogatepass")) if node.text else 0
            shapes[id(node)] = Shape(node.tag, text, [shapes.pop(id(c)) for c in node.children])
        return shapes[id(self)]

    def key(self) -> int:
        return xxhash.xxh64_intdigest(self.text.encode("utf-8", "surrogatepass")) - (1 << 63)


@functools.lru_cache(4096)  # pages of a host repeat theirs
def _short_attributes(source: str, inside_main: bool) -> tuple[bool, bool, str]:
    return _read_attributes(source, inside_main)


def _attributes(source: str, inside_main: bool = False) -> tuple[bool, bool, str]:
    return _short_attributes(source, inside_main) if len(source) <= MOST_CACHED else _read_attributes(source, inside_main)


def _read_attributes(source: str, inside_main: bool) -> tuple[bool, bool, str]:
    """(names boilerplate, names the main part, class for the label).  Within the main part a header is its title's."""
    boiler = main = False
    label = ""
    if not source or source.isspace():
        return boiler, main, label
    for m in ATTR.finditer(source):
        name = m[1].lower()
        value = (m[2] or m[3] or m[4] or "").lower()
        if name == "role":
            boiler |= value in BOILER_ROLES
            main |= value in ("main", "article")
        elif name in ("class", "id"):
            boiler |= any(p in BOILER_NAMES and not (inside_main and p == "header") for p in NAME_PARTS.findall(value))
            label += "." + "_".join(value.split()).translate(NO_BRACKETS)
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            boiler = True
    return boiler, main, label


def parse(source: str | None) -> Node:
    """Tree of the page's blocks, however deep.  Inline elements only pass on their text; open paragraphs end where a block starts."""
    root = Node("root")
    stack, names = [root], ["root"]
    opened: Counter[str] = Counter()
    mains = 0
    pieces: list[str] = []

    def flush() -> None:
        if pieces:
            text = " ".join(html_lib.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                stack[-1].children.append(Node("#text", text=text))

    def close(k: int) -> None:
        nonlocal mains
        while len(stack) > k:
            mains -= stack.pop().main
            opened[names.pop()] -= 1

    at, size, source = 0, len(source or ""), source or ""
    inline_boiler: list[str] = []
    while at < size:
        m = TOKEN.match(source, at)
        at = m.end()
        cdata, end_tag, tag, attrs, text = m.groups()
        if text is not None or cdata is not None:
            if not inline_boiler:
                pieces.append(text or cdata or "")
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if tag in RAW_END and not end_tag:
            end = RAW_END[tag].search(source, at)
            if not attrs.rstrip().endswith("/") or tag in ("script", "style"):
                at = end.end() if end else size if tag in ("script", "style") else at
            continue
        if tag in BLOCKS:
            if end_tag:
                if tag == "p" or opened[tag]:
                    flush()
                    inline_boiler.clear()
                    if opened[tag]:
                        close(next(i for i in range(len(stack) - 1, 0, -1) if names[i] == tag))
                continue
            flush()
            inline_boiler.clear()
            if tag in CLOSES_P and names[-1] == "p":
                close(len(stack) - 1)
            closing = CLOSES.get(tag, ())
            while closing and names[-1] in closing:
                close(len(stack) - 1)
            if tag == "body":
                while len(stack) > 1 and names[-1] == "head":
                    close(len(stack) - 1)
            if tag in VOID:
                continue
            boiler, main, label = _attributes(attrs, mains > 0)
            if tag in ("html", "body"):
                boiler = False
            node = Node(tag + label, boiler or tag in BOILER_TAGS, main or tag in ("article", "main"))
            if tag == "header" and not mains:
                node.boiler = True
            stack[-1].children.append(node)
            stack.append(node)
            names.append(tag)
            opened[tag] += 1
            mains += node.main
        elif tag == "br":
            pieces.append(" ")
        elif tag not in VOID:
            if end_tag:
                if inline_boiler and inline_boiler[-1] == tag:
                    inline_boiler.pop()
            elif inline_boiler or _attributes(attrs)[0]:
                if not attrs.rstrip().endswith("/"):
                    if inline_boiler and tag != inline_boiler[0]:
                        continue
                    inline_boiler.append(tag)
    flush()
    _spare_wrappers(root)
    return root


def _spare_wrappers(root: Node) -> None:
    """Nodes that only sound like boilerplate, such as a form around the whole page, are none: those that hold a main
    part or most of the page's text."""
    order = root.nodes()
    doubtful = [n for n in order if n.boiler and n.tag.partition(".")[0] not in SURE_TAGS and not SURE_NAMES.intersection(NAME_PARTS.findall(n.tag.partition(".")[2]))]
    if not doubtful:
        return
    size, main = {}, {}
    for node in reversed(order):
        n, has = len(node.text), node.main and not node.boiler
        for c in node.children:
            n += size[id(c)]
            has = has or main[id(c)]
        size[id(node)], main[id(node)] = n, has
    total = size[id(root)]
    for node in doubtful:
        if main[id(node)] and not node.main or size[id(node)] > WRAPPER_SHARE * total > 0:
            node.boiler = False


def align(node: Node, shape: Shape, own: Shape, max_cells: int, order: list[Shape] | None = None, texts: set[int] | None = None) -> tuple[int, list[tuple[Node, Shape]]]:
    """Simple tree matching of a page with another's shape: the score, and the matched nodes with their shapes there.

    Roots match by label; their children are matched in order so that the number of matched nodes, and of those with
    the same text, is largest.  Equal trees at the start or end of two lists match each other, and so do trees of equal labels
    in lists without a text that the other page has: neither could match better elsewhere.  What is left takes a table.
    ``order`` and ``texts`` are all shapes of the page, and all texts of the other one, where they are known already.
    """
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))  # as deep as the trees are
    texts = {x.text for x in shape.all()} - {0} if texts is None else texts
    shared: set[int] = set()  # the page's nodes with a text below them that the other page has
    for x in (own.all() if order is None else order)[::-1]:
        if x.text in texts:
            shared.add(id(x))
        else:
            for c in x.children:
                if id(c) in shared:
                    shared.add(id(x))
                    break
    score: dict[tuple[int, int], int] = {}
    labels_only: dict[tuple[int, int], int] = {}

    def ends(a: list[Shape], b: list[Shape], free: bool) -> tuple[int, int]:
        """How many children match at the start and at the end of two lists; ``free``: they have no text in common."""
        most, start, end = min(len(a), len(b)), 0, 0
        if free:
            while start < most and a[start].labels == b[start].labels:
                start += 1
            while end < most - start and a[-1 - end].labels == b[-1 - end].labels:
                end += 1
        else:
            while start < most and a[start].full == b[start].full:
                start += 1
            while end < most - start and a[-1 - end].full == b[-1 - end].full:
                end += 1
        return start, end

    def next_row(x: Shape, above: list[int], b: list[Shape]) -> list[int]:
        row = [0]
        left, label, j = 0, x.label, 0
        for y in b:
            top = above[j + 1]
            if left > top:
                top = left
            if label == y.label:
                both = above[j] + matched(x, y)
                if both > top:
                    top = both
            row.append(top)
            left = top
            j += 1
        return row

    def last_row(a: list[Shape], b: list[Shape]) -> list[int]:
        row = [0] * (len(b) + 1)
        for x in a:
            row = next_row(x, row, b)
        return row

    def matched(a: Shape, b: Shape) -> int:
        if a.label != b.label:
            return 0
        if a.full == b.full:
            return a.score
        if not a.children or not b.children:
            return 1 + (a.text == b.text != 0)
        if id(a) in shared:
            known, key = score, (id(a), id(b))
        else:
            known, key = labels_only, (a.labels, b.labels)
        found = known.get(key)
        if found is None:
            x, y, free = a.children, b.children, known is labels_only
            start, end = ends(x, y, free)
            n, m = len(x) - end, len(y) - end
            found = 1 + sum([c.nodes if free else c.score for c in [*x[:start], *x[n:]]])
            if start < n and start < m:
                found += last_row(x[start:n], y[start:m])[-1]
            if len(known) >= max_cells:
                known.clear()
            known[key] = found
        return found

    def pairs(a: list[Shape], b: list[Shape], i0: int = 0, j0: int = 0) -> Iterator[tuple[int, int]]:
        """Places of the children matched with each other; large tables are halved, which needs two rows at a time."""
        n, m = len(a), len(b)
        if not n or not m:
            return
        if n == m == 1:
            if a[0].label == b[0].label:
                yield i0, j0
            return
        if n > 1 and n * m > max_cells:
            half = n // 2
            up, down = last_row(a[:half], b), last_row(a[half:][::-1], b[::-1])
            cut = max(range(m + 1), key=lambda j: up[j] + down[m - j])
            yield from pairs(a[:half], b[:cut], i0, j0)
            yield from pairs(a[half:], b[cut:], i0 + half, j0 + cut)
            return
        best = [[0] * (m + 1)]
        for x in a:
            best.append(next_row(x, best[-1], b))
        i, j = n, m
        while i and j:
            x, y = a[i - 1], b[j - 1]
            if x.label == y.label and best[i][j] == best[i - 1][j - 1] + matched(x, y):
                yield i0 + i - 1, j0 + j - 1
                i, j = i - 1, j - 1
            elif best[i][j] == best[i - 1][j]:
                i -= 1
            else:
                j -= 1

    found, open_ = [], [(node, own, shape)]
    while open_:
        at, a, b = open_.pop()
        found.append((at, b))
        nodes, x, y = at.children, a.children, b.children
        start, end = ends(x, y, id(a) not in shared)
        n, m = len(x) - end, len(y) - end
        open_ += zip(nodes[:start], x[:start], y[:start], strict=True)
        open_ += zip(nodes[n:], x[n:], y[m:], strict=True)
        if start < n and start < m:
            open_ += [(nodes[i], x[i], y[j]) for i, j in pairs(x[start:n], y[start:m], start, start)]
    return matched(own, shape), found


class Wrapper:
    """What is known of a host: its references' shapes and, by a node's number there in page order, the text hash of
    template nodes and the content's place (-1: not known)."""

    def __init__(self, shapes: list[Shape], template: list[dict[int, int]] | None = None, places: list[int] | None = None):
        self.shapes = shapes
        self.parents, self.tags, self.texts = [], [], []
        for shape in shapes:
            order = shape.all()
            parents = [-1] * len(order)
            for n, x in enumerate(order):
                x.number = n
            for n, x in enumerate(order):
                for c in x.children:
                    parents[c.number] = n
            self.parents.append(parents)
            self.tags.append([x.label.partition(".")[0] for x in order])
            self.texts.append({x.text for x in order} - {0})
        self.template = template or [{} for _ in shapes]
        self.places = places or [-1] * len(shapes)

    def matches(self, root: Node, options: Options) -> list[tuple[int, list[tuple[Node, Shape]]]]:
        """The references that fit a page about as well as the best does, best first, each with its matched nodes.

        How well is the share of both trees' nodes that are matched.
        """
        own, found = root.shape(), []
        order = own.all()
        for k, shape in enumerate(self.shapes):
            pairs = align(root, shape, own, options.max_cells, order, self.texts[k])[1]
            found.append((-2 * len(pairs) / (own.nodes + shape.nodes), k, pairs))
        found.sort(key=lambda x: x[:2])
        return [(k, pairs) for fit, k, pairs in found if fit <= options.fit_share * found[0][0]]

    def learn(self, seen: list[tuple[int, int, int, int, int]], options: Options) -> None:
        """Template and places from (reference, node, text hash of the template or 0, characters that vary, characters).

        Where little varies the pages are near copies of each other, and what they share is no template.
        """
        for k, parents in enumerate(self.parents):
            rows = [x[1:] for x in seen if x[0] == k]
            if sum(c for _, _, c, _ in rows) < options.vary_share * sum(c for *_, c in rows):
                continue
            self.template[k] = {n: t for n, t, _, _ in rows if t}
            mass = [0] * len(parents)
            for n, _, c, _ in rows:
                mass[n] += c
            for n in range(len(mass) - 1, 0, -1):
                mass[parents[n]] += mass[n]
            heavy = [n for n, m in enumerate(mass) if m >= options.main_share * mass[0] > 0 and self.tags[k][n] not in TEXT_TAGS]
            self.places[k] = heavy[-1] if heavy else -1


def observed(root: Node, wrapper: Wrapper, options: Options) -> list[tuple[int, int, int, int]]:
    """(reference, node there, text hash, characters) of the page's texts, for every reference that fits.

    A text that matches nothing counts, without its hash, for the node above it; one that names call boilerplate has
    no characters, so it can be template but no place of the content.
    """
    out = []
    for k, pairs in wrapper.matches(root, options):
        place = {id(node): shape.number for node, shape in pairs}
        stack = [(root, 0, False)]
        while stack:
            node, above, boiler = stack.pop()
            boiler |= node.boiler and options.names
            at = place.get(id(node))
            if node.text:
                out.append((k, above if at is None else at, 0 if at is None else node.key(), 0 if boiler else len(node.text)))
            if node.children:
                at = above if at is None else at
                stack += [(c, at, boiler) for c in node.children]
    return out


def _content(root: Node, place: int, options: Options) -> list[Node]:
    """The nodes that hold the content: those at the host's place, or where that is open or not on this page the whole
    page; and of these what the page itself marks as article or main part, if anything there is left."""
    tops = [n for n in root.nodes() if n.at == place] if place > 0 else []
    tops = tops or [root]
    if not options.names:
        return tops
    marked, stack = [], tops[::-1]
    while stack:
        node = stack.pop()
        if node.boiler:
            continue
        if node.main:
            marked.append(node)
        else:
            stack.extend(reversed(node.children))
    return [m for m in marked if any(_kept(m, options))] or tops


def _kept(top: Node, options: Options) -> Iterator[str]:
    """Texts below a node that are neither template nor boilerplate by name, in page order."""
    stack = [top]
    while stack:
        node = stack.pop()
        if node.boiler and options.names:
            continue
        if node.text and not node.template:
            yield node.text
        stack.extend(reversed(node.children))


def extract(source: str | None, wrapper: Wrapper | None = None, options: Options = Options()) -> str:
    """Main text of a page, blocks joined by two line ends; without a wrapper the names alone decide."""
    root = parse(source)
    place = -1
    if wrapper is not None and wrapper.shapes:
        k, pairs = wrapper.matches(root, options)[0]
        template, place = wrapper.template[k], wrapper.places[k]
        for node, shape in pairs:
            node.at = shape.number
            node.template = bool(node.text) and node.at in template and template[node.at] == node.key()
    return "\n\n".join(text for node in _content(root, place, options) for text in _kept(node, options))


def _to_text(shape: Shape) -> str:
    out, stack = [], [shape]
    while stack:
        node = stack.pop()
        if node is None:
            out.append(")")
            continue
        out.append(f"{node.label} {node.text}(")
        stack.append(None)
        stack.extend(reversed(node.children))
    return "".join(out)


def _from_text(text: str) -> Shape:
    stack: list[tuple[str, int, list]] = [("", 0, [])]
    for m in re.finditer(r"([^\s()]+) (\d+)\(|\)", text):
        if m[0] == ")":
            label, hashed, children = stack.pop()
            stack[-1][2].append(Shape(label, hashed, children))
        else:
            stack.append((m[1], int(m[2]), []))
    return stack[0][2][0]


def wrappers(rows: DataFrame, options: Options) -> DataFrame:
    """(h, s, seen, n): each host's references, of their nodes the template's text hash and the characters that vary, its pages.

    Both travel as one string each, which a task reads once per host and not once per page.

    ``rows`` has (id, url, html, host).  The references of a host are the pages with the smallest hashes of id and
    round, found by an aggregate.  Then every page is aligned with them and its texts are counted by node; pages with the same
    text count once.  Counts are pre-aggregated, so a host of any size is spread over all
    tasks, and a host's row is no larger than its references.
    """
    order = lambda k: F.xxhash64(F.lit(k), F.col("id"), F.col("url"))
    picks = rows.groupBy("host").agg(*[F.min(F.struct(order(k).alias("o"), F.col("id"), F.col("url"))).alias(f"p{k}") for k in range(options.references)])
    chosen = picks.select("host", F.explode(F.array_distinct(F.array(*[F.struct(f"p{k}.id", f"p{k}.url") for k in range(options.references)]))).alias("p"))
    chosen = written(chosen.select(F.col("host").alias("h"), F.col("p.id").alias("i"), F.col("p.url").alias("u")))
    few = fits_broadcast(chosen.count(), 200)
    pages_of = rows.join(F.broadcast(chosen) if few else chosen, F.col("host").eqNullSafe(F.col("h")) & F.col("id").eqNullSafe(F.col("i")) & F.col("url").eqNullSafe(F.col("u")))

    def shapes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"h": batch["host"], "s": [_to_text(parse(h).shape()) for h in batch["html"]]})

    outlines = pages_of.select("host", "html").mapInPandas(shapes, "h string, s string").where("h IS NOT NULL")
    outlines = outlines.groupBy("h", F.xxhash64("s").alias("x")).agg(F.min("s").alias("s")).groupBy("h").agg(F.concat_ws("\n", F.slice(F.array_sort(F.collect_set("s")), 1, options.references)).alias("s"))
    weights = rows.groupBy(F.col("host").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    outlines = written(outlines.join(weights, "h").where(F.col("n") >= options.least_pages))

    def observe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Known()
        for batch in batches:
            out = []
            for host, html, found in zip(batch["h"], batch["html"], batch["s"], strict=True):
                root = parse(html)
                whole = "\0".join(n.text for n in root.nodes() if n.text)
                seen = [(-1, 0, 0, 0), *observed(root, known.wrapper(host, found, None, options), options)]
                out.append((host, xxhash.xxh64_intdigest(whole.encode("utf-8", "surrogatepass")) - (1 << 63), *([r[i] for r in seen] for i in range(4))))
            yield pd.DataFrame(out, columns=["h", "x", "k", "at", "t", "c"])
        give_back()

    joined = split_join(rows.where("host IS NOT NULL").select(F.col("host").alias("h"), "html"), outlines, ["h"], "n")
    seen = joined.mapInPandas(observe, "h string, x long, k array<int>, at array<int>, t array<long>, c array<int>")
    seen = seen.groupBy("h", "x").agg(F.min(F.struct("k", "at", "t", "c")).alias("m"))
    nodes = seen.select("h", F.explode(F.arrays_zip("m.k", "m.at", "m.t", "m.c")).alias("e")).select("h", "e.*")
    counts = nodes.groupBy("h", "k", "at", "t").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c"))
    most = F.max_by(F.struct("t", "n", "c"), F.struct("n", "t"))
    by_node = counts.groupBy("h", "k", "at").agg(F.sum("n").alias("n"), F.sum("c").alias("c"), most.alias("top"))
    held = (F.col("top.t") != 0) & (F.col("top.n") >= options.least_pages) & (F.col("top.n") >= options.held_share * F.col("n"))
    by_node = by_node.select("h", "k", "at", F.col("n").alias("pages"), F.when(held, F.col("top.t")).otherwise(0).alias("t"), (F.col("c") - F.when(held, F.col("top.c")).otherwise(0)).alias("v"), "c")
    learnt = by_node.groupBy("h").agg(F.concat_ws(";", F.collect_list(F.when(F.col("k") >= 0, F.concat_ws(",", "k", "at", "t", "v", "c")))).alias("seen"), F.max(F.when(F.col("k") < 0, F.col("pages"))).alias("pages"))
    learnt = learnt.where(F.col("pages") >= options.least_pages).drop("pages")
    return outlines.join(learnt, "h", "left")


class _Known:
    """Wrappers of the hosts that a task has met last."""

    def __init__(self):
        self.held: dict[str, Wrapper | None] = {}

    def wrapper(self, host: str | None, shapes: str | None, seen: str | None, options: Options) -> Wrapper | None:
        if shapes is None:
            return None
        if host not in self.held:
            if len(self.held) > 1000:
                self.held.clear()
            made = Wrapper([_from_text(s) for s in shapes.split("\n")])
            if seen is not None:
                made.learn([tuple(map(int, x.split(","))) for x in seen.split(";") if x], options)
            self.held[host] = made
        return self.held[host]


def main_text(pages: DataFrame, *, id_col: str = "page_id", options: Options = Options()) -> DataFrame:
    """Main text of every page: id, url, text, n_chars.

    What is template and where the content lies is learnt from all pages of a host (wrappers).  The wrappers come to
    the pages by a broadcast of the hosts with very many pages and a join of the others.  Null html: empty text; null url: no
    host, so names alone decide; repeated rows: alike; a host with fewer than options.least_pages different pages: names
    alone; a very long or deep html: read whole, by itself; an empty table: an empty table; other columns are not read.
    """
    small_batches(pages.sparkSession)
    host, _ = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("host", F.nullif(host, F.lit("")))
    known = written(wrappers(rows, options))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hosts = _Known()
        for batch in batches:
            texts = []
            for host, html, found, seen in zip(batch["h"], batch["html"], batch["s"], batch["seen"], strict=True):
                wrapper = hosts.wrapper(host, found, seen, options) if seen is not None else None
                texts.append(extract(html, wrapper, options))
            yield pd.DataFrame({"id": batch["id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})
        give_back()

    kind = pages.schema[id_col].dataType.simpleString()
    joined = split_join(rows.withColumnRenamed("host", "h"), known, ["h"], "n", "left")
    return joined.select("id", "url", "h", "html", "s", "seen").mapInPandas(read, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col)
