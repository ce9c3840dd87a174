"""Main text of web pages by wrapper induction.

Pages of one host share a template. Every page is parsed to a DOM tree and reduced to its
skeleton: the block elements, where equal siblings in a row (paragraphs, list items) are one
node. Pages of equal skeletons are a layout; their nodes correspond one to one. The layouts of
a host are brought together by simple tree matching with its most frequent one, which finds the
largest set of matching nodes that keeps order and ancestry.

For each node of that reference it is counted, over all pages, how many have a text there and
whether the text is always the same. Constant nodes are template, varying ones slots. The
content node is found by going down from the root as long as one child holds most of the
varying text. Counts combine on the map side, so a host with a third of all pages is no
large group; what is gathered for a host is one skeleton.

A page is read by aligning its own skeleton with the reference: the blocks below its content
node, without constant nodes and without what is never text or says that it is something else
(scripts, forms, adverts, reader comments). Only where nothing varies, as on a host with a
single page, or where a page lacks the content node, its own structure decides: ``article``
or ``main`` elements, else all but menus, headers, footers and the like.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetide.llm.url_trees import host_of
from casetide.runtime import materialize

#: Share of a node's varying text from which on the content lies in one child.
MOST = 0.5
#: Share of a host's text that must vary for its wrapper to be used.
VARIES = 0.5

# Fixed values of HTML.
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp", "template", "svg", "math")
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i",
    "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong",
    "sub", "sup", "time", "tt", "u", "var", "wbr",
}
_CLOSES_P = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu",
    "nav", "ol", "p", "pre", "section", "table", "ul",
}
_CLOSES = {"body": {"head"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_STOPS = {"li": {"ul", "ol", "menu"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "dt": {"dl"}, "dd": {"dl"}}

# Elements that hold running text, not other parts of a page.
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_TEXT = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "dt", "dd", "pre", "blockquote", "figcaption", "caption"}
# Elements without any text of a page.
_SILENT = {"head", "script", "style", "noscript", "iframe", "template", "svg", "math", "object", "embed", "noembed", "noframes", "title"}

# What is not main text, by tag, by role, and by words in class and id.
_BOILER_TAGS = {
    "nav", "header", "footer", "aside", "form", "script", "style", "head", "noscript", "iframe", "button", "select",
    "textarea", "input", "template", "menu", "dialog", "svg", "math", "object", "embed", "noembed", "noframes", "title",
}
_BOILER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "alertdialog", "form", "menu", "menubar"}
_BOILER_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "adbox", "sponsor", "sponsored", "promo", "promoted",
    "banner", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar",
    "aside", "widget", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal", "overlay", "newsletter",
    "subscribe", "signup", "login", "share", "sharing", "social", "related", "recommended", "pagination", "pager",
    "comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "feedback", "copyright", "toolbar", "skip", "alert",
}
# Elements that may carry such a word and still be the text itself, but for an article's few.
_KEPT = {"html", "body", "main", "h1", "h2", "h3", "h4", "h5", "h6"}
_NOT_ARTICLE = {"ad", "ads", "advert", "advertisement", "sponsored", "promo", "comment", "comments", "reply", "replies", "related", "recommended"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SPACE = re.compile(r"\s+")


@dataclass
class Node:
    tag: str
    names: str = ""
    boiler: bool = False  # not main text
    named: bool = False  # for its class or id alone
    parts: list = field(default_factory=list)  # text and nodes, in order

    @property
    def children(self) -> list[Node]:
        return [p for p in self.parts if isinstance(p, Node)]

    @property
    def label(self) -> str:
        return f"{self.tag}.{self.names}" if self.names else self.tag


def _attributes(raw: str) -> dict[str, str]:
    out = {}
    for name, *values in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), entities.unescape(next((v for v in values if v), "")))
    return out


def _boiler(tag: str, found: dict[str, str]) -> tuple[bool, bool]:
    """Whether an element is boilerplate, and whether its class or id alone says so."""
    if tag in _BOILER_TAGS or "hidden" in found or found.get("aria-hidden") == "true":
        return tag not in ("html", "body"), False
    if found.get("role", "").lower() in _BOILER_ROLES:
        return True, False
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
        return True, False
    if tag in _KEPT or not found:
        return False, False
    words = {w.lower() for name in ("class", "id") for w in _NAMES.findall(found.get(name, ""))}
    named = not words.isdisjoint(_NOT_ARTICLE if tag == "article" else _BOILER_WORDS)
    return named, named


def parse(text: str) -> Node:
    """DOM tree of a page; unclosed and stray tags are repaired the way browsers do, roughly."""
    root = Node("#root")
    stack, at = [root], 0
    while at < len(text):
        found = _TOKEN.search(text, at)
        begin = found.start() if found else len(text)
        if begin > at:
            stack[-1].parts.append(entities.unescape(text[at:begin]))
        if not found:
            break
        at = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        if found[1]:
            _close(stack, tag)
            continue
        _open(stack, tag)
        attributes = _attributes(found[3]) if found[3].strip(" /") else {}
        names = " ".join(sorted(attributes.get("class", "").split()))
        node = Node(tag, names, *_boiler(tag, attributes))
        if tag in ("article", "main") and not node.boiler:
            # A name like has-sidebar does not make boilerplate of what holds the article.
            for around in stack:
                around.boiler &= not around.named
        stack[-1].parts.append(node)
        if tag in _RAW:
            end = re.compile(rf"</{tag}\s*/?>|\Z", re.I).search(text, at)
            if tag not in _BOILER_TAGS:
                node.parts.append(text[at : end.start()])
            at = end.end()
        elif tag not in _VOID and not found[3].rstrip().endswith("/") or tag in ("p", "div"):
            stack.append(node)
    return root


def _close(stack: list[Node], tag: str) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            del stack[i:]
            return
        # A stray end tag of an inline element does not end a block around it.
        if tag in _INLINE and stack[i].tag not in _INLINE:
            return


def _open(stack: list[Node], tag: str) -> None:
    """End the elements that a start tag ends implicitly."""
    ends, stops = ({"p"}, {"table", "td", "th", "button"}) if tag in _CLOSES_P else (_CLOSES.get(tag), _STOPS.get(tag, set()))
    if not ends:
        return
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in ends:
            del stack[i:]
            return
        if stack[i].tag in stops:
            return


def blocks(node: Node) -> list[str]:
    """Text of the blocks below a node in page order, boilerplate left out."""
    out, run = [], []

    def flush() -> None:
        if text := _SPACE.sub(" ", "".join(run)).strip():
            out.append(text)
        run.clear()

    # An explicit stack: pages may be nested deeper than Python calls.
    todo: list = [node]
    while todo:
        part = todo.pop()
        if part is None:
            flush()
        elif isinstance(part, str):
            run.append(part)
        elif part.boiler and part is not node:
            if part.tag not in _INLINE:
                flush()
        elif part.tag in _INLINE:
            if part.tag in ("br", "wbr", "img"):
                run.append("\n" if part.tag == "br" else "")
            todo.extend(reversed(part.parts))
        else:
            flush()
            todo.append(None)
            todo.extend(reversed(part.parts))
    flush()
    return out


@dataclass
class Skeleton:
    """Block elements of a page, equal siblings in a row taken as one. Parents come first."""

    labels: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)

    @property
    def children(self) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in self.labels]
        for i, parent in enumerate(self.parents):
            if parent >= 0:
                out[parent].append(i)
        return out

    @property
    def layout(self) -> int:
        told = "\n".join(f"{p} {label}" for p, label in zip(self.parents, self.labels, strict=True))
        return xxhash.xxh64_intdigest(told.encode(errors="surrogatepass")) - (1 << 63)


@dataclass
class Page:
    """A page's block elements with the place of each in the page's skeleton."""

    nodes: list[Node]
    texts: list[str]
    at: list[int]
    skeleton: Skeleton


def _block_tree(root: Node) -> tuple[list[Node], list[int], list[str]]:
    """Block elements in page order, the place of their parent, and their own text.

    Inline elements belong to the block around them, also with blocks inside.
    """
    nodes, parents, texts = [root], [-1], [[]]
    todo: list[tuple] = [(p, 0) for p in reversed(root.parts)]
    while todo:
        part, parent = todo.pop()
        if isinstance(part, str):
            texts[parent].append(part)
        elif part.tag in _SILENT:
            continue
        else:
            if part.tag not in _INLINE:
                nodes.append(part)
                parents.append(parent)
                texts.append([])
                parent = len(nodes) - 1
            todo.extend((p, parent) for p in reversed(part.parts))
    return nodes, parents, [_SPACE.sub(" ", " ".join(t)).strip() for t in texts]


def page_of(root: Node) -> Page:
    nodes, parents, texts = _block_tree(root)
    children: list[list[int]] = [[] for _ in nodes]
    for i, parent in enumerate(parents):
        if parent >= 0:
            children[parent].append(i)
    known: dict[tuple, int] = {}
    shape = [0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):  # children come after their parents
        below = [shape[c] for c in children[i]]
        runs = tuple(x for x, before in zip(below, [None, *below], strict=False) if x != before)
        shape[i] = known.setdefault((nodes[i].label, runs), len(known))
    # Elements that are one node share its children too, as their shapes are equal.
    out, at, made = Skeleton(), [0] * len(nodes), {}
    out.labels.append(nodes[0].label)
    out.parents.append(-1)
    for i in range(len(nodes)):
        nth, before = -1, None
        for c in children[i]:
            if shape[c] != before:
                nth, before = nth + 1, shape[c]
            place = made.get((at[i], nth))
            if place is None:
                place = made[at[i], nth] = len(out.labels)
                out.labels.append(nodes[c].label)
                out.parents.append(at[i])
            at[c] = place
    return Page(nodes, texts, at, out)


def match(a: Skeleton, b: Skeleton) -> dict[int, int]:
    """Nodes of ``a`` aligned with nodes of ``b`` by simple tree matching.

    Roots must have equal labels. The children of two matched nodes are aligned in order so
    that the matched nodes below them are as many as possible. Pairs are visited from the
    roots down, then counted from the leaves up, so trees of any depth will do.
    """
    if a.labels[:1] != b.labels[:1] or not a.labels:
        return {}
    below = a.children, b.children
    order, seen = [(0, 0)], {(0, 0)}
    for x, y in order:
        for cx in below[0][x]:
            for cy in below[1][y]:
                if a.labels[cx] == b.labels[cy] and (cx, cy) not in seen:
                    seen.add((cx, cy))
                    order.append((cx, cy))
    size: dict[tuple[int, int], int] = {}
    pairs: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for x, y in reversed(order):
        xs, ys = below[0][x], below[1][y]
        best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        for i, cx in enumerate(xs):
            for j, cy in enumerate(ys):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + size.get((cx, cy), 0))
        found, i, j = [], len(xs), len(ys)
        while i and j:
            gain = size.get((xs[i - 1], ys[j - 1]), 0)
            if gain and best[i][j] == best[i - 1][j - 1] + gain:
                i, j = i - 1, j - 1
                found.append((xs[i], ys[j]))
            elif best[i][j] == best[i - 1][j]:
                i -= 1
            else:
                j -= 1
        size[x, y], pairs[x, y] = 1 + best[-1][-1], found
    out, todo = {}, [(0, 0)]
    while todo:
        x, y = todo.pop()
        out[x] = y
        todo.extend(pairs[x, y])
    return out


@dataclass(frozen=True)
class Wrapper:
    """The reference skeleton of a host, its content node (-1: none) and its constant nodes."""

    labels: tuple[str, ...] = ()
    parents: tuple[int, ...] = ()
    content: int = -1
    template: frozenset[int] = frozenset()


def induced(labels: list[str], parents: list[int], varying: list[int], constant: list[int], many: list[bool], more: list[int]) -> Wrapper:
    """The wrapper of a reference skeleton, from what was counted at its nodes.

    ``varying`` and ``constant``: characters there of texts that differ, or are the same, on all
    pages; ``many``: a page has several elements there; ``more``: characters, below the node, that
    have no counterpart in the reference.
    """
    mass = [v + m for v, m in zip(varying, more, strict=True)]
    for i in range(len(labels) - 1, 0, -1):
        mass[parents[i]] += mass[i]
    fixed = sum(constant)
    if not labels or not mass[0] or mass[0] < VARIES * (mass[0] + fixed):
        return Wrapper(tuple(labels), tuple(parents))
    below, node = Skeleton(labels, parents).children, 0
    while True:
        best = max(below[node], key=lambda c: mass[c], default=None)
        # A heading beside it belongs to the content, as do paragraphs in a row.
        titled = any(labels[c].split(".")[0] in _HEADINGS and mass[c] for c in below[node])
        if best is None or mass[best] < MOST * mass[node] or many[best] or titled or labels[best].split(".")[0] in _TEXT:
            break
        node = best
    template = frozenset(i for i, c in enumerate(constant) if c and not varying[i])
    return Wrapper(tuple(labels), tuple(parents), node, template)


def _main(root: Node) -> list[Node]:
    """Content nodes of a page by its own structure: ``main`` or ``article`` elements, else all."""
    for tag in ("article", "main"):
        found, todo = [], [root]
        while todo:
            node = todo.pop()
            if node.tag == tag:
                found.append(node)
            elif not node.boiler or node.tag in ("html", "body"):
                todo.extend(reversed(node.children))
        if found:
            return found
    return [root]


def extract(page: str | None, wrapper: Wrapper | None = None) -> str:
    """Main text of a page: its blocks, joined by two line feeds.

    By the wrapper if there is one and the page has its content node with some text, else by
    the page's own structure, without the nodes that are constant on its host.
    """
    if not page:
        return ""
    root = parse(page)
    if wrapper and wrapper.content >= 0:
        found = page_of(root)
        same = _counterparts(wrapper, tuple(found.skeleton.labels), tuple(found.skeleton.parents))
        content = []
        for node, at in zip(found.nodes, found.at, strict=True):
            place = same.get(at)
            if place == wrapper.content:
                content.append(node)
            elif place in wrapper.template:
                _drop_text(node)
        text = [b for n in content for b in blocks(n)]
        if text:
            return "\n\n".join(text)
    return "\n\n".join(b for n in _main(root) for b in blocks(n))


def _drop_text(node: Node) -> None:
    """Leave out the text that is a block's own, not the blocks inside it."""
    todo = [node]
    while todo:
        here = todo.pop()
        here.parts = [p for p in here.parts if not isinstance(p, str)]
        todo.extend(c for c in here.children if c.tag in _INLINE)


@lru_cache(maxsize=1_000)
def _counterparts(wrapper: Wrapper, labels: tuple[str, ...], parents: tuple[int, ...]) -> dict[int, int]:
    return match(Skeleton(list(labels), list(parents)), Skeleton(list(wrapper.labels), list(wrapper.parents)))


NODES = "host string, layout long, node int, parent int, label string, h long, chars long, many boolean"


def _page_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each skeleton node of each page, few pages at a time."""
    for whole in batches:
        for start in range(0, len(whole), _PAGES):
            rows: list[tuple] = []
            batch = whole.slice(start, _PAGES)
            for host, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                page = page_of(parse(text.as_py()))
                layout, size = page.skeleton.layout, len(page.skeleton.labels)
                texts: list[list[str]] = [[] for _ in range(size)]
                count = [0] * size
                for own, at in zip(page.texts, page.at, strict=True):
                    count[at] += 1
                    if own:
                        texts[at].append(own)
                for i in range(size):
                    told = "\n".join(texts[i])
                    h = xxhash.xxh64_intdigest(told.encode(errors="surrogatepass")) - (1 << 63) if told else None
                    rows.append((host, layout, i, page.skeleton.parents[i], page.skeleton.labels[i], h, len(told), count[i] > 1))
            yield pa.RecordBatch.from_pylist([dict(zip(_NODE_SCHEMA.names, r, strict=True)) for r in rows], schema=_NODE_SCHEMA)


_PAGES = 200
_NODE_SCHEMA = pa.schema([
    ("host", pa.string()), ("layout", pa.int64()), ("node", pa.int32()), ("parent", pa.int32()), ("label", pa.string()),
    ("h", pa.int64()), ("chars", pa.int64()), ("many", pa.bool_()),
])


ALIGNED = "array<struct<node int, ref int, under int>>"


def _aligned(own: pd.Series, reference: pd.Series) -> pd.Series:
    """Each node of a layout with its counterpart, and that of the nearest node above that has one."""

    def skeleton(nodes) -> Skeleton:
        found = sorted(nodes, key=lambda n: n["node"])
        return Skeleton([n["label"] for n in found], [n["parent"] for n in found])

    out = []
    for a, b in zip(own, reference, strict=True):
        mine = skeleton(a)
        same = match(mine, skeleton(b))
        under: list[int] = []
        for i, parent in enumerate(mine.parents):
            under.append(same.get(i, under[parent] if parent >= 0 else 0))
        out.append([{"node": i, "ref": same.get(i, -1), "under": under[i]} for i in range(len(under))])
    return pd.Series(out)


WRAPPER = "host string, labels array<string>, parents array<int>, content int, template array<int>"


def _induce(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("ref")
    found = induced(*(pdf[c].tolist() for c in ("label", "parent", "varying", "constant", "many", "more")))
    return pd.DataFrame({
        "host": [pdf["host"].iloc[0]], "labels": [list(found.labels)], "parents": [list(found.parents)],
        "content": [found.content], "template": [sorted(found.template)],
    })


def wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """A wrapper per host, from all of its pages."""
    rows = pages.select(host_of(F.col(url).cast("string")).alias("host"), F.col(html).cast("string").alias("html")).where("html <> ''")
    counted = rows.mapInArrow(_page_nodes, NODES).groupBy("host", "layout", "node").agg(
        F.first("parent").alias("parent"), F.first("label").alias("label"), F.count("*").alias("pages"), F.count("h").alias("texts"),
        F.min("h").alias("lo"), F.max("h").alias("hi"), F.sum("chars").alias("chars"), F.bool_or("many").alias("many"),
    )
    counted = materialize(counted, "layout-nodes")
    best = counted.where("node = 0").groupBy("host").agg(F.max(F.struct("pages", "layout"))["layout"].alias("layout"), F.sum("pages").alias("of"))
    tree = F.collect_list(F.struct("node", "parent", "label"))
    trees = counted.groupBy("host", "layout").agg(tree.alias("own"))
    reference = trees.join(best, ["host", "layout"]).select("host", F.col("own").alias("reference"), "of")
    matched = trees.join(reference, "host").select("host", "layout", F.inline(F.pandas_udf(_aligned, ALIGNED)("own", "reference")))
    # At each node of the reference: its texts over all layouts, and what has no counterpart below it.
    known = counted.join(matched, ["host", "layout", "node"])
    own = known.where("ref >= 0").groupBy("host", "ref").agg(
        F.sum("texts").alias("texts"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("chars").alias("chars"), F.bool_or("many").alias("many"),
    )
    more = known.where("ref < 0").groupBy("host", F.col("under").alias("ref")).agg(F.sum("chars").alias("more"))
    places = reference.select("host", "of", F.inline("reference")).withColumnRenamed("node", "ref")
    # A text that occurs once differs from page to page, unless there is only one page.
    same = (F.col("lo") == F.col("hi")) & ((F.col("texts") > 1) | (F.col("of") == 1))
    chars = F.coalesce("chars", F.lit(0))
    rows = places.join(own, ["host", "ref"], "left").join(more, ["host", "ref"], "left").select(
        "host", "ref", "parent", "label", F.when(same, F.lit(0)).otherwise(chars).alias("varying"), F.when(same, chars).otherwise(F.lit(0)).alias("constant"),
        F.coalesce("many", F.lit(False)).alias("many"), F.coalesce("more", F.lit(0)).alias("more"),
    )
    # One skeleton per host.
    return rows.groupBy("host").applyInPandas(_induce, WRAPPER)


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page.

    A null or empty html, and one without main text, gives an empty text. Pages with a null
    url, or one without a host, count as one host. Repeated rows are read one by one; equal
    pages alone tell nothing apart. An empty table gives no rows.
    """
    known = materialize(wrappers(pages, url, html), "wrappers").withColumnRenamed("host", "_host")
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url"))).join(known, F.col("host") == F.col("_host"), "left")

    @F.pandas_udf("string")
    def read(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in parts:
            yield pd.Series([
                extract(page, None if content is None or content != content else Wrapper(tuple(labels), tuple(int(p) for p in parents), int(content), frozenset(map(int, template))))
                for page, labels, parents, content, template in zip(*columns, strict=True)
            ], dtype=object)

    text = rows.select("page_id", "url", read("html", "labels", "parents", "content", "template").alias("text"))
    return text.withColumn("n_chars", F.length("text").cast("long"))
