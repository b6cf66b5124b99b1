"""HTML extraction by site style trees.

The DOMs of all pages of a host are merged in one tree. An element of the tree is known by its way
from the root: at each step the tags of all children of the parent (its presentation style), the
place among them, the tag and its class and id. That way is hashed while a page is parsed, so
pages are merged by an aggregation, not by walking trees together.

Importance, from 0 (the same on all pages: navigation, notices) to 1 (different on each):

- an inner element has the entropy of its styles over its pages, to base m, the number of pages
  that have it (1 where that is one page);
- a leaf has one less the mean entropy of its content over its pages, where what occurs on one
  page only has entropy 0 and what all share has 1; content is sentences, links and images;
- both are combined upwards: (1 - DAMPING) own + DAMPING mean of the children, averaged over the
  element's pages. As each page's part is a sum over its elements with weights that depend on the
  way alone, leaves send their importance to their parents and every inner element sends its own
  and its leaves', weighted, to its ancestors: one aggregation for all depths. What would count for
  less than ``LEAST`` is not sent.

Of each page, the branches are left out in which nothing is worth keeping. A text counts by its own
content and by where it stands: (1 - CONTEXT) its importance + CONTEXT the composite importance of
the element around it, in which that element's presentation has its part. A branch goes if that is
below ``KEEP_AT`` for all its texts: important content keeps what it stands in, not what stands
beside it, and labels in a part of the page that differs from page to page are judged more mildly
than the same words in a part that is always the same. What stays is the text, a line for each block.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, discard, joined_side, materialise, row_key, small_batches

DAMPING, CONTEXT, KEEP_AT, LEAST = 0.7, 0.3, 0.35, 1e-6
DEEPEST = 512  # as in the browsers whose parsers have such a limit: what is nested deeper becomes a sibling

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>?|<[!?][^>]*>?|<", re.S)
_ATTRIBUTE = re.compile(r"([\w:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset("script style noscript template svg head title iframe object".split())
_IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template head".split())
#: HTML elements that end an open svg, except within these elements of it
_ENDS_SVG = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
_IN_SVG = frozenset("foreignobject desc title".split())
_RAW = frozenset("script style textarea title".split())
_INLINE = frozenset("a abbr b bdi bdo br cite code data em font i img kbd label mark q s samp small span strong sub sup time u var wbr".split())
_CLOSES = {"p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()), "li": frozenset(["li"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"])}
_SENTENCE = re.compile(r"(?<=[.!?…。])\s+|\n+")


class Node:
    __slots__ = ("tag", "label", "features", "children", "text")

    def __init__(self, tag: str, label: str):
        self.tag, self.label, self.features, self.children, self.text = tag, label, [], [], None


def parse(page: str) -> Node:
    """The DOM: elements, and texts as leaves with the tag #text. Comments, scripts and the like
    are left out; unclosed and wrongly closed elements are closed as browsers do in simple cases. A
    head ends at the first text or tag that can't be in it, an svg at an HTML tag; other hidden
    elements of which no end follows on the page hide nothing."""
    root = Node("#root", "#root")
    stack = [root]
    at, n = 0, len(page)
    last_end: dict[str, int] = {}

    def ended(tag: str, start: int) -> bool:
        if tag not in last_end:
            last_end[tag] = max((m.start() for m in re.finditer(f"</{tag}\\b", page, re.I)), default=-1)
        return last_end[tag] >= start

    def words(start: int, stop: int) -> None:
        text = entities.unescape(page[start:stop])
        if text.strip():
            if stack[-1].tag == "head":
                stack.pop()
            leaf = Node("#text", "#text")
            leaf.text = text
            stack[-1].children.append(leaf)

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            words(at, n)
            break
        if m.start() > at:
            words(at, m.start())
        at = m.end()
        tag = m.group(2)
        if tag is None:
            if m.group() == "<":
                words(m.start(), at)
            continue
        tag = tag.lower()
        if m.group(1):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag == "body" or tag not in _IN_HEAD and stack[-1].tag == "head":
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "head":
                    del stack[k:]
                    break
        if tag in _ENDS_SVG:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in _IN_SVG:
                    break
                if stack[k].tag == "svg":
                    del stack[k:]
                    break
        while len(stack) > 1 and tag in _CLOSES.get(stack[-1].tag, ()):
            stack.pop()
        attributes = {a.lower(): b or c or d for a, b, c, d in _ATTRIBUTE.findall(m.group(3))} if m.group(3) else {}
        label = tag + "".join("." + attributes[a] for a in ("class", "id", "role") if attributes.get(a))
        node = Node(tag, label)
        node.features = [attributes[a] for a in ("href", "src") if attributes.get(a)]
        if tag not in _HIDDEN:
            stack[-1].children.append(node)
        if tag in _VOID or m.group(3).endswith("/"):
            continue
        if tag in _HIDDEN and tag not in _RAW and tag != "head" and not ended(tag, at):
            continue
        if tag in _RAW:
            end = re.compile(f"</{tag}\\b", re.I).search(page, at)
            at = end.start() if end else n
        if len(stack) < DEEPEST:
            stack.append(node)
    return _folded(root)


def _folded(root: Node) -> Node:
    """An element whose only child is a text becomes a leaf with that text."""
    todo = [root]
    while todo:
        node = todo.pop()
        if len(node.children) == 1 and node.children[0].text is not None and node is not root:
            node.text, node.children = node.children[0].text, []
        todo += node.children
    return root


def _hash(*parts: object) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")) - (1 << 63)


def walk(root: Node, host: str) -> Iterator[tuple[int, int | None, tuple | None, Node]]:
    """(key, style, above, node) for every element; style is None for leaves; above is (key, number
    of children, above) of the parent, None for the root. The root's key is that of the host."""
    todo: list[tuple[Node, int, tuple | None]] = [(root, _hash(host), None)]
    while todo:
        node, key, above = todo.pop()
        k = len(node.children)
        style = _hash(*(c.label for c in node.children)) if k else None
        yield key, style, above, node
        here = (key, k, above)
        for place, child in enumerate(node.children):
            todo.append((child, _hash(key, style, place, child.label), here))


def ancestors(above: tuple | None) -> tuple[list[int], list[int]]:
    """The keys of the ancestors and their numbers of children, the nearest first, as far up as an
    element counts."""
    keys, sizes, weight = [], [], DAMPING
    while above is not None and weight >= LEAST:
        key, k, above = above
        keys.append(key)
        sizes.append(k)
        weight *= DAMPING / k
    return keys, sizes


def content(node: Node) -> set[str]:
    return {" ".join(s.split()) for s in _SENTENCE.split(node.text or "") if s.strip()} | set(node.features)


ROWS = "key long, style long, n int, ups array<long>, children array<int>, features array<long>, times array<int>, tie long, keys array<long>"


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Three kinds of rows. Inner elements: key, style, n (pages of the batch), and, once for each
    key, its ancestors and how many children these have. Leaves: key, n, their parent and its
    number of children, and their content with how many pages have it. Pages: tie and the keys of
    their texts. Leaves go no further up than their parent, which keeps most rows short."""
    for batch in small_batches(batches, "html", 8 << 20):
        inner: dict[tuple[int, int], int] = {}
        ways: dict[int, tuple | None] = {}
        leaves: dict[int, list] = {}
        pages = []
        for host, tie, page in zip(*(batch.column(c).to_pylist() for c in ("host", "tie", "html"))):
            texts = []
            for key, style, above, node in walk(parse(page), host):
                if style is not None:
                    inner[key, style] = inner.get((key, style), 0) + 1
                    ways.setdefault(key, above)
                    continue
                leaf = leaves.get(key)
                if leaf is None:
                    leaf = leaves[key] = [0, above[:2] if above else None, {}]
                leaf[0] += 1
                for f in content(node):
                    h = _hash(f)
                    leaf[2][h] = leaf[2].get(h, 0) + 1
                if node.text is not None:
                    texts.append(key)
            pages.append((tie, texts))
        rows, told = [], set()
        for (key, style), n in inner.items():
            rows.append((key, style, n, *((None, None) if key in told else ancestors(ways[key])), None, None, None, None))
            told.add(key)
        rows += [(key, None, n, above and above[:1], above and above[1:], list(found), list(found.values()), None, None) for key, (n, above, found) in leaves.items()]
        rows += [(None, None, None, None, None, None, None, tie, texts) for tie, texts in pages]
        long, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
        kinds = (pa.int64(), pa.int64(), pa.int32(), long, ints, long, ints, pa.int64(), long)
        names = [x.split()[0] for x in ROWS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)


def importances(rows: DataFrame) -> DataFrame:
    """(key, parent, importance) of every element of the style trees, from the counts in ``rows``;
    parent is that of a leaf, null for inner elements. Leaves are shuffled once, by key, and
    everything about them is added up there."""
    m = F.col("m")
    leaves = rows.filter("key is not null and style is null").select("key", "n", "ups", "children", "features", "times").repartition("key")
    sizes = leaves.groupBy("key").agg(F.sum("n").alias("m"), F.min(F.get("ups", F.lit(0))).alias("parent"), F.min(F.get("children", F.lit(0))).alias("k"))
    pieces = leaves.select("key", F.explode(F.arrays_zip("features", "times")).alias("f")).groupBy("key", "f.features").agg(F.log(F.sum("f.times")).alias("x"))
    mean = pieces.groupBy("key").agg(F.avg("x").alias("h"))
    own = F.when(F.col("h").isNull(), 0.0).when(m == 1, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("h") / F.log(m)))
    leaf = materialise(sizes.join(mean, "key", "left").select("key", "parent", "k", "m", own.alias("importance")), "leaves")
    below = leaf.groupBy(F.col("parent").alias("key")).agg(F.sum(m * F.col("importance") / F.col("k")).alias("below"))

    inner = rows.filter("style is not null").groupBy("key", "style").agg(F.sum("n").alias("n"), F.first("ups", ignorenulls=True).alias("ups"), F.first("children", ignorenulls=True).alias("children"))
    inner = inner.groupBy("key").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"), F.first("ups", ignorenulls=True).alias("ups"), F.first("children", ignorenulls=True).alias("children"))
    style = F.when(m == 1, 1.0).otherwise(F.greatest(F.lit(0.0), (F.log(m) - F.col("s") / m) / F.log(m)))
    sent = inner.join(below, "key", "left").select("key", "m", "ups", "children", (m * style * (1 - DAMPING) + F.coalesce("below", F.lit(0.0)) * DAMPING).alias("x"))
    # an ancestor d steps up counts x by DAMPING ** d over the product of the numbers of children
    steps = F.aggregate(
        F.arrays_zip("ups", "children"),
        F.array(F.struct(F.col("key").alias("up"), F.lit(1.0).alias("w"))),
        lambda acc, u: F.concat(acc, F.array(F.struct(u["ups"].alias("up"), (F.element_at(acc, -1)["w"] * DAMPING / u["children"]).alias("w")))),
    )
    got = sent.select("key", "m", "x", F.explode(steps).alias("u")).select(F.col("u.up").alias("up"), (F.col("x") * F.col("u.w")).alias("x"), F.when(F.col("u.up") == F.col("key"), m).alias("m"))
    branch = got.groupBy(F.col("up").alias("key")).agg((F.sum("x") / F.max("m")).alias("importance"))
    return leaf.select("key", "parent", "importance").union(branch.select("key", F.lit(None).cast("long"), "importance"))


def unimportant(every: DataFrame, keep_at: float) -> DataFrame:
    """(key) of the leaves that count for less than ``keep_at`` by their content and by where they
    stand; ``every`` is a table as ``importances`` returns it."""
    around = every.filter("parent is null").select(F.col("key").alias("parent"), F.col("importance").alias("around"))
    standing = (1 - CONTEXT) * F.col("importance") + CONTEXT * F.col("around")
    return every.filter("parent is not null").join(around, "parent").filter(standing < F.lit(keep_at)).select("key").distinct()


def render(page: str, host: str, noisy: set[int]) -> str:
    """The text of a page without its branches of which all texts are ``noisy``: with the texts
    nothing of such a branch is left."""
    out: list[str] = []
    todo: list[tuple[Node, int] | str] = [(parse(page), _hash(host))]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        node, key = x
        block = node.tag not in _INLINE and node.tag != "#text"
        if block or node.tag == "br":
            out.append("\n")
        if node.text is not None and key not in noisy:
            out.append(node.text)
        if block:
            todo.append("\n")
        if node.children:
            style = _hash(*(c.label for c in node.children))
            todo += [(child, _hash(key, style, place, child.label)) for place, child in enumerate(node.children)][::-1]
    lines = (" ".join(x.split()) for x in "".join(re.sub(r"\s+", " ", x) if x != "\n" else x for x in out).split("\n"))
    return "\n".join(x for x in lines if x)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "html", 4 << 20):
        texts = [None if page is None else render(page, host, set(noisy or ())) for host, page, noisy in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "noisy")))]
        counts = [len(noisy or ()) for noisy in batch.column("noisy").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("host"), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], ["page_id", "host", "text", "n_left_out"])


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", keep_at: float = KEEP_AT) -> DataFrame:
    """A row for every row of ``pages``: page_id, host, text and n_left_out, how many different
    places of the page have a text that is left out.

    A null page has a null text, an empty one ''. URLs without a host, and null ones, share the
    host ''. A host with a single page keeps all of it. Repeated rows come back as often as they
    occur and count each as a page of its host. An empty table gives an empty result. Other
    columns are not looked at and don't come back. A text that counts for ``keep_at`` exactly stays."""
    bound_batches(pages)
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), row_key(id_col, url_col, html_col).alias("tie"), F.col(html_col).alias("html"))
    elements = materialise(rows.filter("html is not null").select("host", "tie", "html").mapInArrow(_elements, ROWS), "elements")
    every = materialise(importances(elements), "importances")
    noisy = materialise(unimportant(every, keep_at), "noisy")
    of_page = elements.filter("tie is not null").select(F.col("tie").alias("t"), F.explode(F.array_distinct("keys")).alias("key"))
    left_out = materialise(of_page.join(joined_side(noisy), "key").groupBy("t").agg(F.collect_set("key").alias("noisy")), "leftout")
    for done in (elements, every, noisy):
        discard(done)
    joined = rows.join(joined_side(left_out), F.col("tie") == F.col("t"), "left").select("page_id", "host", "html", "noisy")
    return joined.mapInArrow(_extract, "page_id long, host string, text string, n_left_out int")
