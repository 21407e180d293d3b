"""Main text of web pages by wrapper induction.

Each page is read into a tree of blocks. Runs of like siblings (paragraphs of
an article, entries of a menu) are folded into one repeatable node, so trees
are small and the pages of a site mostly share one. All distinct trees of a
host are merged into its reference, so every node has a place there; each tree
is aligned with the reference by simple tree matching, the largest
order-keeping matching of equal tags, once. Over all pages of the host it is
then seen whether an aligned node's text is always the same. Nodes constant
over pages of different texts are template, nodes whose text varies are slots.

A page's text is that of its slots, less what markup itself declares not to be
the article: variation alone cannot tell an advert or a menu that changes with
every page from content, so regions of navigation, asides, forms, notices,
adverts and comments are left out by tag, role and class name, unless a class
name turns out to be that of a layout around the article. Inside
``article`` or ``main`` every remaining node counts as a slot, since a site's
pages may repeat one article.

Defined cases: a NULL or empty html has empty text; a host with a single page,
or whose pages all hold the same text, has no template; a page without url
belongs to the host ''. Repeated rows are each answered. Other columns are
ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from itertools import accumulate, count

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwater.llm.store import bounded_batches, small, stored

# Tags by role, fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
DROPPED = frozenset(
    "head nav header footer aside form script style noscript template iframe object embed svg math canvas button select option "
    "textarea input dialog menu audio video map title".split()
)
MAIN = frozenset(("article", "main"))
# An open element of the first kind ends when one of the second begins.
ENDS = {
    "p": frozenset(
        "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
        "header hgroup hr main menu nav ol p pre section table ul".split()
    ),
    "li": frozenset(("li",)),
    "dt": frozenset(("dt", "dd")),
    "dd": frozenset(("dt", "dd")),
    "tr": frozenset(("tr", "tbody", "tfoot")),
    "td": frozenset(("td", "th", "tr", "tbody", "tfoot")),
    "th": frozenset(("td", "th", "tr", "tbody", "tfoot")),
    "option": frozenset(("option", "optgroup")),
    "head": frozenset(("body",)),
}
ENDED_BY = {tag: tuple(e for e in ENDS if tag in ENDS[e]) for tag in frozenset().union(*ENDS.values())}
SCOPES = frozenset(("table", "td", "th", "ul", "ol", "div", "article", "section", "main", "body", "html"))
# Words in class, id or role that declare a region not to be the article.
DECLARED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|banner|nav|navbar|navigation|menu|sidebar|"
    r"breadcrumb|breadcrumbs|footer|header|masthead|cookie|cookies|consent|notice|alert|popup|modal|newsletter|subscribe|share|sharing|"
    r"social|comment|comments|disqus|related|recommended|widget|search|login|signup|complementary|contentinfo|skip)(?:$|[\s_-])",
    re.IGNORECASE,
)

# About so many distinct trees of a host are merged by one task.
MERGED = 32

NODES = "page_id long, url string, host string, skeleton string, shape binary, content long, nodes array<struct<node:int,main:boolean,hash:long,text:string>>"

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.DOTALL)
_NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
WRITTEN = str.maketrans("()", "__")  # written trees use parentheses
_BLANKS = re.compile(r"[\x20\x09-\x0D]+")


class Node:
    __slots__ = ("children", "declared", "named", "number", "shape", "tag", "text", "up")

    def __init__(self, tag: str, up: Node | None = None, declared: bool = False, named: bool = False, text: str = "") -> None:
        self.tag, self.up, self.declared, self.named, self.text = tag, up, declared, named, text
        self.children: list[Node] = []
        self.number = self.shape = 0


def _start(tag: str, attributes: str, up: Node) -> Node:
    """A new element; ``declared`` by tag or role not to be the article, or just ``named`` so by class or id."""
    found = {"role": "", "class": ""}
    if "=" in attributes:
        for m in _NAMED.finditer(attributes):
            found["role" if m[1].lower() == "role" else "class"] += " " + (m[2] or m[3] or m[4] or "")
    plain = tag in ("body", "html", "article", "main")
    declared = tag in DROPPED or (not plain and bool(DECLARED.search(found["role"])))
    return Node(tag, up, declared, not declared and not plain and bool(DECLARED.search(found["class"])))


def parse(page: str) -> list[Node]:
    """The block elements in document order, the root first; each run of text between block boundaries is a leaf of its own."""
    root = Node("#root")
    order, stack, buffer = [root], [root], []
    # Places in the stack: of each tag, and of the elements that bound what a start tag may end.
    places: dict[str, list[int]] = {}
    scopes: list[int] = []

    def flush() -> None:
        if buffer:
            text = _BLANKS.sub(" ", entities.unescape("".join(buffer))).strip(" ")
            buffer.clear()
            if text:
                leaf = Node("#text", stack[-1], text=text)
                stack[-1].children.append(leaf)
                order.append(leaf)

    def close(k: int) -> None:
        while len(stack) > k:
            places[stack.pop().tag].pop()
        while scopes and scopes[-1] >= k:
            scopes.pop()

    at = 0
    while found := _TOKEN.search(page, at):
        buffer.append(page[at : found.start()])
        at = found.end()
        tag = (found[2] or "").lower().translate(WRITTEN)
        if not tag:
            continue
        if found[1]:
            if tag in INLINE:
                continue
            flush()
            if places.get(tag):
                close(places[tag][-1])
            continue
        if tag in INLINE:
            if tag == "br":
                buffer.append(" ")
            continue
        flush()
        ended = max((places[t][-1] for t in ENDED_BY.get(tag, ()) if places.get(t)), default=0)
        if ended and ended >= (scopes[-1] if scopes else 0):
            close(ended)
        if tag in RAW:
            # Its content is no markup: go on after its own end tag.
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        node = _start(tag, found[3], stack[-1])
        stack[-1].children.append(node)
        order.append(node)
        if tag not in VOID and not found[3].rstrip().endswith("/"):
            places.setdefault(tag, []).append(len(stack))
            if tag in SCOPES:
                scopes.append(len(stack))
            stack.append(node)
    buffer.append(page[at:])
    flush()
    return order


def left_out(order: list[Node]) -> set[Node]:
    """The outermost elements that are not the article.

    Tag and role decide by themselves. A class or id may also name a layout
    ("has-sidebar"), so an element named by them stays when it holds ``main``,
    or holds ``article`` while the region around it has none elsewhere, or when
    neither has any or both have, if it holds most of the region's text. A
    region is the page, an article, or such an element that stays.
    """
    # Of each element: text inside, and the articles and mains inside; those outside named elements are told apart.
    size, mains, inside, bare = ({n: 0 for n in order} for _ in range(4))
    for node in reversed(order):
        size[node] += len(node.text)
        if node.up and not node.declared:
            up, own = node.up, node.tag in MAIN
            size[up] += size[node]
            mains[up] += mains[node] + (node.tag == "main")
            inside[up] += inside[node] + own
            bare[up] += 0 if node.named else bare[node] + own
    out: set[Node] = set()
    region: dict[Node, Node] = {order[0]: order[0]}
    for node in order[1:]:
        if node.up not in region:
            continue
        around = region[node.up]
        if node.declared:
            out.add(node)
        elif node.named:
            holds, elsewhere = bool(inside[node]), bool(bare[around])
            if mains[node] or (holds and not elsewhere) or (holds == elsewhere and 2 * size[node] > size[around]):
                region[node] = node
            else:
                out.add(node)
        else:
            region[node] = node if node.tag in MAIN else around
    return out


class Folded:
    """A page's nodes in order, like siblings folded: the folded tree as text, and number, whether in the article and text of each leaf."""

    def __init__(self, page: str) -> None:
        order = parse(page)
        shapes: dict[tuple, int] = {}
        sizes: list[int] = []
        for node in reversed(order):
            folded = [c.shape for k, c in enumerate(node.children) if not k or node.children[k - 1].shape != c.shape]
            key = (node.tag, *folded)
            node.shape = shapes.setdefault(key, len(shapes))
            if node.shape == len(sizes):
                sizes.append(1 + sum(sizes[s] for s in folded))
        out = left_out(order)
        main, dropped = {order[0]: False}, {order[0]: False}
        self.leaves: list[tuple[int, bool, str]] = []
        for node in order:
            if node.up:
                main[node] = main[node.up] or node.tag in MAIN
                dropped[node] = dropped[node.up] or node in out
            if node.text and not dropped[node]:
                self.leaves.append((node.number, main[node], node.text))
            at, last = node.number + 1, None
            for child in node.children:
                if last and last.shape == child.shape:
                    # A repetition: its leaves belong to the nodes of the first one.
                    child.number = last.number
                    continue
                child.number, last = at, child
                at += sizes[child.shape]
        parts: list[str] = []
        todo: list[Node | None] = [order[0]]
        while todo:
            node = todo.pop()
            if node is None:
                parts.append(")")
                continue
            parts.append(f"({node.tag}")
            todo.append(None)
            todo += [c for k, c in enumerate(node.children) if not k or node.children[k - 1].shape != c.shape][::-1]
        self.skeleton = "".join(parts)


# Trees are tuples (tag, children, number, size); equal trees are one object with one number while they are remembered.
REMEMBERED = 200_000
_numbers = count()
_trees: dict[tuple, tuple] = {}
_scores: dict[tuple[int, int], int] = {}


def _tree(tag: str, children: list[tuple]) -> tuple:
    key = (tag, *(c[2] for c in children))
    if key not in _trees:
        _trees[key] = (tag, tuple(children), next(_numbers), 1 + sum(c[3] for c in children))
    return _trees[key]


def tree(skeleton: str) -> tuple:
    """The tree from its written form."""
    stack: list[list] = [[]]
    for part in re.finditer(r"\(([^()]+)|\)", skeleton):
        if part[1]:
            stack.append([part[1]])
        else:
            node = stack.pop()
            stack[-1].append(_tree(node[0], node[1:]))
    return stack[0][0]


def written(node: tuple) -> str:
    parts: list[str] = []
    todo: list[tuple | None] = [node]
    while todo:
        node = todo.pop()
        parts.append(f"({node[0]}" if node else ")")
        if node:
            todo.append(None)
            todo += node[1][::-1]
    return "".join(parts)


def _ends(a: tuple, b: tuple) -> tuple[int, int]:
    """How many first and last children are equal trees: some best matching pairs them."""
    most = min(len(a[1]), len(b[1]))
    first = next((k for k in range(most) if a[1][k] is not b[1][k]), most)
    last = next((k for k in range(most - first) if a[1][-1 - k] is not b[1][-1 - k]), most - first)
    return first, last


def _table(a: tuple, b: tuple) -> list[list[int]]:
    """Pairs in the best matching of the first i and j children, less the equal ends."""
    first, last = _ends(a, b)
    xs, ys = a[1][first : len(a[1]) - last], b[1][first : len(b[1]) - last]
    best = [[0] * (len(ys) + 1)]
    for x in xs:
        row, above = [0], best[-1]
        for j, y in enumerate(ys):
            row.append(max(row[j], above[j + 1], above[j] + _score(x, y)))
        best.append(row)
    return best


def _score(a: tuple, b: tuple) -> int | None:
    """Pairs of the two trees if that is known."""
    return a[3] if a is b else 0 if a[0] != b[0] else _scores.get((a[2], b[2]))


def _measure(a: tuple, b: tuple) -> None:
    """Fill in the scores of the two trees and of all subtrees that need it."""
    todo = [(a, b)]
    while todo:
        x, y = todo[-1]
        if _score(x, y) is not None:
            todo.pop()
            continue
        first, last = _ends(x, y)
        xs, ys = x[1][first : len(x[1]) - last], y[1][first : len(y[1]) - last]
        if missing := [(c, d) for c in xs for d in ys if _score(c, d) is None]:
            todo += missing
            continue
        todo.pop()
        _scores[x[2], y[2]] = 1 + _table(x, y)[-1][-1] + sum(c[3] for c in (*x[1][:first], *x[1][len(x[1]) - last :]))


def _matched_children(a: tuple, b: tuple) -> list[tuple[int, int]]:
    """Places of the children that a best matching of the trees pairs, in order."""
    first, last = _ends(a, b)
    best = _table(a, b)
    i, j = len(best) - 1, len(best[0]) - 1
    found = [(len(a[1]) - 1 - k, len(b[1]) - 1 - k) for k in range(last)]
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            found.append((first + i, first + j))
    return [(k, k) for k in range(first)] + found[::-1]


def _forget() -> None:
    """Between tasks on trees: numbers are never used again, so dropping what is known is safe."""
    if len(_trees) > REMEMBERED or len(_scores) > REMEMBERED:
        _trees.clear()
        _scores.clear()


def matched(a: tuple, b: tuple) -> tuple[int, tuple[tuple[int, int], ...]]:
    """Simple tree matching: most pairs of nodes of equal tag that keep parents and order.

    Returns the number of pairs and the pairs themselves, as places in each
    tree's own order.
    """
    if a[0] != b[0]:
        return 0, ()
    _measure(a, b)
    pairs: list[tuple[int, int]] = []
    todo = [(a, b, 0, 0)]
    while todo:
        x, y, p, q = todo.pop()
        if x is y:
            pairs += zip(range(p, p + x[3]), range(q, q + y[3]), strict=True)
            continue
        pairs.append((p, q))
        starts_x, starts_y = (list(accumulate((c[3] for c in n[1]), initial=at + 1)) for n, at in ((x, p), (y, q)))
        todo += [(x[1][i], y[1][j], starts_x[i], starts_y[j]) for i, j in _matched_children(x, y)]
    return len(pairs), tuple(pairs)


def merged(a: tuple, b: tuple) -> tuple:
    """The tree that holds both: matched nodes once, all others between them in order."""
    _measure(a, b)

    def frame(x: tuple, y: tuple) -> list:
        parts, i, j = [], 0, 0
        for p, q in [*_matched_children(x, y), (len(x[1]), len(y[1]))]:
            parts += [(c, c) for c in (*x[1][i:p], *y[1][j:q])]
            if p < len(x[1]):
                parts.append((x[1][p], y[1][q]))
            i, j = p + 1, q + 1
        return [x[0], parts[::-1], []]

    if a is b:
        return a
    stack = [frame(a, b)]
    while True:
        tag, todo, done = stack[-1]
        if todo:
            x, y = todo.pop()
            if x is y:
                done.append(x)
            else:
                stack.append(frame(x, y))
            continue
        stack.pop()
        node = _tree(tag, done)
        if not stack:
            return node
        stack[-1][2].append(node)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("node", pa.int32()), ("main", pa.bool_()), ("hash", pa.int64()), ("text", pa.string())]))
    for batch in batches:
        skeletons, contents, nodes = [], [], []
        for page in batch.column(3).to_pylist():
            folded = Folded(page or "")
            skeletons.append(folded.skeleton)
            contents.append(xxhash.xxh64_intdigest("\n".join(t for _, _, t in folded.leaves)) - 2**63)
            nodes.append([{"node": n, "main": m, "hash": xxhash.xxh64_intdigest(t) - 2**63, "text": t} for n, m, t in folded.leaves])
        columns = [*batch.columns[:3], pa.array(skeletons, pa.string()), pa.array([xxhash.xxh128_digest(k) for k in skeletons], pa.binary()), pa.array(contents, pa.int64()), pa.array(nodes, kind)]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "host", "skeleton", "shape", "content", "nodes"])


def _merge(table: pa.Table) -> pa.Table:
    """One tree that holds all trees of a part of a host."""
    _forget()
    own = sorted(zip(*(table.column(c).to_pylist() for c in ("first", "skeleton")), strict=True), key=lambda r: (r[0] is None, *r[r[0] is None :]))
    whole = tree(own[0][1])
    for _, skeleton in own[1:]:
        whole = merged(whole, tree(skeleton))
    return pa.table({"host": table.column("host")[:1], "first": pa.array([own[0][0]], pa.int64()), "skeleton": pa.array([written(whole)], pa.string())})


def references(trees: DataFrame) -> DataFrame:
    """(host, reference): a tree that holds every tree of the host, merged a bounded number at a time until one is left."""
    parts = trees.select("host", "first", "skeleton")
    while True:
        sizes = parts.groupBy("host").agg(F.ceil(F.count("*") / MERGED).cast("int").alias("parts"))
        most = sizes.agg(F.max("parts")).first()[0] or 1
        dealt = parts.join(sizes, "host").withColumn("part", F.pmod(F.xxhash64("skeleton"), F.col("parts")))
        parts = stored(dealt.groupBy("host", "part").applyInArrow(_merge, "host string, first long, skeleton string"), "references")
        if most == 1:
            return parts.select("host", F.col("skeleton").alias("reference"))


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, shape, skeleton, reference) to (host, shape, pairs of places), those of texts only."""
    kind = pa.list_(pa.struct([("node", pa.int32()), ("place", pa.int32())]))
    for batch in batches:
        pairs = []
        for own, reference in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            _forget()
            tags = re.findall(r"\(([^()]+)", own)
            pairs.append([{"node": n, "place": p} for n, p in matched(tree(own), tree(reference))[1] if tags[n] == "#text"])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pairs, kind)], ["host", "shape", "pairs"])


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text) for every page."""
    bounded_batches(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), host.alias("host"), F.col(html).alias("html"))
    read = stored(rows.mapInArrow(_nodes, NODES), "pages")
    # Distinct trees of each host, aligned with the one that holds them all.
    trees = stored(read.groupBy("host", "shape").agg(F.min("page_id").alias("first"), F.min("skeleton").alias("skeleton")), "trees")
    pairs = trees.join(references(trees), "host").select("host", "shape", "skeleton", "reference")
    aligned = stored(pairs.mapInArrow(_align, "host string, shape binary, pairs array<struct<node:int,place:int>>"), "aligned")
    places = aligned.select("host", "shape", F.inline("pairs"))
    # Over all pages: does the text at a place of the reference ever change? Counted per tree first, so a large host is summed early.
    leaf = read.select("host", "shape", "content", F.inline(F.transform("nodes", lambda n: F.struct(n["node"].alias("node"), n["hash"].alias("hash")))))
    by_tree = leaf.groupBy("host", "shape", "node").agg(
        F.min("hash").alias("low"), F.max("hash").alias("high"), F.min("content").alias("one"), F.max("content").alias("other")
    )
    by_place = by_tree.join(places, ["host", "shape", "node"]).groupBy("host", "place").agg(
        *(F.min(c).alias(c) for c in ("low", "one")), *(F.max(c).alias(c) for c in ("high", "other"))
    )
    # A host whose pages are all alike shows nothing; only hosts with some varying place have a template.
    varies = by_place.groupBy("host").agg(F.max(F.col("low") < F.col("high")).alias("varies")).filter("varies").select("host")
    # Copies of one page show nothing either: a constant place counts when pages of different texts have it.
    constant = by_place.filter((F.col("low") == F.col("high")) & (F.col("one") < F.col("other"))).join(varies, "host", "left_semi").select("host", "place")
    template = stored(
        places.join(constant, ["host", "place"]).groupBy(F.col("host").alias("_host"), F.col("shape").alias("_shape"))
        .agg(F.collect_set("node").alias("fixed")),
        "template",
    )
    joined = read.join(small(template), (F.col("host") == F.col("_host")) & (F.col("shape") == F.col("_shape")), "left")
    fixed = F.coalesce("fixed", F.array().cast("array<int>"))
    kept = F.filter("nodes", lambda n: n["main"] | ~F.array_contains(fixed, n["node"]))
    return joined.select("page_id", "url", F.array_join(F.transform(kept, lambda n: n["text"]), "\n").alias("text"))
