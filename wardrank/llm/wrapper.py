"""Main text of web pages by wrapper induction.

1. Each page is parsed into a tree of block elements.  Siblings that repeat (a
   list's items, the paragraphs of a text) are folded into one node by
   aligning them, so that a tree has the shape of the template, not of the
   amount of text.
2. Trees of the pages of one host are aligned by simple tree matching: nodes
   match if their labels (tag, class, id and role, without digits) and their
   parents match, and of all alignments of two child lists in order that with
   the most matching nodes is taken.  Unmatched nodes are added.  The result
   is the host's wrapper.  Every node keeps how many pages have it, whether
   its text is the same on all of them, and how much text and link text it
   holds; these merge in any order.
3. Tasks first merge the pages of one host and shape; then equal shapes of all
   tasks meet, then up to ``fan_in`` shapes at a time are aligned, in as many
   rounds as it takes.  So a host with a third of all pages sends a few small
   trees, never its pages, to one task.
4. Constant nodes are template, varying slots content, with what the labels
   say about them: menus, footers, adverts, forms, comments and so on are
   never content, whether they vary or not; where a page marks its article,
   only the article's slots are content.  Each page is aligned with the
   wrapper of its host (once for all pages of one shape), and the text of its
   content nodes is put out in page order.

Nothing of an article is dropped: headings and plain paragraphs of a marked
article stay even if they are equal on all pages of the host (copies).

Defined cases: null and empty pages have an empty text; a null url is a host
of its own; a host with one page has no constant nodes; a page whose slots are
all constant (copies of one page) keeps all that its labels allow; broken
markup is read with the usual implied ends, elements more than ``DEPTH`` deep
belong to their ancestor there; repeated rows are pages like any others; an
empty table gives no rows; columns of the input named like an added one are
replaced.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fields, map_arrow, slices, stored

DEPTH = 100
BREAK, NOWHERE = -1, -2  # where a piece of text stands, if in no element
# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BREAKS = frozenset("br hr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre search section select summary table "
    "tbody td tfoot th thead title tr ul".split())
UNSEEN = frozenset("script style noscript template svg math iframe object applet canvas audio video head title".split())
FORMS = frozenset("form button select textarea input label fieldset datalist option optgroup legend".split())
SIDE = frozenset("nav aside footer menu dialog search".split())
CONTAINERS = frozenset("div section td center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | {"p", "pre", "blockquote", "li", "ul", "ol", "td", "tr", "tbody", "table", "dd", "dt", "dl"}
#: An open element of the key's kind ends where one of these starts.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
           "option": {"option"}, "tbody": {"tr", "td", "th", "tbody", "thead"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}}
#: Ends of these are not looked for beyond the elements named.
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"},
         "tfoot": {"table"}, "option": {"select"},
         "p": {"table", "td", "th", "ul", "ol", "dl", "article", "section", "main", "body", "div", "aside", "footer", "header", "nav",
               "blockquote", "form", "figure"}}
#: Words of a class, an id or a role that mark what is not the main text.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adbox adslot alert alerts banner banners breadcrumb "
    "breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies dialog discussion disqus footer "
    "gdpr hidden login masthead menu menubar menus modal nav navbar navigation newsletter notice notices notification notifications "
    "overlay pager pagination popup promo promos promoted promotion recommended recommendations related replies reply respond search "
    "share sharing sidebar sidebars signup skip social sponsor sponsored sponsors subscribe subscription teaser teasers toolbar "
    "topbar widget widgets".split())
TITLES = frozenset({"header"})  # not content, unless inside the article
#: The article, by the strength of the mark.
MARKS = (frozenset({"itemprop=articlebody"}), frozenset({"tag=article"}), frozenset({"tag=main", "role=main"}),
         frozenset(("article articlebody articlecontent articletext entrycontent postbody postcontent storybody maintext "
                    "maincontent").split()),
         frozenset("content post entry story main".split()))

#: Elements whose content is not markup.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())

#: A tag (slash, name, attributes), comment or declaration; quotes count after an equals sign only.
_MARKUP = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?)*+)(?:>|\Z)"""
                     r"""|<[!?][^>]*+(?:>|\Z)|</(?!\Z)[^>]*+(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>"']\S*)))?""")
_WORDS = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")


@lru_cache(maxsize=4096)
def _labelled(tag: str, attributes: str) -> tuple[str, bool, bool, int, bool]:
    """(label, never content, a title, strength as the article) of a start tag."""
    label, marks = [tag], {f"tag={tag}"}
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), unescape("".join(values)).lower()
        if name in ("class", "id", "role") and tag not in ("html", "body"):
            for token in sorted(value.split()):
                words = _WORDS.findall(token)
                marks.update(words)
                marks.add("".join(words))
                label.append(_DIGITS.sub("#", token))
            if name == "role":
                marks.add(f"role={value.strip()}")
        elif name == "itemprop":
            marks.add(f"itemprop={value.strip()}")
            label.append(value.strip())
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (
                name == "style" and "display:none" in value.replace(" ", "")):
            marks.add("hidden")  # which is boilerplate
            label.append("hidden")
    drop = tag in UNSEEN or tag in FORMS or tag in SIDE or not BOILERPLATE.isdisjoint(marks)
    level = next((i for i, m in enumerate(MARKS) if not m.isdisjoint(marks) and (i < 3 or tag in CONTAINERS)), 9)
    return " ".join(label), drop, not TITLES.isdisjoint(marks) or tag == "header", level


class _Page:
    """Nodes of the block elements of a page, in page order: what
    ``_labelled`` says of them and their parents; and the page's pieces of
    text: (node, text, whether in a link)."""

    def __init__(self, html: str):
        self.says: list[tuple] = [("#", False, False, 9)]
        self.parents = [-1]
        self.pieces: list[tuple[int, str, bool]] = []
        self.open: list[tuple[str, int]] = [("#", 0)]
        self.unseen = [False]  # scripts and the like
        self.linked = False
        at = 0
        while found := _MARKUP.search(html, at):
            if found.start() > at:
                self._text(html[at:found.start()])
            at = found.end()
            tag = found[2]
            if not tag:
                continue
            tag = tag.lower()
            if found[1]:
                self._end(tag)
                continue
            self._start(tag, found[3], found[3].endswith("/"))
            if tag in RAW:
                end = re.compile(f"</{tag}(?=[\\s/>])|\\Z", re.I).search(html, at)
                if tag not in UNSEEN:
                    self._text(html[at:end.start()])
                at = end.start()
        if at < len(html):
            self._text(html[at:])

    def _text(self, data: str) -> None:
        self.pieces.append((self.open[-1][1], unescape(data) if "&" in data else data, self.linked))

    def _break(self) -> None:
        self.pieces.append((BREAK, " ", False))

    def _find(self, tags, beyond) -> int:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] in tags:
                return k
            if self.open[k][0] in beyond:
                break
        return 0

    def _start(self, tag: str, attributes: str, closed: bool) -> None:
        if tag in BREAKS:
            self._break()
        if tag == "a":
            self.linked = True
        if tag in VOID:
            return
        block = tag in BLOCKS
        if block:
            if k := self._find(("p",), SCOPE["p"]):
                del self.open[k:]
            if tag in IMPLIED and (k := self._find(IMPLIED[tag], SCOPE[tag])):
                del self.open[k:]
            self._break()
        says = _labelled(tag, attributes)
        if not block and not says[1] and all(t != tag for t, _ in self.open):
            return  # inline: its text is the block's
        if closed and tag in UNSEEN:
            return  # the slash counts in drawings alone
        if len(self.open) > DEPTH:
            self.open.append((tag, NOWHERE if says[1] else self.open[-1][1]))
        else:
            self.says.append(says)
            self.parents.append(self.open[-1][1])
            self.unseen.append(tag in UNSEEN or (self.open[-1][1] >= 0 and self.unseen[self.open[-1][1]]))
            self.open.append((tag, len(self.says) - 1))

    def _end(self, tag: str) -> None:
        if tag == "a":
            self.linked = False
        if tag == "br":
            self._break()
        elif k := self._find((tag,), SCOPE.get(tag, () if tag in BLOCKS else BLOCKS)):
            del self.open[k:]
            if tag in BLOCKS:
                self._break()


class Node:
    """A node of a folded tree.  ``says``: its label and what that marks it
    as; ``shape``: a hash of the labels of its tree."""

    __slots__ = ("says", "kids", "shape", "size", "pages", "low", "high", "chars", "linked", "index")

    def __init__(self, says: tuple, kids: list[Node], index: list[int]):
        self.says, self.kids, self.index = says, kids, index
        self.pages, self.low, self.high, self.chars, self.linked = 1, 0, 0, 0, 0
        self.measure()

    def measure(self) -> None:
        self.size = 1 + sum([k.size for k in self.kids]) if self.kids else 1
        self.shape = hash((self.says, *[k.shape for k in self.kids]))

    def written(self) -> list:
        return [*self.says, *(k.written() for k in self.kids)]

    def walk(self) -> Iterator[Node]:
        yield self
        for k in self.kids:
            yield from k.walk()

    def add(self, other: Node, same_page: bool) -> None:
        """Take in the text of a matched node."""
        self.index += other.index
        if same_page:  # siblings: the text of the one and the other
            self.low = self.high = (self.low * 0x9E3779B97F4A7C15 + other.low + 1) % (1 << 62)
        else:
            self.pages += other.pages
            self.low, self.high = min(self.low, other.low), max(self.high, other.high)
        self.chars += other.chars
        self.linked += other.linked


def matches(a: list[Node], b: list[Node]) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two child lists: the most matching nodes, and
    the matched places in order."""
    head = 0
    while head < min(len(a), len(b)) and a[head].shape == b[head].shape:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail].shape == b[-1 - tail].shape:
        tail += 1
    pairs = [(k, k) for k in range(head)] + [(len(a) - 1 - k, len(b) - 1 - k) for k in range(tail - 1, -1, -1)]
    total = sum(a[i].size for i, _ in pairs)
    mid_a, mid_b = a[head:len(a) - tail], b[head:len(b) - tail]
    if not mid_a or not mid_b:
        return total, pairs
    best = np.zeros((len(mid_a) + 1, len(mid_b) + 1), np.int64)
    weight = np.zeros((len(mid_a), len(mid_b)), np.int64)
    of_label: dict[tuple, list[int]] = {}
    for j, y in enumerate(mid_b):
        of_label.setdefault(y.says, []).append(j)
    for i, x in enumerate(mid_a):
        for j in of_label.get(x.says, ()):
            y = mid_b[j]
            weight[i, j] = x.size if x.shape == y.shape else 1 + matches(x.kids, y.kids)[0]
        row = np.maximum(best[i, 1:], best[i, :-1] + weight[i])
        best[i + 1, 1:] = np.maximum.accumulate(row)
    i, j, found = len(mid_a), len(mid_b), []
    while i and j:
        if best[i, j] == best[i - 1, j]:
            i -= 1
        elif best[i, j] == best[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            found.append((head + i, head + j))
    return total + int(best[-1, -1]), pairs[:head] + found[::-1] + pairs[head:]


def merge(a: Node, b: Node, same_page: bool = False) -> Node:
    """``a`` with ``b`` (equal labels) aligned to it and taken in."""
    a.add(b, same_page)
    if a.shape == b.shape:
        for x, y in zip(a.kids, b.kids):
            merge(x, y, same_page)
        return a
    _, pairs = matches(a.kids, b.kids)
    kids, at_a, at_b = [], 0, 0
    for i, j in [*pairs, (len(a.kids), len(b.kids))]:
        kids += a.kids[at_a:i] + b.kids[at_b:j]
        if i < len(a.kids):
            kids.append(merge(a.kids[i], b.kids[j], same_page))
        at_a, at_b = i + 1, j + 1
    a.kids = fold(kids) if same_page else kids
    a.measure()
    return a


def fold(kids: list[Node], longest: int = 6) -> list[Node]:
    """Neighbouring repeats of up to ``longest`` siblings as one."""
    out: list[Node] = []
    for kid in kids:
        out.append(kid)
        k = 1
        while k <= min(longest, len(out) // 2):
            if all([x.says == y.says for x, y in zip(out[-2 * k:-k], out[-k:])]):
                for x, y in zip(out[-2 * k:-k], out[-k:]):
                    merge(x, y, True)
                del out[-k:]
                k = 0
            k += 1
    return out


class Read(NamedTuple):
    """A page: its folded tree, and its pieces of text: the place of their
    node in the tree, whether a break stands before them, and the text."""

    tree: Node
    nodes: list[int]
    breaks: list[bool]
    texts: list[str]


def read_page(html: str | None) -> Read:
    page = _Page(html or "")
    n = len(page.says)
    kids: list[list[Node]] = [[] for _ in range(n)]
    text: list[list[str]] = [[] for _ in range(n)]
    linked = [0] * n
    for at, piece, link in page.pieces:
        if at >= 0:
            text[at].append(piece)
            if link:
                linked[at] += len(piece)
    for k in range(n - 1, -1, -1):
        node = Node(page.says[k], fold(kids[k][::-1]) if kids[k] else [], [k])
        if text[k] and (own := " ".join("".join(text[k]).split())):
            node.chars, node.linked = len(own), linked[k]
            node.low = node.high = xxhash.xxh64_intdigest(own.encode("utf-8", "surrogatepass")) >> 2
        if k:
            kids[page.parents[k]].append(node)
    folded = [0] * n
    for place, x in enumerate(node.walk()):
        for k in x.index:
            folded[k] = place
    out, broken, last = Read(node, [], [], []), False, -1
    for at, piece, _ in page.pieces:
        if at == BREAK:
            broken = True
        elif at != NOWHERE and not page.unseen[at]:
            if not broken and folded[at] == last:
                out.texts[-1] += piece
                continue
            last = folded[at]
            out.nodes.append(last)
            out.breaks.append(broken)
            out.texts.append(piece)
            broken = False
    return out


def joined(nodes: list[int], breaks: list[bool], texts: list[str], content: frozenset[int]) -> str:
    """The text of the content nodes, blocks joined by one space."""
    out = []
    for at, broken, text in zip(nodes, breaks, texts):
        if broken:
            out.append(" ")
        if at in content:
            out.append(text)
    return " ".join("".join(out).split())


def _stats(tree: Node) -> np.ndarray:
    return np.array([(x.pages, x.low, x.high, x.chars, x.linked) for x in tree.walk()], dtype=np.int64)


def _with_stats(shape: str, stats: np.ndarray) -> Node:
    """The tree that ``Node.written`` wrote."""
    rows = iter(stats.tolist())

    def read(written: list) -> Node:
        own = next(rows)
        node = Node(tuple(written[:4]), [read(k) for k in written[4:]], [])
        node.pages, node.low, node.high, node.chars, node.linked = own
        return node

    return read(json.loads(shape))


def _combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a + b
    out[:, 1], out[:, 2] = np.minimum(a[:, 1], b[:, 1]), np.maximum(a[:, 2], b[:, 2])
    return out


_TREES = fields("host string", "key long", "shape string", "stats binary")


def _read(pages: DataFrame, held: int) -> DataFrame:
    """The pages (row, host, html) as read: host, key of the shape, pieces of
    text.  And rows without ``nodes``: the trees of a host and shape, the
    equal ones merged in the task."""
    schema = T.StructType([T.StructField("row", pages.schema["row"].dataType), *_TREES.fields, *fields("nodes array<int>", "breaks array<boolean>", "texts array<string>").fields])

    def run(batches):
        found: dict[tuple[str, int], tuple[str, np.ndarray]] = {}
        written: dict[int, tuple[str, int]] = {}
        empty = None

        def out():
            n = len(found)
            rows = [(h, w, stats) for (h, _), (w, stats) in found.items()]
            return {"row": pa.nulls(n, empty), "host": [h for h, _, _ in rows], "key": [w[1] for _, w, _ in rows], "shape": [w[0] for _, w, _ in rows],
                    "stats": [x.tobytes() for _, _, x in rows], "nodes": [None] * n, "breaks": [None] * n, "texts": [None] * n}

        for b in slices(batches, 64):
            empty = b["row"].type
            keys, reads, hosts = [], [], b["host"].to_pylist()
            for host, t in zip(hosts, b["html"].to_pylist()):
                read = read_page(t)
                shape = read.tree.shape
                if shape not in written:
                    text = json.dumps(read.tree.written())
                    written[shape] = text, xxhash.xxh64_intdigest(text) - (1 << 63)
                keys.append(written[shape][1])
                stats, old = _stats(read.tree), found.get((host, shape))
                found[host, shape] = (written[shape], stats if old is None else _combined(old[1], stats))
                reads.append(read)
            none = [None] * len(reads)
            yield {"row": b["row"], "host": hosts, "key": keys, "shape": none, "stats": none, "nodes": [r.nodes for r in reads],
                   "breaks": [r.breaks for r in reads], "texts": [r.texts for r in reads]}
            if len(written) > held:
                yield out()
                found.clear()
                written.clear()
        if found:
            yield out()

    return map_arrow(pages.select("row", "host", "html"), schema, run)


def _met(trees: DataFrame, meet: Column, aligned: bool) -> DataFrame:
    """The trees of one value of ``meet`` and one host as one: equal shapes
    added up, or all shapes aligned, one after the other."""
    def run(batches):
        last, tree, stats = None, None, None

        def out():
            shape = json.dumps(tree.written()) if aligned else last[2]
            return {"host": [last[1]], "key": [xxhash.xxh64_intdigest(shape) - (1 << 63)], "shape": [shape],
                    "stats": [(_stats(tree) if aligned else stats).tobytes()]}

        for b in slices(batches, 64):
            for m, host, shape, blob in zip(*(b[c].to_pylist() for c in ("meet", "host", "shape", "stats"))):
                now = (m, host, None if aligned else shape)
                x = np.frombuffer(blob, np.int64).reshape(-1, 5)
                if now != last:
                    if last is not None:
                        yield out()
                    last, tree, stats = now, _with_stats(shape, x) if aligned else None, x
                elif aligned:
                    tree = merge(tree, _with_stats(shape, x))
                else:
                    stats = _combined(stats, x)
        if last is not None:
            yield out()

    met = trees.select(meet.alias("meet"), "host", "shape", "stats").repartition("meet")
    return map_arrow(met.sortWithinPartitions("meet", "host", "shape"), _TREES, run)


def induce(shapes: DataFrame, fan_in: int = 64) -> DataFrame:
    """One wrapper per host from its distinct trees (host, key, shape, stats)."""
    trees = shapes
    while True:
        several = trees.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if several.isEmpty():
            return trees
        of = trees.join(several, "host", "left").withColumn("parts", F.ceil(F.coalesce("n", F.lit(1)) / fan_in))
        trees = stored(_met(of, F.xxhash64("host", F.pmod(F.col("key"), "parts")), True), "wrappers")


def _plans(shapes: DataFrame, wrappers: DataFrame) -> DataFrame:
    """(host, key, content): the places of the content nodes of each shape."""
    told = shapes.join(wrappers.select("host", F.col("shape").alias("w_shape"), F.col("stats").alias("w_stats")), "host")

    def run(batches):
        last, wrapper = None, None
        for b in slices(batches, 64):
            content = []
            for host, shape, stats, w_shape, w_stats in zip(*(b[c].to_pylist() for c in ("host", "shape", "stats", "w_shape", "w_stats"))):
                if host != last:
                    last, wrapper = host, _with_stats(w_shape, np.frombuffer(w_stats, np.int64).reshape(-1, 5))
                tree = _with_stats(shape, np.frombuffer(stats, np.int64).reshape(-1, 5))
                content.append(sorted(content_of(tree, wrapper)))
            yield {"host": b["host"], "key": b["key"], "content": content}

    return map_arrow(told, fields("host string", "key long", "content array<int>"), run)


def content_of(tree: Node, wrapper: Node, few: int = 3, many: int = 8) -> frozenset[int]:
    """The places of the nodes of a page's tree that hold main text.

    ``wrapper`` is aligned with the tree.  A node is constant if at least
    ``few`` pages have it, with one text; inside a marked article ``many``
    pages must, and headings and prose without a class stay.
    """
    of: dict[int, Node] = {}

    def pair(x: Node, y: Node) -> None:
        of[id(x)] = y
        for i, j in matches(x.kids, y.kids)[1]:
            pair(x.kids[i], y.kids[j])

    pair(tree, wrapper)

    def text_in(x: Node) -> int:
        return 0 if x.says[1] else of.get(id(x), x).chars + sum(map(text_in, x.kids))

    def marked(x: Node, level: int, under: bool) -> Iterator[Node]:
        _, drop, _, own_level = x.says
        if own_level == level and not drop and text_in(x):
            yield x
        elif under or not drop:
            for k in x.kids:
                yield from marked(k, level, under)

    total, roots = text_in(tree), []
    # a form or the like may stand around the whole page, with the article in it
    for level, under in [*((k, False) for k in range(len(MARKS))), (0, True), (1, True), (2, True)]:
        roots = list(marked(tree, level, under))
        if roots and (level < 3 or 2 * sum(map(text_in, roots)) > total):
            break
        roots = []

    def chosen(x: Node, article: bool, constant: bool) -> Iterator[Node]:
        label, drop, title, _ = x.says
        if drop or (title and not article):
            return
        y = of.get(id(x), x)
        fixed = y.low == y.high and y.pages >= (many if article else few)
        plain = article and label in PROSE
        dense = not article and not x.kids and y.chars and 2 * y.linked > y.chars
        if not (constant and fixed and not plain) and not dense:
            yield x
        for k in x.kids:
            yield from chosen(k, article, constant)

    for constant in (True, False):  # if all slots are constant, they are content
        found = [x for r in (roots or [tree]) for x in chosen(r, bool(roots), constant)]
        if any(of.get(id(x), x).chars for x in found):
            break
    here = {id(x) for x in found}
    return frozenset(place for place, x in enumerate(tree.walk()) if id(x) in here)


def host_of(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def extract(pages: DataFrame, html: str = "html", url: str = "url", out: str = "text", fan_in: int = 64, held: int = 2000) -> DataFrame:
    """``pages`` without the html, with the column ``out``: the main text,
    blocks joined by one space.

    Pages are parsed once; their text is stored with the place of each piece.
    What is content is decided once for each shape of a host and meets the
    pages by a join on both, which Spark broadcasts only if that table is small.
    """
    kept = [f for f in pages.schema.fields if f.name not in (html, out)]
    source = pages.select(F.struct(*(f.name for f in kept)).alias("row"), F.col(html).cast("string").alias("html"), host_of(url).alias("host"))
    read = stored(_read(source, held), "pages")
    trees = read.where("nodes is null").select("host", "shape", "stats")
    shapes = stored(_met(trees, F.xxhash64("host", "shape"), False), "shapes")
    plans = stored(_plans(shapes, induce(shapes, fan_in)), "plans")  # of known size: pages move only if it is large
    told = read.where("nodes is not null").select("row", "host", "key", "nodes", "breaks", "texts").join(plans, ["host", "key"])

    def run(batches):
        for b in slices(batches, 1000):
            columns = (b[c].to_pylist() for c in ("nodes", "breaks", "texts", "content"))
            yield {f.name: b["row"].field(k) for k, f in enumerate(kept)} | {
                out: [joined(n, br, t, frozenset(c)) for n, br, t, c in zip(*columns)]}

    return map_arrow(told.select("row", "nodes", "breaks", "texts", "content"), T.StructType([*kept, T.StructField(out, T.StringType())]), run)
