"""HTML extraction by wrapper induction.

Pages of one host share a few layouts, known by their label paths.  All pages of
a host and layout are counted, copies once: a text that stands at the same label
path on nearly all of them is template.  One page with the most frequent arrangement
of containers is the reference that nodes are named by; every page's DOM tree is
aligned with it by simple tree matching and votes for the nodes, from the root on,
that hold most of the page's varying text.  The path of the nodes that more than
half of all pages vote for leads to the content slot.  The wrapper of a layout is
that path and the template texts that any page has within the slot.  One more wrapper
is learnt from all pages of the host, for layouts with too few pages.

Every page is then read by its wrapper: the text of the content slot
without template texts.  Menus, adverts and the like may vary from page to page
too, so elements that say what they are (``nav``, ``footer``, ``form``, a class
``ad``, ...) never count as content; a class, id, role or label says so only as a
whole name (``ad-box``, but not ``no-sidebar``), and, adverts and comments aside,
not of the element that holds most of the text of a page without its own ``article``.  Where a host has too few different pages,
or a page lacks the path, the ``article`` or ``main`` elements are read, or else
the body.

Character references are decoded, white space within a block becomes one space
and blocks are joined by one space.

Defined cases: a null or empty page gives an empty text; a null url has the
empty host; unclosed and unknown tags are taken as browsers do, roughly; rows
that share an id are read one by one; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatmill.llm.store import ship, written
from chatmill.llm.text import chunks

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PIECE = re.compile(r"[^a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th"
    " thead tr ul".split()
)
#: Start tags before which an open element of the same set ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}}
ENDS_P = BLOCK - frozenset("br body html head td th tr tbody thead tfoot li dd dt".split())
FURNITURE_TAGS = frozenset("nav footer aside form head button select menu dialog object label".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus"
    " footer gdpr login masthead menu nav navbar navigation newsletter notice pager pagination popup promo promoted"
    " recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe"
    " toolbar widget widgets".split()
)
#: What may stand beside a furniture word in one name; other pieces (``no-``, ``has-``, ``-open``) change its meaning.
STRUCTURE_WORDS = frozenset(
    "a an and area article bar block body bottom box button buttons center col column container content entry feed first"
    " footer for form google group header home icon icons inline inner item items js last left link links list main media"
    " message mobile module my of our outer page panel post posts primary right row secondary section site slot small sub"
    " text the title top unit us view wide wrap wrapper zone".split()
)
#: Names of adverts, notices and other people's texts, however long they are.
FOREIGN_WORDS = frozenset(
    "ad ads advert advertisement adverts comment comments consent cookie cookies disqus gdpr login newsletter popup promo"
    " promoted recommended related replies reply respond signup sponsor sponsored".split()
)
CONTENT_TAGS = frozenset(("article", "main"))
#: Elements whose label paths make a layout.
LAYOUT_TAGS = frozenset("article body center div header html main section".split())
#: Cells of one table of scores.
CELLS = 1 << 21


_CLOSE = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I | re.A) for tag in RAW}


class Node:
    __slots__ = ("tag", "kind", "kids", "furniture", "shape")

    def __init__(self, tag: str, kind: str = "", furniture: bool = False):
        self.tag, self.kind, self.furniture = tag, kind, furniture
        self.kids: list[Node | str] = []

    @property
    def label(self) -> str:
        return f"{self.tag}.{self.kind}" if self.kind else self.tag

    def elements(self) -> list[Node]:
        return [k for k in self.kids if type(k) is Node]


def _furniture_words(name: str) -> set[str]:
    """The furniture words of a class name, id, role or label that is made of nothing else but words of structure."""
    pieces = set(_PIECE.split(name)) - {""}
    words = pieces & FURNITURE_WORDS
    return words if words and pieces <= FURNITURE_WORDS | STRUCTURE_WORDS else set()


def _element(tag: str, attributes: str, named: list[Node]) -> Node:
    """``named`` receives elements that are furniture by a name only, and not by one of FOREIGN_WORDS."""
    kind, words, content = "", set(), tag in CONTENT_TAGS or tag in ("body", "html")
    if attributes and "=" in attributes:
        for name, *values in _ATTRIBUTE.findall(attributes):
            value = next(filter(None, values), "").lower()
            names = [value] if name.lower() == "aria-label" else value.split()
            words.update(*map(_furniture_words, names))
            content = content or "main" in names
            if name.lower() == "class":
                kind = value.strip()
    node = Node(tag, kind, not content and (tag in FURNITURE_TAGS or bool(words)))
    if node.furniture and tag not in FURNITURE_TAGS and words.isdisjoint(FOREIGN_WORDS):
        named.append(node)
    return node


def _keep_largest(root: Node, named: list[Node]) -> None:
    """An element that holds most of the page's text is no furniture, unless the page has one ``article`` or ``main`` with text."""
    mains = _mains(root, [])
    if len(mains) == 1 and text_of(mains):
        return
    ids, sizes = set(map(id, named)), {}
    nodes = [root]
    for node in nodes:  # parents before children
        nodes.extend(k for k in node.elements() if not k.furniture or id(k) in ids)
    for node in reversed(nodes):
        sizes[id(node)] = sum(len(k) if type(k) is str else sizes.get(id(k), 0) for k in node.kids)
    for node in named:
        if 2 * sizes.get(id(node), 0) > sizes[id(root)]:
            node.furniture = False


def parse(html: str) -> Node:
    """A tree of elements and texts (character references decoded)."""
    root = Node("#root")
    named: list[Node] = []
    stack, at, n = [root], 0, len(html)
    unclosed: set[str] = set()
    while at < n:
        found = _TAG.search(html, at)
        end = found.start() if found else n
        if end > at and not html[at:end].isspace():
            stack[-1].kids.append(unescape(html[at:end]) if "&" in html[at:end] else html[at:end])
        elif end > at:
            stack[-1].kids.append(" ")
        if not found:
            break
        at = found.end()
        tag = found.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if found.group(1):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in RAW:
            if found.group(3).endswith("/") or tag in unclosed:
                continue
            close = _CLOSE[tag].search(html, at)
            if close:
                at = close.start()
            elif tag in ("script", "style"):
                break
            else:
                unclosed.add(tag)
            continue
        ends = ENDS.get(tag)
        if ends or tag in ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                other = stack[k].tag
                if ends and other in ends or not ends and other == "p":
                    del stack[k:]
                    break
                if other in ("table", "ul", "ol", "dl", "select", "article", "section", "div"):
                    break
        node = _element(tag, found.group(3), named)
        stack[-1].kids.append(node)
        if tag not in VOID and not found.group(3).endswith("/"):
            stack.append(node)
    if named:
        _keep_largest(root, named)
    return root


def blocks(node: Node, out: list[str], line: list[str], template: frozenset[str | int] = frozenset()) -> None:
    """Texts of the blocks below a node, without furniture and template texts (given as texts or their hashes)."""
    open_ = [(iter(node.kids), False)]  # children still to be read, and whether a block ends with them
    while open_:
        kids, block = open_[-1]
        for kid in kids:
            if type(kid) is str:
                if not template or not _among(" ".join(kid.split()), template):
                    line.append(kid)
            elif not kid.furniture:
                inner = kid.tag in BLOCK
                if inner:
                    _end(out, line)
                open_.append((iter(kid.kids), inner))
                break
        else:
            open_.pop()
            if block:
                _end(out, line)


def _among(text: str, template: frozenset[str | int]) -> bool:
    return text in template or text != "" and _hash(text) in template


def _end(out: list[str], line: list[str]) -> None:
    text = " ".join("".join(line).split())
    line.clear()
    if text:
        out.append(text)


def text_of(nodes: list[Node], template: frozenset[str | int] = frozenset()) -> str:
    out: list[str] = []
    for node in nodes:
        line: list[str] = []
        blocks(node, out, line, template)
        _end(out, line)
    return " ".join(out)


def _mains(node: Node, out: list[Node]) -> list[Node]:
    """Outermost ``article`` and ``main`` elements that are not part of furniture, in page order."""
    todo = node.elements()[::-1]
    while todo:
        kid = todo.pop()
        if kid.tag in CONTENT_TAGS:
            out.append(kid)
        elif not kid.furniture:
            todo.extend(reversed(kid.elements()))
    return out


# -- induction -------------------------------------------------------------------------


class Shapes:
    """Numbers for trees of labels: equal trees have equal numbers, and scores of two are found once."""

    def __init__(self):
        self._known: dict[tuple, int] = {}
        self._trees: list[tuple[str, tuple[int, ...]]] = []
        self._size: list[int] = []
        self._scores: dict[tuple[int, int], int] = {}

    def __len__(self) -> int:
        return len(self._trees)

    def of(self, node: Node) -> int:
        nodes = [node]
        for x in nodes:
            nodes.extend(x.elements())
        for x in reversed(nodes):  # children before parents
            tree = (x.label, tuple([k.shape for k in x.elements()]))
            x.shape = self._known.setdefault(tree, len(self._trees))
            if x.shape == len(self._trees):
                self._trees.append(tree)
                self._size.append(1 + sum(self._size[k] for k in tree[1]))
        return node.shape

    def _found(self, p: int, q: int) -> int | None:
        """The score if it is known."""
        if p == q:
            return self._size[p]
        if self._trees[p][0] != self._trees[q][0]:
            return 0
        return self._scores.get((p, q))

    def score(self, p: int, q: int) -> int:
        todo = [(p, q)]
        while todo:
            x, y = todo[-1]
            if self._found(x, y) is None:
                xs, ys = self._trees[x][1], self._trees[y][1]
                head, tail = _ends(xs, ys)
                inner = {(i, j) for i in set(xs[head : len(xs) - tail]) for j in set(ys[head : len(ys) - tail])}
                open_ = [pair for pair in inner if self._found(*pair) is None]
                if open_:
                    todo.extend(open_)
                    continue
                self._scores[x, y] = 1 + sum(self._found(xs[i], ys[j]) or 0 for i, j in self.align(xs, ys))
            todo.pop()
        return self._found(p, q)

    def align(self, xs: Sequence[int], ys: Sequence[int]) -> list[tuple[int, int]]:
        """Places of the best order-preserving alignment; equal shapes at either end go together."""
        least = min(len(xs), len(ys))
        head, tail = _ends(xs, ys)
        out = [(k, k) for k in range(head)]
        if least > head + tail:
            p, ix = np.unique(xs[head : len(xs) - tail], return_inverse=True)
            q, iy = np.unique(ys[head : len(ys) - tail], return_inverse=True)
            weights = np.array([[self.score(x, y) for y in q.tolist()] for x in p.tolist()], dtype=np.int64)
            _best(weights, ix, iy, head, head, out)
        return out + [(len(xs) - k, len(ys) - k) for k in range(tail, 0, -1)]


def _ends(xs: Sequence[int], ys: Sequence[int]) -> tuple[int, int]:
    """How many shapes agree at the beginning, and how many of the rest at the end."""
    least = min(len(xs), len(ys))
    head = next((k for k in range(least) if xs[k] != ys[k]), least)
    return head, next((k for k in range(least - head) if xs[-1 - k] != ys[-1 - k]), least - head)


def _rows(weights: np.ndarray, ix: np.ndarray, iy: np.ndarray) -> Iterator[np.ndarray]:
    """Best scores of the first 0, 1, .. children of one node with the first j of another."""
    row = np.zeros(len(iy) + 1, dtype=np.int64)
    yield row
    for i in ix:
        row = np.concatenate([row[:1], np.maximum.accumulate(np.maximum(row[1:], row[:-1] + weights[i][iy]))])
        yield row


def _best(weights: np.ndarray, ix: np.ndarray, iy: np.ndarray, x: int, y: int, out: list[tuple[int, int]]) -> None:
    """Append the aligned places; a table above ``CELLS`` is halved (Hirschberg), so memory is bounded."""
    if not len(ix) or not len(iy):
        return
    if len(ix) > 1 and len(ix) * len(iy) > CELLS:
        half = len(ix) // 2
        for up in _rows(weights, ix[:half], iy):
            pass
        for down in _rows(weights, ix[:half - 1 : -1], iy[::-1]):
            pass
        cut = int(np.argmax(up + down[::-1]))
        _best(weights, ix[:half], iy[:cut], x, y, out)
        _best(weights, ix[half:], iy[cut:], x + half, y + cut, out)
        return
    score = list(_rows(weights, ix, iy))
    found, i, j = [], len(ix), len(iy)
    while i and j:
        own = weights[ix[i - 1], iy[j - 1]]
        if own and score[i][j] == score[i - 1][j - 1] + own:
            i, j = i - 1, j - 1
            found.append((x + i, y + j))
        elif score[i][j] == score[i - 1][j]:
            i -= 1
        else:
            j -= 1
    out.extend(reversed(found))


def match(a: Node, b: Node, pairs: list[tuple[Node, Node]] | None = None, shapes: Shapes | None = None) -> int:
    """Simple tree matching: the greatest number of equally labelled nodes in an order-preserving alignment.

    ``pairs`` receives the aligned nodes.
    """
    shapes = Shapes() if shapes is None else shapes
    score = shapes.score(shapes.of(a), shapes.of(b))
    if pairs is not None and score:
        todo = [(a, b)]
        for x, y in todo:
            pairs.append((x, y))
            xs, ys = x.elements(), y.elements()
            todo.extend((xs[i], ys[j]) for i, j in shapes.align([k.shape for k in xs], [k.shape for k in ys]))
    return score


def _texts(node: Node) -> list[str]:
    return [" ".join(k.split()) for k in node.kids if type(k) is str and not k.isspace()]


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def places(root: Node) -> list[tuple[Node, int]]:
    """The nodes outside furniture, each with a hash of its label path."""
    out, known = [(root, 0)], {}
    for node, path in out:
        for kid in node.kids:
            if type(kid) is Node and not kid.furniture:
                step = (path, kid.label)
                if step not in known:
                    known[step] = _hash(f"{path}/{kid.label}")
                out.append((kid, known[step]))
    return out


def layout_of(found: list[tuple[Node, int]]) -> int:
    """A page's layout (never 0), from its places."""
    return _hash(str(sorted({path for node, path in found if node.tag in LAYOUT_TAGS}))) or 1


def profile(root: Node) -> tuple[int, int, list[tuple[int, int]], str]:
    """Layout, frame, texts and outline of a page.

    The frame is a hash of the containers that a path can lead through; the texts are
    the different ones as (hash of the label path, hash of the text).  The outline
    (JSON) has the nodes outside furniture, parents first: the labels that occur, then
    for every node the label's number, the parent, how many equally labelled siblings
    stand before it and whether it can be on a path (2: only as its end); for every
    text the node, the place among the texts and the characters.
    """
    found = places(root)
    number = {id(node): k for k, (node, _) in enumerate(found)}
    names: dict[str, int] = {}
    label, up, skip, role, frame = [], [0] * len(found), [0] * len(found), [], {0: 0}
    for k, (node, _) in enumerate(found):
        name = node.label
        label.append(names.setdefault(name, len(names)))
        role.append(2 if node.tag in CONTENT_TAGS else int(node.tag in BLOCK and node.tag not in ("p", "li", "td")))
        if k and role[k] and up[k] in frame:
            frame[k] = _hash(f"{frame[up[k]]}/{skip[k]}/{name}")
        before: Counter = Counter()
        for kid in node.elements():
            if not kid.furniture:
                up[number[id(kid)]], skip[number[id(kid)]] = k, before[kid.label]
            before[kid.label] += 1
    texts = [(path, _hash(t), k, len(t)) for k, (node, path) in enumerate(found) for t in _texts(node)]
    different = sorted({t[:2] for t in texts})
    at = {pair: k for k, pair in enumerate(different)}
    outline = [list(names), label, up, skip, role, [t[2] for t in texts], [at[t[:2]] for t in texts], [t[3] for t in texts]]
    return layout_of(found), _hash(str(sorted(frame.values()))), different, json.dumps(outline, ensure_ascii=False, separators=(",", ":"))


def _follow(root: Node, path: list) -> Node | None:
    node = root
    for label, skip in path:
        same = [k for k in node.elements() if k.label == label]
        if len(same) <= skip:
            return None
        node = same[skip]
    return node


class Reference:
    """The page that the nodes of a group are named by, and the group's template texts."""

    def __init__(self, outline: str, common: set[tuple[int, int]]):
        self.names, self.label, self.up, self.skip, *_ = json.loads(outline)
        self.common = common
        self.nodes = _tree(self.names, self.label, self.up)
        self.number = {id(node): k for k, node in enumerate(self.nodes)}

    def votes(self, outline: str, texts: list[tuple[int, int]], shapes: Shapes) -> tuple[list[int], set[tuple[int, int]]]:
        """A page's votes: the nodes that hold most of its varying text, from the root on, and its template texts by the last of them."""
        names, label, up, _, role, *places_ = json.loads(outline)
        nodes = _tree(names, label, up)
        varying = [0] * len(nodes)
        for k, text, chars in zip(*places_):
            if texts[text] not in self.common:
                varying[k] += chars
        for k in range(len(nodes) - 1, 0, -1):
            varying[up[k]] += varying[k]
        pairs: list[tuple[Node, Node]] = []
        match(self.nodes[0], nodes[0], pairs, shapes)
        aligned = {id(own): self.number[id(node)] for node, own in pairs}
        chain, inside = {0: 0}, [0] * len(nodes)
        for k in range(1, len(nodes)):  # parents before children
            if role[k] and up[k] in chain and role[up[k]] != 2 and 2 * varying[k] > varying[up[k]] and id(nodes[k]) in aligned:
                chain[k] = aligned[id(nodes[k])]
            inside[k] = chain.get(k, inside[up[k]])
        return list(chain.values())[1:], {(inside[k], texts[text][1]) for k, text, _ in zip(*places_) if texts[text] in self.common}

    def wrapper(self, pages: int, votes: dict[int, int], template: set[tuple[int, int]]) -> dict | None:
        """The path that more than half of the pages vote for and the hashes of the template texts below it; None without a path."""
        chain = [k for k in sorted(votes) if 2 * votes[k] > pages]
        if not chain:
            return None
        below = [False] * len(self.up)
        for k in range(chain[-1], len(below)):
            below[k] = k == chain[-1] or below[self.up[k]]
        return {"path": [[self.names[self.label[k]], self.skip[k]] for k in chain], "template": sorted({t for k, t in template if below[k]})}


def _tree(names: list[str], label: list[int], up: list[int]) -> list[Node]:
    nodes = [Node(names[k]) for k in label]
    for node, parent in zip(nodes[1:], up[1:]):
        nodes[parent].kids.append(node)
    return nodes


def induce(pages: list[str], least: int = 4, share: float = 0.9) -> dict | None:
    """The wrapper of some pages: ``path`` to the content slot and ``template`` texts in it; None if pages are too few.

    What :func:`wrappers` does for a group of a table.
    """
    different: dict[tuple, tuple[str, int, int]] = {}
    known: dict[int, str] = {}
    for html in pages:
        tree = parse(html)
        layout, frame, texts, outline = profile(tree)
        if texts:  # pages that agree in all their texts are copies
            different[tuple(texts)] = min(different.get(tuple(texts), (outline, frame, layout)), (outline, frame, layout))
            known |= {_hash(t): t for node, _ in places(tree) for t in _texts(node)}
    if len(different) < least:
        return None
    times = Counter(text for texts in different for text in texts)
    common = {text for text, n in times.items() if n >= max(least, share * len(different))}
    layouts, frames = Counter(x[2] for x in different.values()), Counter(x[1:] for x in different.values())
    first = min(different.values(), key=lambda x: (-layouts[x[2]], x[2], -frames[x[1:]], len(x[0]), x))
    reference, shapes = Reference(first[0], common), Shapes()
    votes: Counter = Counter()
    template = set()
    for texts, (outline, *_) in different.items():
        chain, found = reference.votes(outline, list(texts), shapes)
        votes.update(chain)
        template |= found
    wrapper = reference.wrapper(len(different), votes, template)
    return wrapper and {**wrapper, "template": sorted(known[t] for t in wrapper["template"])}


def read(html: str | None, wrapper: dict | None) -> str:
    """The main text of a page."""
    if not html:
        return ""
    root = parse(html)
    if wrapper:
        node = _follow(root, wrapper["path"])
        if node is not None:
            text = text_of([node], frozenset(wrapper["template"]))
            if text:
                return text
    return text_of(_mains(root, []) or [root])


def host(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def profiles(pages: DataFrame) -> DataFrame:
    """``host, layout, frame, texts, outline`` of the pages that hold text, by :func:`profile`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "html"):
            found = [profile(parse(html)) for html in chunk.column("html").to_pylist()]
            layout, frame = (pa.array([x[k] for x in found], pa.int64()) for k in (0, 1))
            texts = pa.array([[{"path": a, "text": b} for a, b in x[2]] for x in found], pa.list_(pa.struct({"path": pa.int64(), "text": pa.int64()})))
            columns = [chunk.column("host"), layout, frame, texts, pa.array([x[3] for x in found], pa.string())]
            yield pa.record_batch(columns, ["host", "layout", "frame", "texts", "outline"])

    given = pages.where("html IS NOT NULL").select("host", "html")
    made = given.mapInArrow(run, "host string, layout long, frame long, texts array<struct<path:long,text:long>>, outline string")
    return made.where("size(texts) > 0")


#: Trees of labels that a task keeps the scores of.
TREES = 50_000


def _loaded(reference: str) -> Reference:
    given = json.loads(reference)
    return Reference(given["outline"], {(x["path"], x["text"]) for x in given.get("common", ())})


def wrappers(pages: DataFrame, least: int = 4, share: float = 0.9) -> DataFrame:
    """``host, layout, wrapper`` (JSON) of every layout of a host with enough different pages; layout 0 is all of them.

    Template texts are counted over all pages, and all pages are aligned and vote for the path.
    """
    found = profiles(pages.select(host(F.col("url")).alias("host"), "html")).withColumn("digest", F.xxhash64("texts"))
    copies = found.groupBy("host", "layout", "digest").agg(F.min(F.struct("outline", "frame")).alias("page"), F.first("texts").alias("texts"))
    different = copies.select("host", "layout", "digest", "page.*", "texts", F.length("page.outline").alias("size"))
    different = written(different, "different-pages")
    group = ["host", "layout"]

    # The reference: of the most frequent layout and, in it, frame the shortest outline.
    exploded = different.withColumn("kind", F.col("layout")).withColumn("layout", F.explode(F.array("layout", F.lit(0).cast("long"))))
    frames = exploded.groupBy(*group, "kind", "frame").agg(F.count("*").alias("n"), F.min(F.struct("size", "digest")).alias("page"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("page.size").alias("size"), "frame", F.col("page.digest").alias("digest")))
    kinds = frames.groupBy(*group, "kind").agg(F.sum("n").alias("n"), best.alias("page"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "kind", F.col("page.digest").alias("digest")))
    totals = kinds.groupBy(*group).agg(F.sum("n").alias("pages"), best.alias("page")).where(F.col("pages") >= least)
    totals = written(totals.select(*group, "pages", "page.kind", "page.digest"), "layouts")

    texts = exploded.select(*group, F.explode("texts").alias("at")).groupBy(*group, "at.path", "at.text").agg(F.count("*").alias("times"))
    common = texts.where(F.col("times") >= least).join(totals, group).where(F.col("times") >= share * F.col("pages"))
    common = common.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("path", "text"))).alias("common"))
    outlines = different.select("host", F.col("layout").alias("kind"), "digest", "outline")
    references = totals.join(outlines, ["host", "kind", "digest"]).join(common, group, "left")
    # Written, so that the planner knows their size: pages are shuffled only if references are many.
    references = written(references.select(*group, "pages", F.to_json(F.struct("outline", "common")).alias("reference")), "references")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes, known = Shapes(), {}
        for chunk in chunks(batches, "outline"):
            sums: Counter = Counter()
            for row in range(chunk.num_rows):
                host, layout, texts, outline, *given = (c[row].as_py() for c in chunk.columns)
                texts = [(x["path"], x["text"]) for x in texts]
                own = None
                for which, reference in zip((layout, 0), given):
                    if reference is None:
                        continue
                    if len(shapes) > TREES or len(known) > 1000:
                        shapes, known = Shapes(), {}
                    if reference not in known:
                        known[reference] = _loaded(reference)
                    if own is None or reference != given[0]:
                        own = known[reference].votes(outline, texts, shapes)
                    sums.update((host, which, node, None) for node in own[0])
                    sums.update((host, which, node, text) for node, text in own[1])
            keys = list(zip(*sums)) or [()] * 4
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64())
            columns = [pa.array(x, kind) for x, kind in zip(keys, kinds)] + [pa.array(sums.values(), pa.int64())]
            yield pa.record_batch(columns, ["host", "layout", "node", "text", "times"])

    own = references.select(*group, F.col("reference").alias("own"))
    every = references.where("layout = 0").select("host", F.col("reference").alias("every"))
    aligned = different.join(own, group, "left").join(every, "host", "left").select(*group, "texts", "outline", "own", "every")
    votes = aligned.mapInArrow(align, "host string, layout long, node int, text long, times long")
    votes = votes.groupBy(*group, "node", "text").agg(F.sum("times").alias("times"))

    def learn(table: pa.Table, counted: pa.Table) -> pa.Table:
        out = []
        for at in table.to_pylist():
            rows = [tuple(x) for x in zip(*(counted.column(c).to_pylist() for c in ("node", "text", "times")))]
            chain, template = {n: k for n, t, k in rows if t is None}, {(n, t) for n, t, _ in rows if t is not None}
            wrapper = _loaded(at["reference"]).wrapper(at["pages"], chain, template)
            if wrapper is not None:
                out.append((at["host"], at["layout"], json.dumps(wrapper, ensure_ascii=False)))
        columns = list(zip(*out)) or [()] * 3
        return pa.table([pa.array(x, kind) for x, kind in zip(columns, (pa.string(), pa.int64(), pa.string()))], ["host", "layout", "wrapper"])

    return references.groupBy(*group).cogroup(votes.groupBy(*group)).applyInArrow(learn, "host string, layout long, wrapper string")


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages`` (page_id, url, html).

    The wrappers are written first: a table the planner finds small goes to the pages
    as a broadcast, a larger one is joined with a shuffle whose hot hosts can be split.
    """
    ship(pages.sparkSession)
    pages = pages.select("page_id", "url", "html")
    learned = written(wrappers(pages), "wrappers").withColumnsRenamed({"host": "_host", "layout": "_layout"})

    def layouts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "html"):
            found = [layout_of(places(parse(html))) if html else 0 for html in chunk.column("html").to_pylist()]
            yield pa.record_batch([*chunk.columns, pa.array(found, pa.int64())], [*chunk.schema.names, "layout"])

    keyed = pages.withColumn("host", host(F.col("url")))
    keyed = keyed.mapInArrow(layouts, "page_id long, url string, html string, host string, layout long")
    own = (F.col("host") == F.col("_host")) & (F.col("layout") == F.col("_layout"))
    joined = keyed.join(learned.where("_layout <> 0"), own, "left").drop("_host", "_layout")
    any_layout = learned.where("_layout = 0").select("_host", F.col("wrapper").alias("_any"))
    joined = joined.join(any_layout, F.col("host") == F.col("_host"), "left")
    joined = joined.select("page_id", "url", "html", F.coalesce("wrapper", "_any").alias("wrapper"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, dict | None] = {None: None}
        for chunk in chunks(batches, "html"):
            texts = []
            for html, wrapper in zip(chunk.column("html").to_pylist(), chunk.column("wrapper").to_pylist()):
                if wrapper not in known:
                    if len(known) > 1000:
                        known = {None: None}
                    known[wrapper] = json.loads(wrapper)
                texts.append(read(html, known[wrapper]))
            yield pa.record_batch([chunk.column("page_id"), chunk.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    read_pages = joined.mapInArrow(run, "page_id long, url string, text string")
    return read_pages.withColumn("n_chars", F.char_length("text").cast("long"))
