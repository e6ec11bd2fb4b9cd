"""Main text of web pages by wrapper induction.

For each host one page is the pivot (that of the smallest hash of its id). Every page's DOM tree is
aligned with its host's pivot by simple tree matching: two nodes match when their labels are equal,
and their children are matched in order so that most nodes match. Over all pages of a host it is
counted for each pivot node how many pages match it and how many have the same text there. Nodes that
are nearly always the same become the host's template; what varies is a slot. A page's text is that
of its slots, without elements that are menus, headers, footers, sidebars, forms and the like by their
tag or role, or whose class or id says so as a whole; where a page marks its article, the slots inside
it count, elsewhere those that aren't mostly links.

Child lists of any length are matched exactly: equal heads and tails are taken off, and what is left is
matched in linear space by halves. Elements may be nested to any depth.

Counts are summed in each task before the shuffle, so one very large host is no different from many.
Pivots and templates go to the workers once while they are small (their size is checked); beyond that they are joined
to the pages by host and a salt, so that a host with a third of all pages is spread too.

Defined cases: null or empty html gives an empty text; a null url, or a host with fewer than
least_pages pages or whose pages hardly differ, has no template and is judged by marks alone;
repeated rows each count and are extracted alike; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import html as entities
import re
import sys
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import slices
from millrace.session import materialize

LEAST_PAGES, CONSTANT_SHARE, MOST_CONSTANT = 8, 0.9, 0.9
#: Pivots and templates are sent to all workers up to so many characters in all; beyond that they are joined under so many salts.
BROADCAST_CHARS, SALTS = 16_000_000, 32
#: Child lists up to this product are matched in one table, longer ones by halves.
PRODUCT = 40_000
#: Outside of marked articles, a block with this share of its text in links, at least so many, is a menu.
LINK_SHARE, LEAST_LINKS = 0.6, 3

# Element names of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
SCOPE = set("table ul ol dl article section div body html nav aside footer header main form td th".split())
#: What isn't main text, by element, by role and by words of class and id.
DROPPED = set("nav footer aside form script style noscript template iframe svg button select textarea dialog head object canvas menu".split())
DROPPED_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words that mark what isn't main text when a class or id consists of them and of words of place and form only; the second ones need one of those.
DROPPED_WORDS = set(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot banner sponsor sponsored promo cookie cookies consent gdpr notice notices "
    "sidebar nav navbar navigation breadcrumb breadcrumbs footer masthead topbar menu comment comments commentlist disqus replies newsletter popup modal toolbar pagination pager".split()
)
WEAK_WORDS = set("share sharing social related recommended subscribe subscription login signup register search skip promotion widget overlay alert notification reply".split())
PLACE_WORDS = set("site page main global primary secondary top bottom left right inner outer box bar block banner links link list lists items item button buttons icons form forms wrapper wrap container area section panel posts articles stories thread text content header popup".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)""", re.S)
#: One attribute after another, each with its whole name; what stands in quotes is a value.
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?|"[^"]*"|'[^']*'""")
_NAMED = {"class", "id", "role"}
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _marks(name: str) -> bool:
    """Whether a class or id as a whole says that its element isn't main text: ad, site-footer, shareButtons; not share-price."""
    words = {x.lower() for x in _NAME.findall(name)}
    if not words <= DROPPED_WORDS | WEAK_WORDS | PLACE_WORDS:
        return False
    return bool(words & DROPPED_WORDS or words & WEAK_WORDS and words & PLACE_WORDS)


class Node:
    """An element; parts: its texts and elements in page order."""

    __slots__ = ("tag", "label", "parts", "dropped", "main", "index", "constant", "kids", "text", "whole", "menu", "heading")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.parts, self.index, self.constant, self.kids, self.text, self.whole = tag, [], -1, False, [], "", 0
        self.menu = self.heading = False
        found: dict[str, str] = {}
        if "=" in attributes:
            for m in _ATTRIBUTE.finditer(attributes):
                if m[1] and (name := m[1].lower()) in _NAMED:
                    found.setdefault(name, m[2] or m[3] or m[4] or "")
        self.label = f"{tag}.{found['class']}" if "class" in found else tag
        names = f"{found.get('class', '')} {found.get('id', '')}".split()
        self.dropped = tag in DROPPED or found.get("role", "").lower() in DROPPED_ROLES or (tag not in ("body", "html") and any(map(_marks, names)))
        self.main = not self.dropped and (tag in ("article", "main") or found.get("role", "").lower() == "main")

    @property
    def children(self) -> list[Node]:
        return [x for x in self.parts if isinstance(x, Node)]

    @property
    def own_text(self) -> str:
        return _SPACE.sub(" ", "".join(x for x in self.parts if isinstance(x, str))).strip()


def parse(page: str) -> Node:
    """A tree of any input: unknown ends are ignored, open elements are closed where HTML implies it."""
    root = Node("html")
    stack, deepest = [root], 0
    opened = Counter()
    at = 0

    def close(k: int) -> None:
        opened.subtract(x.tag for x in stack[k:])
        del stack[k:]

    def text(a: int, b: int) -> None:
        if b > a:
            stack[-1].parts.append(entities.unescape(page[a:b]))

    while m := _TAG.search(page, at):
        text(at, m.start())
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag in ("html", "body") or not opened[tag]:
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
                if stack[k].tag in SCOPE and tag not in BLOCK:
                    break
            continue
        if tag == "html" or tag == "body" and opened["body"]:
            continue
        if tag == "body":
            close(1)
        closes = CLOSES.get(tag) or ({"p"} if tag in BLOCK else None)
        if closes and any(opened[x] for x in closes):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in closes:
                    close(k)
                    break
                if stack[k].tag in SCOPE and stack[k].tag not in closes:
                    break
        node = Node(tag, m[3] or m[6] or "")
        stack[-1].parts.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            if tag in ("title", "textarea"):
                node.parts.append(entities.unescape(page[at : end.start() if end else len(page)]))
            at = end.end() if end else len(page)
        elif tag not in VOID:
            stack.append(node)
            opened[tag] += 1
            deepest = max(deepest, len(stack))
    text(at, len(page))
    if 4 * deepest + 1000 > sys.getrecursionlimit():  # the walks below call themselves once or twice a level, and only Python frames
        sys.setrecursionlimit(4 * deepest + 1000)
    return root


def number(root: Node) -> list[Node]:
    """All nodes in page order, numbered, with their children, own texts and a hash of all below them at hand for matching."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        node.index, node.kids, node.text = len(out), node.children, node.own_text
        out.append(node)
        todo += reversed(node.kids)
    for node in reversed(out):
        node.whole = hash((node.label, node.text, *[k.whole for k in node.kids]))
    return out


def _equal(a: Node, b: Node) -> bool:
    """Whether two numbered trees are alike in labels, texts and shape."""
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        if x.whole != y.whole or x.label != y.label or x.text != y.text or len(x.kids) != len(y.kids):
            return False
        todo += zip(x.kids, y.kids, strict=True)
    return True


def _all_pairs(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """The pairs of two equal trees."""
    out, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        out.append((x, y))
        todo += reversed(list(zip(x.kids, y.kids, strict=True)))
    return out


def pairs_of(found: list) -> Iterator[tuple[Node, Node]]:
    """The pairs in nested lists of them, in order."""
    todo = [found]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            yield x
        else:
            todo += reversed(x)


def match(a: Node, b: Node) -> tuple[float, list]:
    """Simple tree matching of numbered trees: the most matched nodes, and the pairs in nested lists; equal own text weighs a little more."""
    if a.label != b.label:
        return 0.0, []
    score, pairs = (1.5 if a.text == b.text else 1.0), [(a, b)]
    if not a.kids or not b.kids:
        return score, pairs
    more, rest = _match_lists(a.kids, b.kids)
    return score + more, [*pairs, rest]


def _match_lists(left: list[Node], right: list[Node]) -> tuple[float, list]:
    """The best matching in order of two lists of trees. Equal trees at both heads, or both tails, belong together in some best one."""
    head, tail = 0, 0
    while head < min(len(left), len(right)) and _equal(left[head], right[head]):
        head += 1
    while tail < min(len(left), len(right)) - head and _equal(left[-1 - tail], right[-1 - tail]):
        tail += 1
    pairs = [p for k in range(head) for p in _all_pairs(left[k], right[k])]
    after = [p for k in range(tail, 0, -1) for p in _all_pairs(left[-k], right[-k])]
    score = 1.5 * (len(pairs) + len(after))
    left, right = left[head : len(left) - tail], right[head : len(right) - tail]
    if left and right:
        more, middle = (_by_table if len(left) * len(right) <= PRODUCT or len(left) == 1 else _by_halves)(left, right)
        score, pairs = score + more, [*pairs, middle]
    return score, [pairs, after]


def _by_table(left: list[Node], right: list[Node]) -> tuple[float, list]:
    sub: dict[tuple[int, int], tuple] = {}
    columns = [(j, y, y.label, y.text, not y.kids) for j, y in enumerate(right)]
    above = [0.0] * (len(right) + 1)
    best = [above]
    for i, x in enumerate(left):
        label, text, leaf, last, row = x.label, x.text, not x.kids, 0.0, [0.0]
        for j, y, its_label, its_text, its_leaf in columns:
            top = above[j + 1]
            if last > top:
                top = last
            if label == its_label:
                if leaf or its_leaf:
                    s = 1.5 if text == its_text else 1.0
                else:
                    sub[i, j] = found = match(x, y)
                    s = found[0]
                if above[j] + s > top:
                    top = above[j] + s
            row.append(top)
            last = top
        best.append(row)
        above = row
    i, j, chosen = len(left), len(right), []
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            chosen.append(sub[i, j][1] if (i, j) in sub else (left[i], right[j]))
    return best[-1][-1], chosen[::-1]


def _last_row(left: list[Node], right: list[Node]) -> np.ndarray:
    """The best scores of the whole left list with every beginning of the right one."""
    labels = {x.label: k for k, x in enumerate(right)}
    texts = {x.text: k for k, x in enumerate(right)}
    its_label, its_text = np.array([labels[y.label] for y in right]), np.array([texts[y.text] for y in right])
    its_leaf = np.array([not y.kids for y in right])
    row = np.zeros(len(right) + 1)
    for x in left:
        same = its_label == labels.get(x.label, -1)
        gain = np.where(same, np.where(its_text == texts.get(x.text, -1), 1.5, 1.0), 0.0)
        if x.kids:
            for j in np.flatnonzero(same & ~its_leaf):
                gain[j] = match(x, right[j])[0]
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + gain))
    return row


def _by_halves(left: list[Node], right: list[Node]) -> tuple[float, list]:
    """As _by_table in linear space: where the best way crosses the middle of the left list, both lists are cut."""
    half = len(left) // 2
    before, behind = _last_row(left[:half], right), _last_row(left[half:][::-1], right[::-1])[::-1]
    cut = int(np.argmax(before + behind))
    score, pairs = 0.0, []
    for part, other in ((left[:half], right[:cut]), (left[half:], right[cut:])):
        if part and other:
            more, found = _match_lists(part, other)
            score, pairs = score + more, [pairs, found]
    return score, pairs


def _weigh(root: Node) -> None:
    """Marks elements most of whose text stands in links, several of them, and those with a heading, all in one walk from below."""
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += x.children
    sums: dict[int, tuple[int, int, int]] = {}
    for x in reversed(order):
        links, total, linked = int(x.tag == "a"), sum(len(t.strip()) for t in x.parts if isinstance(t, str)), 0
        x.heading = x.tag in ("h1", "h2")
        for k in x.children:
            more, text, inside = sums.pop(id(k))
            links, total, linked, x.heading = links + more, total + text, linked + inside, x.heading or k.heading
        if x.tag == "a":
            linked = total
        sums[id(x)] = links, total, linked
        x.menu = links >= LEAST_LINKS and linked > LINK_SHARE * total


def _blocks(node: Node, out: list[list[str]], inside_main: bool) -> None:
    """Appends the texts of node to the last block of out, and begins new blocks at block elements."""
    if node.dropped or (node.tag == "header" and not (inside_main and node.heading)):
        return
    block = node.tag in BLOCK
    if block and not inside_main and node.tag in ("ul", "ol", "div", "section", "table", "p", "dl") and node.menu:
        return
    if block and out[-1]:
        out.append([])
    if node.tag in ("br", "td", "th", "img"):
        out[-1].append(" ")
    for part in node.parts:
        if isinstance(part, Node):
            _blocks(part, out, inside_main)
        elif not node.constant:
            out[-1].append(part)
    if block and out[-1]:
        out.append([])


def _mains(root: Node) -> list[Node]:
    """The outermost articles, those inside a <main> rather than it, in page order."""
    out: list[Node] = []

    def walk(node: Node) -> None:
        if node.dropped:
            return
        before = len(out)
        if node.tag == "main" or not node.main:
            for x in node.children:
                walk(x)
        if node.main and len(out) == before:
            out.append(node)

    walk(root)
    return out


def main_text(root: Node) -> str:
    """Text of the slots: those in the page's articles, if it has any, else all that aren't mostly links."""
    mains = _mains(root)
    _weigh(root)
    out: list[list[str]] = [[]]
    for node in mains or [root]:
        _blocks(node, out, bool(mains))
    lines = [_SPACE.sub(" ", "".join(b)).strip() for b in out]
    return "\n".join(x for x in lines if x)


def host_of(url):
    """The host of a url column, in lower case, null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def _with_hosts(pages: DataFrame, per_host: DataFrame, columns: list[str]) -> DataFrame:
    """Pages with the columns of their host, under salts, so that no host is one task."""
    salts = per_host.select("host", *columns, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = pages.withColumn("salt", F.pmod(F.xxhash64("html", F.rand(0)), F.lit(SALTS)).cast("int"))
    return salted.join(salts, ["host", "salt"], "left").drop("salt")


class Wrappers:
    """Pivots by host, each parsed once; from rows of the same host and pivot it learns them as they come."""

    def __init__(self, known: dict[str, tuple[str, list[int] | None]] | None = None):
        self.known, self.trees = known, {}

    def __getstate__(self):
        return {"known": self.known, "trees": {}}

    def of(self, host: str | None, pivot: str | None = None, constant: list[int] | None = None) -> Node | None:
        if self.known is not None:
            pivot, constant = self.known.get(host, (None, None))
        if host is None or pivot is None:
            return None
        if host not in self.trees:
            if len(self.trees) >= 256:
                self.trees.clear()
            self.trees[host] = parse(pivot)
            nodes = number(self.trees[host])
            for k in constant or ():
                nodes[k].constant = True
        return self.trees[host]


def _rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
    for batch in batches:
        for part in slices(batch, "html"):
            yield part, list(zip(*(part.column(c).to_pylist() if c in part.schema.names else [None] * part.num_rows for c in columns), strict=True))


def _counter(known: Wrappers | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """host, pivot node, pages that match it, pages with the same text: summed over each slice."""
        wrappers = known or Wrappers()
        for _, rows in _rows(batches, "host", "html", "pivot"):
            seen: dict[tuple, list[int]] = defaultdict(lambda: [0, 0])
            for host, page, pivot in rows:
                tree = wrappers.of(host, pivot)
                if tree is None:
                    continue
                root = parse(page or "")
                number(root)
                for a, b in pairs_of(match(tree, root)[1]):
                    entry = seen[host, a.index]
                    entry[0] += 1
                    entry[1] += a.text == b.text and bool(a.text)
            keys = list(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([seen[k][0] for k in keys], pa.int64()), pa.array([seen[k][1] for k in keys], pa.int64())],
                names=["host", "node", "matched", "same"],
            )

    return run


def _extractor(known: Wrappers | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrappers = known or Wrappers()
        for part, rows in _rows(batches, "host", "html", "pivot", "constant"):
            texts = []
            for host, page, pivot, constant in rows:
                root = parse(page or "")
                if tree := wrappers.of(host, pivot, constant):
                    number(root)
                    for a, b in pairs_of(match(tree, root)[1]):
                        b.constant = a.constant and a.text == b.text
                texts.append(main_text(root))
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


_COUNTS = "host string, node int, matched long, same long"


def extract_main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    least_pages: int = LEAST_PAGES, constant_share: float = CONSTANT_SHARE, most_constant: float = MOST_CONSTANT,
) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    A host of fewer than least_pages pages has no template; a node is constant where constant_share of the host's
    pages have its text; a host with more than most_constant of its texts constant has none either, as its pages hardly differ.
    """
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    order = F.struct(F.xxhash64("page_id", "url").alias("k"), F.coalesce("html", F.lit("")).alias("html"))
    pivots = materialize(own.where("host is not null").groupBy("host").agg(F.min(order)["html"].alias("pivot"), F.count(F.lit(1)).alias("pages")), "pivots")
    usable = pivots.where(F.col("pages") >= least_pages).select("host", "pivot")
    small = (usable.agg(F.sum(F.char_length("pivot"))).first()[0] or 0) <= BROADCAST_CHARS
    hosted = own.select("host", "html").where("host is not null")
    if small:
        known = Wrappers({r["host"]: (r["pivot"], None) for r in usable.collect()})
        counted = hosted.mapInArrow(_counter(known), _COUNTS)
    else:
        counted = _with_hosts(hosted, usable, ["pivot"]).mapInArrow(_counter(None), _COUNTS)
    counts = counted.groupBy("host", "node").agg(F.sum("matched").alias("matched"), F.sum("same").alias("same"))
    fixed = (F.col("same") >= constant_share * F.col("pages")) & (F.col("same") > 0)
    templates = (
        counts.join(pivots.select("host", "pages"), "host")
        .groupBy("host")
        .agg(F.collect_list(F.when(fixed, F.col("node"))).alias("constant"), F.count_if(F.col("same") > 0).alias("texts"))
        .where((F.size("constant") > 0) & (F.size("constant") <= most_constant * F.col("texts")))
        .select("host", F.array_sort("constant").alias("constant"))
    )
    templates = materialize(usable.join(templates, "host"), "templates")
    rows, schema = own.select("page_id", "url", "host", "html"), "page_id long, url string, text string, n_chars long"
    if small:  # no larger than the pivots, whose size is known
        known = Wrappers({r["host"]: (r["pivot"], r["constant"]) for r in templates.collect()})
        return rows.mapInArrow(_extractor(known), schema)
    return _with_hosts(rows, templates, ["pivot", "constant"]).mapInArrow(_extractor(None), schema)
