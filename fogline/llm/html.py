"""HTML extraction by wrapper induction over the pages of a host.

Pages of one host are aligned by simple tree matching: the block elements of a page form an ordered tree, and two
trees are matched top-down by the order-preserving pairing of children that matches most nodes (a text that is equal on
both sides counts twice). Every page is matched with up to three pages of its host. A leaf of an exemplar that has the
same text in nearly all pages matched with it is template; leaves that vary are slots, and their text is content.
Evidence comes from all different pages of the host. Where two pages have most blocks of their article or main
elements in common, and most of the text there, they are copies of one article, and say nothing about the template in
it.

Page chrome that varies from page to page (menus, adverts, comments) fills slots as well. It is told apart by its
element, its role, or a class or id made up of chrome words only (`share-price` is none, `share-buttons` is). Where
article or main elements hold half of the other text or more, they are the content; else all slots are but link lists.

Plan. The exemplars of a host are the pages with the least, the greatest and another least hash, found on hashes alone.
Up to BROADCAST bytes of exemplars are broadcast, and pages are not shuffled; beyond it, pages are dealt by host, hot
hosts in parts, each part led by its exemplars. A task holds one page, and the exemplars of the last HOSTS hosts, at a
time. One pass writes every page's leaves and two bit sets over the exemplars' leaves (matched; equal); the bit sets
of different pages are summed by host in partial sums, and the template leaves are dropped in a join by host.

Defined cases: a null or empty html has an empty text; pages without a host form a group; repeated pages are judged
like any other and count once as evidence; a host with too few different pages has no template and is left to elements
and roles; a page may be as long, deep or wide as memory allows (the time of a match grows with the product of two
lists of children, its memory with the longer one times the root of the other); page_id and url may be null or
repeated; columns other than page_id, url and html are not used.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: Exemplars are broadcast up to so many bytes.
BROADCAST = 16 << 20
#: Hosts whose parsed exemplars a task keeps.
HOSTS = 16
#: A leaf is template if so many pages at least, and this share of the pages it is matched in, have the same text.
SUPPORT, SHARE = 3, 0.8
#: Pages that share more than this part of the blocks of their article or main elements, and of the text in them, are copies.
COPIES = 0.5
#: Up to so many pairs of children are summed without numpy; the sums are the same.
FEW = 400

# Elements by what they do.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math xmp noframes canvas object audio video".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th", "thead", "tbody"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPES = frozenset("ul ol dl table select body html article section main".split())
CHROME = frozenset("aside dialog footer form menu nav search select option fieldset".split())
CHROME_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
# Words of class names and ids that name chrome, and words that say nothing beside them.
CHROME_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments reply replies disqus footer masthead toolbar pagination pager copyright skip widget widgets teaser teasers".split())
PLAIN_WORDS = frozenset("a and area bar block bottom box btn button buttons class col column container content desktop first form global group header holder icon icons in inner item items js last layer left link links list main mid mobile of off outer panel post posts primary reader row section secondary site slot small stories sub text the thread to top unit up user visitor wrap wrapper right page pages article articles our us".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[^\W\d_A-Za-z]+")


@dataclass(eq=False, slots=True)
class Node:
    tag: str
    chrome: bool = False
    main: bool = False
    text: str = ""
    links: int = 0  # characters of text inside links
    kids: list[Node] = field(default_factory=list)
    cls: int = 0  # of the subtree, in the comparison at hand


@dataclass(eq=False, slots=True)
class Leaf:
    node: Node
    chrome: bool  # inside chrome
    main: bool  # inside an article or main element


@dataclass(eq=False, slots=True)
class Page:
    root: Node
    order: list[Node]  # children before parents
    leaves: list[Leaf]  # the texts, in page order
    texts: set[str]


def _names_chrome(value: str) -> bool:
    """Whether one of the names in a class or id attribute is made up of chrome words."""
    for name in value.split():
        words = [w.lower() for w in _WORD.findall(name)]
        if any(w in CHROME_WORDS for w in words) and all(w in CHROME_WORDS or w in PLAIN_WORDS for w in words):
            return True
    return False


@lru_cache(4096)
def _chrome(tag: str, attributes: str, inside_article: bool) -> tuple[bool, bool]:
    """Whether an element is page chrome; whether it is the main part of the page."""
    values = {}
    if attributes and "=" in attributes or "hidden" in attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            values.setdefault(m[1].lower(), next((x for x in m.groups()[1:] if x is not None), ""))
    if tag in ("html", "body"):
        return False, False
    role = values.get("role", "").lower()
    marked = _names_chrome(values.get("class", "")) or _names_chrome(values.get("id", "")) or "comment" in values.get("itemprop", "").lower()
    main = (tag in ("article", "main") or role in ("main", "article")) and not marked
    hidden = "hidden" in values and values["hidden"] != "false" or values.get("aria-hidden") == "true" or "display:none" in values.get("style", "").replace(" ", "").lower()
    header = tag == "header" and not inside_article
    return hidden or not main and (tag in CHROME or header or role in CHROME_ROLES or marked), main


def parse(page: str) -> Page:
    """The tree of block elements; runs of inline content are leaves with their text."""
    root = Node("#root")
    stack, opened = [root], Counter()
    words: list[str] = []
    linked, in_link, at, mains = 0, False, 0, 0

    def flush() -> None:
        nonlocal linked
        if words:
            text = " ".join("".join(words).split())
            if text:
                stack[-1].kids.append(Node("#text", text=text, links=linked))
            words.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        piece = entities.unescape(piece) if "&" in piece else piece
        words.append(piece)
        if in_link:
            linked += len(piece.strip())

    def close(depth: int) -> None:
        nonlocal mains
        while len(stack) > depth:
            node = stack.pop()
            opened[node.tag] -= 1
            mains -= node.main

    while m := _TAG.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if not (name := m[2] or m[5]):
            continue
        tag, closing = name.lower(), bool(m[1] or m[4])
        if tag in RAW:
            if not closing and not (m[3] or "").endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag == "a":
            in_link = not closing
            continue
        if tag == "br":
            add(" ")
            continue
        if tag not in BLOCK:
            continue
        flush()
        if closing:
            if opened[tag]:
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                close(i)
                in_link = False
            continue
        if stack[-1].tag == "p" or tag in ("article", "main", "section", "footer", "nav") and opened["p"]:
            i = len(stack) - 1
            while stack[i].tag != "p":
                i -= 1
            close(i)
        if (closes := CLOSED_BY.get(tag)) and any(opened[c] for c in closes):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in closes:
                    close(i)
                    break
                if stack[i].tag in SCOPES:
                    break
        if tag in VOID:
            continue
        node = Node(tag, *_chrome(tag, m[3] or m[6] or "", mains > 0))
        stack[-1].kids.append(node)
        stack.append(node)
        opened[tag] += 1
        mains += node.main
        in_link = False
    add(page[at:])
    flush()
    return _sealed(root)


def _sealed(root: Node) -> Page:
    order: list[Node] = []
    leaves: list[Leaf] = []
    todo = [(root, False, False)]
    while todo:
        node, chrome, main = todo.pop()
        order.append(node)
        chrome, main = chrome or node.chrome, main or node.main
        if node.text:
            leaves.append(Leaf(node, chrome, main))
        todo += [(k, chrome, main) for k in reversed(node.kids)]
    order.reverse()
    return Page(root, order, leaves, {x.node.text for x in leaves})


class Matching:
    """Simple tree matching of two pages.

    Subtrees are classes: trees that differ only in texts of one page fall together, so that the many paragraphs or
    entries of a page are few classes, and sizes are computed once for a pair of classes.
    """

    def __init__(self, a: Page, b: Page) -> None:
        self.tag: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.full: list[int] = []  # nodes of the class and shared texts in it: its matching with itself
        self.shape: list[int] = []  # the class without its texts
        self.texts: list[frozenset[int]] = []  # classes of shared leaves in it
        self.memo: dict[tuple[int, int], int] = {}
        self._known: dict[tuple, int] = {}
        shared, known = a.texts & b.texts, self._known
        for page in (a, b):
            for node in page.order:
                key = (node.tag, node.text if node.text in shared else "", tuple([k.cls for k in node.kids]) if node.kids else ())
                found = known.get(key)
                node.cls = self._class(*key) if found is None else found

    def _class(self, tag: str, text: str, kids: tuple[int, ...]) -> int:
        key = (tag, text, kids)
        found = self._known.get(key)
        if found is not None:
            return found
        plain = not text and all(self.shape[k] == k for k in kids)
        shape = -1 if plain else self._class(tag, "", tuple([self.shape[k] for k in kids]))
        found = self._known[key] = len(self.tag)
        self.tag.append(tag)
        self.kids.append(kids)
        self.full.append(1 + bool(text) + sum(self.full[k] for k in kids))
        self.shape.append(found if plain else shape)
        self.texts.append(frozenset((found,)) if text else frozenset().union(*(self.texts[k] for k in set(kids))) if kids else frozenset())
        return found

    def _key(self, x: int, y: int) -> tuple[int, int]:
        """Without a common text the texts do not matter."""
        return (x, y) if not self.texts[x].isdisjoint(self.texts[y]) else (self.shape[x], self.shape[y])

    def size(self, x: int, y: int) -> int:
        """The most nodes, and equal texts, of an order-preserving top-down matching of two classes."""
        todo = [self._key(x, y)]
        while todo:
            x, y = todo[-1]
            if (x, y) in self.memo:
                todo.pop()
            elif self.tag[x] != self.tag[y]:
                self.memo[x, y] = 0
            elif x == y:
                self.memo[x, y] = self.full[x]
            elif not self.kids[x] or not self.kids[y]:
                self.memo[x, y] = 1
            else:
                lo, p, q, hi = self._trimmed(self.kids[x], self.kids[y])
                wanted = {self._key(i, j) for i in set(p) for j in set(q)} if p and q else set()
                missing = [k for k in wanted if k not in self.memo]
                if missing:
                    todo += missing
                else:
                    ends = sum(self.full[k] for k in self.kids[x][:lo]) + sum(self.full[k] for k in self.kids[x][len(self.kids[x]) - hi :])
                    self.memo[x, y] = 1 + ends + (self._best(p, q) if p and q else 0)
        return self.memo[self._key(x, y)]

    @staticmethod
    def _trimmed(p: tuple[int, ...], q: tuple[int, ...]) -> tuple[int, tuple, tuple, int]:
        """Equal ends are matched in some best matching."""
        n, lo, hi = min(len(p), len(q)), 0, 0
        while lo < n and p[lo] == q[lo]:
            lo += 1
        while hi < n - lo and p[-1 - hi] == q[-1 - hi]:
            hi += 1
        return lo, p[lo : len(p) - hi], q[lo : len(q) - hi], hi

    def _rows(self, p: tuple[int, ...], q: tuple[int, ...]) -> Callable[[int], np.ndarray]:
        """The sizes of p[i] with every q."""
        kinds = {k: i for i, k in enumerate(dict.fromkeys(q))}
        place = np.array([kinds[k] for k in q])
        rows: dict[int, np.ndarray] = {}

        def row(i: int) -> np.ndarray:
            found = rows.get(p[i])
            if found is None:
                found = np.array([self.size(p[i], k) for k in kinds], np.int64)
                if len(rows) * len(kinds) < 1 << 20:
                    rows[p[i]] = found
            return found[place]

        return row

    def _best(self, p: tuple[int, ...], q: tuple[int, ...]) -> int:
        if len(p) * len(q) <= FEW:
            return self._sums(p, q)[-1][-1]
        row, best = self._rows(p, q), np.zeros(len(q) + 1, np.int64)
        for i in range(len(p)):
            best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + row(i)))
        return int(best[-1])

    def _sums(self, p: tuple[int, ...], q: tuple[int, ...]) -> list[list[int]]:
        """For short lists, the sums of all their beginnings."""
        sums, sizes = [[0] * (len(q) + 1)], {}
        for x in p:
            above, own = sums[-1], [0]
            for j, y in enumerate(q):
                w = sizes.get((x, y))
                if w is None:
                    w = sizes[x, y] = self.size(x, y)
                own.append(max(above[j + 1], own[j], above[j] + w))
            sums.append(own)
        return sums

    def _pairs(self, p: tuple[int, ...], q: tuple[int, ...]) -> list[tuple[int, int]]:
        """The pairs of a best matching of two lists; of long ones only every root-th row of sums is kept, the others
        are made again."""
        if len(p) * len(q) <= FEW:
            return self._back(self._sums(p, q), 0, len(q), [])[1][::-1]
        row, step = self._rows(p, q), max(1, int(len(p) ** 0.5))
        kept, best = [], np.zeros(len(q) + 1, np.int64)
        for i in range(len(p)):
            if i % step == 0:
                kept.append(best.copy())
            best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + row(i)))
        out, j = [], len(q)
        for block in range(len(kept) - 1, -1, -1):
            lo, hi = block * step, min(len(p), (block + 1) * step)
            sums = [kept[block]]
            for i in range(lo, hi):
                following = sums[-1].copy()
                following[1:] = np.maximum.accumulate(np.maximum(following[1:], following[:-1] + row(i)))
                sums.append(following)
            j, out = self._back(sums, lo, j, out)
        return out[::-1]

    @staticmethod
    def _back(sums: list, lo: int, j: int, out: list[tuple[int, int]]) -> tuple[int, list[tuple[int, int]]]:
        """Follows the sums of rows lo and after back to their beginning, from column j."""
        i = len(sums) - 1
        while i and j:
            if sums[i][j] == sums[i - 1][j]:
                i -= 1
            elif sums[i][j] == sums[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((lo + i, j))
        return j, out

    def leaves(self, a: Node, b: Node) -> Iterator[tuple[Node, Node]]:
        """The pairs of texts in a best matching of two trees."""
        todo = [(a, b)] if a.tag == b.tag else []
        while todo:
            a, b = todo.pop()
            if a.text and b.text:
                yield a, b
                continue
            x, y = a.kids, b.kids
            lo, p, q, hi = self._trimmed(self.kids[a.cls], self.kids[b.cls])
            todo += zip(x[:lo], y[:lo], strict=True)
            todo += zip(x[len(x) - hi :], y[len(y) - hi :], strict=True)
            # a child whose tag is unique in both lists has one partner; at an end, it takes nothing from the others
            x, y = x[lo : len(x) - hi], y[lo : len(y) - hi]
            once = {t for t, n in Counter([k.tag for k in x]).items() if n == 1} & {t for t, n in Counter([k.tag for k in y]).items() if n == 1} if x and y else ()
            lo, hi = 0, 0
            while lo < min(len(x), len(y)) and x[lo].tag == y[lo].tag and x[lo].tag in once:
                todo.append((x[lo], y[lo]))
                lo += 1
            while hi < min(len(x), len(y)) - lo and x[-1 - hi].tag == y[-1 - hi].tag and x[-1 - hi].tag in once:
                todo.append((x[-1 - hi], y[-1 - hi]))
                hi += 1
            if lo + hi < min(len(x), len(y)):
                todo += [(x[lo + i], y[lo + j]) for i, j in self._pairs(p[lo : len(p) - hi], q[lo : len(q) - hi])]


def align(a: Page, b: Page) -> list[tuple[int, int]]:
    """The pairs of leaves (by number) matched by simple tree matching."""
    of_a, of_b = ({id(x.node): i for i, x in enumerate(page.leaves)} for page in (a, b))
    return [(of_a[id(p)], of_b[id(q)]) for p, q in Matching(a, b).leaves(a.root, b.root)]


def compare(exemplar: Page, page: Page) -> tuple[bytes, bytes, list[tuple[int, int]]]:
    """Bit sets over the exemplar's leaves (matched; equal) as far as they are evidence, and the pairs of equal leaves."""
    if [x.node.text for x in exemplar.leaves] == [x.node.text for x in page.leaves]:  # the exemplar, or a copy of it
        none = np.packbits(np.zeros(len(exemplar.leaves), bool)).tobytes()
        return none, none, [(i, i) for i in range(len(page.leaves))]
    pairs = align(exemplar, page)
    equal = [(i, j) for i, j in pairs if exemplar.leaves[i].node.text == page.leaves[j].node.text]
    mains = [[len(x.node.text) for x in p.leaves if x.main and not x.chrome] for p in (exemplar, page)]
    common = [len(page.leaves[j].node.text) for _, j in equal if page.leaves[j].main and not page.leaves[j].chrome]
    copies = sum(common) > COPIES * min(map(sum, mains)) and len(common) > COPIES * min(map(len, mains))
    bits = np.zeros((2, len(exemplar.leaves)), bool)
    for k, of in enumerate((pairs, equal)):
        for i, _ in of:
            bits[k, i] = not (copies and exemplar.leaves[i].main)
    return np.packbits(bits[0]).tobytes(), np.packbits(bits[1]).tobytes(), equal


#: Number of a leaf of exemplar e: (e << 32) + its place.
_E = 32
_LEAF = "struct<text: string, main: boolean, linked: boolean, refs: array<bigint>>"
_PARSED = f"page_id long, url string, host string, own long, leaves array<{_LEAF}>, seen array<binary>, same array<binary>"
_BLOCKS = pa.list_(pa.struct([("text", pa.string()), ("main", pa.bool_()), ("linked", pa.bool_()), ("refs", pa.list_(pa.int64()))]))


def examine(page: Page, exemplars: list[Page]) -> tuple[list[dict], list[bytes], list[bytes]]:
    """The leaves outside chrome, with the exemplars' leaves that they equal; and the bit sets."""
    refs: dict[int, list[int]] = {}
    seen, same = [], []
    for e, exemplar in enumerate(exemplars):
        a, b, equal = compare(exemplar, page)
        seen.append(a)
        same.append(b)
        for i, j in equal:
            refs.setdefault(j, []).append((e << _E) + i)
    found = [{"text": x.node.text, "main": x.main, "linked": 2 * x.node.links > len(x.node.text), "refs": refs.get(j, [])} for j, x in enumerate(page.leaves) if not x.chrome]
    return found, seen, same


class _Exemplars:
    """The parsed exemplars of the hosts met last."""

    def __init__(self, markup: Callable[[str], list[str]]) -> None:
        self.markup, self.held = markup, OrderedDict()

    def of(self, host: str) -> list[Page]:
        if host not in self.held:
            if len(self.held) >= HOSTS:
                self.held.popitem(last=False)
            self.held[host] = [parse(x) for x in self.markup(host)]
        self.held.move_to_end(host)
        return self.held[host]


def _examined(known: Callable[[], dict[str, list[str]]] | None):
    """Rows (host, kind, own, page_id, url, html); without known exemplars, those of a host come first, as kind 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = known() if known else {}
        exemplars = _Exemplars(lambda host: given.get(host, []))
        last = None
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for r in range(len(batch)):
                host, kind, own, page_id, url, markup = (c[r].as_py() for c in batch.columns)
                if known is None and host != last:
                    given.clear()
                    exemplars.held.clear()
                    last = host
                if kind == 0:
                    if markup not in given.setdefault(host, []):
                        given[host].append(markup)
                    continue
                leaves, seen, same = examine(parse(markup or ""), exemplars.of(host))
                rows.append((page_id, url, host, own, leaves, seen, same))
                size += len(markup or "")
                if size > 1 << 22:
                    yield _batch(rows)
                    rows, size = [], 0
            yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.string(), pa.int64(), _BLOCKS, pa.list_(pa.binary()), pa.list_(pa.binary()))
    names = ["page_id", "url", "host", "own", "leaves", "seen", "same"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, ref, seen, same) summed over the pages of a task, some hosts at a time."""
    sums: dict[str, list[np.ndarray]] = {}

    def out() -> pa.RecordBatch:
        columns: list[list] = [[], [], [], []]
        for host, of in sums.items():
            for e, (a, b) in enumerate(of):
                for i in np.flatnonzero(a):
                    for c, v in zip(columns, (host, (e << _E) + int(i), int(a[i]), int(b[i])), strict=True):
                        c.append(v)
        sums.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["host", "ref", "seen", "same"])

    held = 0
    for batch in batches:
        for r in range(len(batch)):
            host, seen, same = (c[r].as_py() for c in batch.columns)
            pair = [[np.unpackbits(np.frombuffer(x, np.uint8)).astype(np.int64) for x in y] for y in zip(seen, same, strict=True)]
            if host in sums:
                for (a, b), (x, y) in zip(sums[host], pair, strict=True):
                    a += x
                    b += y
            else:
                sums[host] = pair
                held += sum(len(x) for x, _ in pair)
            if held > 1 << 20:
                yield out()
                held = 0
    yield out()


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1))


def _dealt(pages: DataFrame, broadcast: int) -> tuple[DataFrame, Callable[[], dict[str, list[str]]] | None]:
    """Rows for _examined, and the exemplars where they are broadcast."""
    spark = pages.sparkSession
    own = F.xxhash64("html")
    keyed = pages.select(_host(F.col("url")).alias("host"), F.lit(1).alias("kind"), F.when(F.length("html") > 0, own).alias("own"), F.col("page_id").cast("long").alias("page_id"), "url", "html")
    other = F.xxhash64("own", F.lit(1))
    picks = keyed.where("own is not null").groupBy("host").agg(F.count("*").alias("n"), F.min("own").alias("a"), F.max("own").alias("b"), F.min(F.struct(other, "own"))["own"].alias("c"))
    picks = stored(picks.select("host", "n", F.explode(F.array_distinct(F.array("a", "b", "c"))).alias("own")), "picks")
    chosen = picks.select(F.col("host").alias("h"), F.col("own").alias("o"))
    chosen = F.broadcast(chosen) if chosen.count() <= 100_000 else chosen
    found = keyed.join(chosen, (F.col("host") == F.col("h")) & (F.col("own") == F.col("o")), "left_semi")
    # copies of an exemplar are one row after the partial aggregate
    found = stored(found.groupBy("host", "own").agg(F.min("html").alias("html")), "exemplars")
    size = found.agg(F.coalesce(F.sum(F.octet_length("html")), F.lit(0)).alias("n")).first()["n"]
    if size <= broadcast:
        by_host: dict[str, list[str]] = {}
        for r in found.orderBy("host", "own").toLocalIterator():
            by_host.setdefault(r["host"], []).append(r["html"])
        shared = spark.sparkContext.broadcast(by_host)
        return keyed, lambda: shared.value
    total = picks.agg(F.count("*").alias("n")).first()["n"]
    parts = picks.groupBy("host").agg(F.max("n").alias("n")).select(F.col("host").alias("h"), F.ceil(F.col("n") / F.greatest(F.lit(1000), F.lit(total // 1000))).cast("int").alias("parts")).where("parts > 1")
    parts = F.broadcast(parts) if parts.count() <= 100_000 else parts
    split = keyed.join(parts, F.col("host") == F.col("h"), "left").withColumn("part", F.expr("pmod(xxhash64(page_id, url, own), coalesce(parts, 1))"))
    lead = found.join(parts, F.col("host") == F.col("h"), "left").withColumn("part", F.explode(F.expr("sequence(0L, cast(coalesce(parts, 1) - 1 as bigint))")))
    lead = lead.select("host", "part", F.lit(0).alias("kind"), "own", F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"), "html")
    both = lead.unionByName(split.select("host", F.col("part").cast("long").alias("part"), "kind", "own", "page_id", "url", "html"))
    return both.repartition("host", "part").sortWithinPartitions("host", "part", "kind", "own").select("host", "kind", "own", "page_id", "url", "html"), None


def extract_main_text(pages: DataFrame, broadcast: int = BROADCAST) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages; exemplars beyond broadcast bytes are shuffled."""
    dealt, known = _dealt(pages, broadcast)
    parsed = stored(dealt.mapInArrow(_examined(known), _PARSED), "parsed")
    evidence = parsed.where("own is not null").groupBy("host", "own").agg(F.first("seen").alias("seen"), F.first("same").alias("same"))
    sums = evidence.select("host", "seen", "same").mapInArrow(_summed, "host string, ref long, seen long, same long").groupBy("host", "ref").agg(F.sum("seen").alias("seen"), F.sum("same").alias("same"))
    template = sums.where(f"same >= {SUPPORT} and same >= {SHARE} * seen").groupBy(F.col("host").alias("of")).agg(F.collect_set("ref").alias("template"))
    template = stored(template, "template")
    left = F.filter("leaves", lambda x: ~F.arrays_overlap(x["refs"], F.coalesce("template", F.expr("array(-1L)"))))
    length = lambda kept, f: F.aggregate(kept, F.lit(0), lambda n, x: n + F.when(f(x), F.length(x["text"])).otherwise(0))
    judged = parsed.join(template, F.col("host") == F.col("of"), "left").select("page_id", "url", left.alias("kept"))
    judged = judged.withColumn("inside", length("kept", lambda x: x["main"])).withColumn("total", length("kept", lambda x: F.lit(True)))
    only = (F.col("inside") > 0) & (2 * F.col("inside") >= F.col("total"))
    texts = F.transform(F.filter("kept", lambda x: F.when(only, x["main"]).otherwise(x["main"] | ~x["linked"])), lambda x: x["text"])
    return judged.select("page_id", "url", F.array_join(texts, "\n").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
