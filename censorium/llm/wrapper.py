"""Main text of web pages by wrapper induction.

Pages of a host share a template.  Each page becomes a tree of elements in which runs of
like siblings are one node; per host, one page's tree is the reference, and every page's tree
is aligned with it by simple tree matching (the largest order-preserving match of equal
nodes).  A content that a text slot has on SUPPORT different pages at least, and on more than half
of those with text there, belongs to the template; what else a slot holds is content.  Within the main part or
the body, template goes.  An article says itself what is content, so a sentence that its pages share stays there, unless the names of an
element around it hint at a menu, notice or the like.  Elements that the page itself marks as menu, header, footer,
sidebar, notice, advert, form, script, style or comments are not text; a name marks an element only if all its words say so
(``section-header``, ``side-effects`` and ``has-sidebar`` mark nothing), and in an article neither headings nor anchors.

Spark carries it: one pass over the pages yields trees and slot digests, aggregates by host
give reference and constant slots, and a second pass, with each host's wrapper, extracts.
Evidence is counted over all pages; no page's html is shuffled unless hosts are so many
that their wrappers can't be sent to all executors.
"""

from __future__ import annotations

import html
import json
import math
import re
import sys
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from censorium.llm.common import rows_are_few, saved, table

#: Different pages of a host on which a slot must be the same to be template, and the share of the pages with text in it that they must exceed.
SUPPORT, SHARE = 5, 0.5
#: Hosts whose wrappers are sent to all executors at most, and characters of all their reference trees; more are joined by host.
BROADCAST_HOSTS, BROADCAST_CHARS = 50_000, 64 << 20
#: Nodes of alignments that a Python worker keeps.
CACHED_NODES = 2_000_000

#: Element kinds of HTML (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title head select".split())
OPAQUE = frozenset("script style textarea title iframe noscript".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - frozenset("body html option legend caption td th tr tbody thead tfoot li dd dt summary".split())
IMPLIED = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
SCOPE = frozenset("table ul ol dl td th body html article section div".split())
#: Elements and names that mark what is not main text (fixed values).
ASIDE_TAGS = RAW | frozenset("nav header footer aside form button dialog menu input".split())
#: Words that mark an element wherever it is, and words that also name a part of a layout or a text.
FOREIGN = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored comment comments replies disqus sidebar related recommended recommendations newsletter subscribe cookie cookies consent gdpr popup breadcrumb breadcrumbs pagination pager navbar navigation".split())
LAYOUT = frozenset("nav menu side header footer masthead banner notice alert modal overlay subscription signup login promo promotion share sharing social search skip".split())
#: Words that say where or how large, which a marking name may have beside its marking words.
BESIDE = frozenset("site page main top bottom left right primary secondary global inner outer wrapper wrap container box bar block area list links link buttons button icons widget unit slot form message text".split())
#: With these a name may also have: section, posts, articles, stories, thread, user, reader, content.
BESIDE_FOREIGN = BESIDE | frozenset("section posts articles stories thread user reader content".split())
HINT = re.compile(rf"(?:^|[\s_-])(?:{'|'.join(sorted(FOREIGN | LAYOUT))})(?:$|[\s_-])", re.IGNORECASE)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.DOTALL)
#: A tag up to the next >, for pages with unclosed quotes.
LOOSE = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.DOTALL)
LETTERS = frozenset("/abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"\s+")


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    #: Text runs and nodes, in order.
    inside: list[str | Node] = field(default_factory=list)

    @property
    def key(self) -> str:
        """What aligns: the tag and how the page names the element."""
        names = " ".join(sorted(self.attrs.get("class", "").split()))
        return f"{self.tag}.{names}" if names else self.tag

    def is_aside(self, in_article: bool = False) -> bool:
        if self.tag in ASIDE_TAGS or not self.attrs:
            return self.tag in ASIDE_TAGS
        a = self.attrs
        if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "") in ASIDE_ROLES or re.search(r"display\s*:\s*none", a.get("style", "")):
            return True
        return self.marked(in_article) is not None

    def marked(self, in_article: bool = False) -> str | None:
        """"foreign" or "layout" if a name in class or id marks the element; in an article headings aren't marked, and an id only by foreign words."""
        if self.tag in ("body", "html", "article", "main") or in_article and self.tag in HEADINGS:
            return None
        found = None
        for kind in ("class", "id"):
            for name in self.attrs.get(kind, "").lower().split():
                words = set(re.split("[_-]+", name.strip("_-")))
                if words & FOREIGN and words <= FOREIGN | LAYOUT | BESIDE_FOREIGN:
                    return "foreign"
                if words & LAYOUT and words <= LAYOUT | BESIDE and not (in_article and kind == "id"):
                    found = "layout"
        return found

    def hints(self) -> bool:
        """Whether a name has a marking word at all."""
        return self.tag not in HEADINGS and bool(HINT.search(f"{self.attrs.get('class', '')} {self.attrs.get('id', '')}"))


def parse(text: str) -> Node:
    """A tolerant tree: implied and missing end tags, stray end tags, unfinished tags and pages.  Its time is linear in the page."""
    root = Node("#root")
    stack, at, n = [root], 0, len(text)
    opened: Counter[str] = Counter()
    tag_of, found = TAG, 0
    while at < n:
        # found: the next < that may begin something; between at and it lies text
        found = text.find("<", max(at, found))
        if found < 0 or found + 1 >= n:
            stack[-1].inside.append(html.unescape(text[at:]))
            break
        if text[found + 1] not in LETTERS and text[found + 1] not in "!?":
            found += 1
            continue
        m = tag_of.match(text, found)
        if m is None and tag_of is TAG and text[found + 1] in LETTERS:
            # an unclosed quote, or no > any more: from here on tags end at the next >
            tag_of = LOOSE
            m = tag_of.match(text, found)
        if m is None:
            if text.find(">", found) < 0:
                stack[-1].inside.append(html.unescape(text[at:]))
                break
            found += 1
            continue
        if found > at:
            stack[-1].inside.append(html.unescape(text[at:found]))
        at = found = m.end()
        if m[1] is not None:
            stack[-1].inside.append(m[1])
        if m[3] is None:
            continue
        tag = m[3].lower()
        if m[2]:
            if opened[tag]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        _pop(stack, opened, i)
                        break
            continue
        if tag in CLOSES_P and opened["p"]:
            _close(stack, opened, _PARAGRAPH)
        if tag in IMPLIED and any(opened[t] for t in IMPLIED[tag]):
            _close(stack, opened, IMPLIED[tag])
        node = Node(tag, _attributes(m[4]) if m[4] and m[4] != "/" else {})
        stack[-1].inside.append(node)
        if tag in OPAQUE:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(text, at)
            at = found = end.end() if end else n
        elif tag not in VOID and not m[4].endswith("/") or tag in BLOCKS and tag not in VOID:
            stack.append(node)
            opened[tag] += 1
    return root


_PARAGRAPH = frozenset(["p"])


def _pop(stack: list[Node], opened: Counter[str], i: int) -> None:
    for node in stack[i:]:
        opened[node.tag] -= 1
    del stack[i:]


def _close(stack: list[Node], opened: Counter[str], tags: frozenset[str]) -> None:
    """End an open element of these tags, if none of the elements around it begins a new scope."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            _pop(stack, opened, i)
            return
        if stack[i].tag in SCOPE:
            return


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)}


@dataclass
class Slots:
    """A collapsed tree; each node has at most one text slot, and knows the nodes it stands for."""

    key: str
    children: list[Slots] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)

    def shape(self) -> list:
        """(depth, key, whether it has text) of the nodes in order."""
        out, work = [], [(self, 0)]
        while work:
            node, depth = work.pop()
            out.append([depth, node.key, bool(node.texts)])
            work += [(c, depth + 1) for c in reversed(node.children)]
        return out


def collapse(nodes: list[Node], slots: dict[int, Slots]) -> Slots:
    """Runs of siblings with equal keys as one node; ``slots`` says by id() where each node went."""
    whole = Slots(nodes[0].key)
    work = [(nodes, whole)]
    while work:
        run, out = work.pop()
        children: list[list[Node]] = []
        for node in run:
            slots[id(node)] = out
            for x in node.inside:
                if isinstance(x, str):
                    if not x.isspace():
                        out.texts.append(x)
                elif x.tag not in RAW and x.tag not in ("br", "wbr"):
                    if children and children[-1][0].key == x.key:
                        children[-1].append(x)
                    else:
                        children.append([x])
        out.children = [Slots(r[0].key) for r in children]
        work += zip(children, out.children, strict=True)
    return whole


def in_order(tree: Slots) -> list[Slots]:
    out, work = [], [tree]
    while work:
        node = work.pop()
        out.append(node)
        work += reversed(node.children)
    return out


def _deep() -> None:
    """Room for trees of any depth: calls between Python functions don't use the C stack."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000_000))


def slot_texts(nodes: list[Slots]) -> list[str]:
    return ["\n".join(SPACE.sub(" ", t).strip() for t in s.texts) for s in nodes]


def _digest(text: str) -> int | None:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63) if text else None


class Matcher:
    """Simple tree matching of two trees; equal subtrees share a number, so each pair of different ones is matched once."""

    def __init__(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.keys: list[str] = []
        self.children: list[tuple[int, ...]] = []
        self.sizes: list[int] = []
        self.weights: dict[tuple[int, int], int] = {}

    def number(self, shape: list) -> int:
        """The number of a tree, given as (depth, key, ...) of its nodes in order, or nested as (key, ..., children)."""
        if isinstance(shape[0], str):
            shape, work = [], [(0, shape)]
            while work:
                depth, node = work.pop()
                shape.append((depth, node[0]))
                work += [(depth + 1, c) for c in reversed(node[2])]
        waiting: dict[int, list[int]] = {}
        for depth, key, *_ in reversed(shape):
            inside = tuple(reversed(waiting.pop(depth + 1, [])))
            found = self.numbers.setdefault((key, inside), len(self.keys))
            if found == len(self.keys):
                self.keys.append(key)
                self.children.append(inside)
                self.sizes.append(1 + sum(self.sizes[c] for c in inside))
            waiting.setdefault(depth, []).append(found)
        return waiting[0][0]

    def weight(self, a: int, b: int) -> int:
        """Size of the largest match of two subtrees."""
        if a == b:
            return self.sizes[a]
        if self.keys[a] != self.keys[b]:
            return 0
        if (a, b) not in self.weights:
            x, y, head, tail = self._trimmed(a, b)
            ends = sum(self.sizes[c] for c in (*self.children[a][:head], *self.children[a][len(self.children[a]) - tail :]))
            last = np.zeros(len(y) + 1, dtype=np.int32)
            for last in self._rows(x, last, self._against(x, y)):  # noqa: B007
                pass
            self.weights[a, b] = 1 + ends + int(last[-1])
        return self.weights[a, b]

    def _trimmed(self, a: int, b: int) -> tuple[tuple[int, ...], tuple[int, ...], int, int]:
        """The children without those equal at both ends: nothing matches a subtree better than its like."""
        x, y = self.children[a], self.children[b]
        n, head, tail = min(len(x), len(y)), 0, 0
        while head < n and x[head] == y[head]:
            head += 1
        while tail < n - head and x[-1 - tail] == y[-1 - tail]:
            tail += 1
        return x[head : len(x) - tail], y[head : len(y) - tail], head, tail

    def _against(self, x: tuple[int, ...], y: tuple[int, ...]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For each of x with like nodes in y: their places and weights."""
        places: dict[str, list[int]] = {}
        for i, c in enumerate(y):
            places.setdefault(self.keys[c], []).append(i)
        out = {}
        for c in set(x):
            at = places.get(self.keys[c], [])
            if at:
                out[c] = np.array(at), np.array([self.weight(c, y[i]) for i in at], dtype=np.int32)
        return out

    def _rows(self, x: tuple[int, ...], row: np.ndarray, against: dict) -> Iterator[np.ndarray]:
        """After each of x: the best sums of weights with the first 0, 1, ... of y; ``row`` is the one before."""
        for c in x:
            if c in against:
                at, weights = against[c]
                new = row.copy()
                new[at + 1] = np.maximum(new[at + 1], row[at] + weights)
                row = np.maximum.accumulate(new)
            yield row

    def pairs(self, a: int, b: int) -> Iterator[tuple[int, int]]:
        """Which children of two different matched subtrees pair up, by their places."""
        x, y, head, tail = self._trimmed(a, b)
        yield from ((i, i) for i in range(head))
        m, n = len(self.children[a]), len(self.children[b])
        yield from ((m - 1 - i, n - 1 - i) for i in range(tail))
        # each step-th row stays, those between are made again: memory of the root of the table
        step, against = 1 + math.isqrt(len(x)), self._against(x, y)
        first = np.zeros(len(y) + 1, dtype=np.int32)
        kept = [first] + [r for i, r in enumerate(self._rows(x, first, against), 1) if i % step == 0]
        q = len(y)
        for part in range(len(kept) - 1, -1, -1):
            rows = [kept[part], *self._rows(x[part * step : (part + 1) * step], kept[part], against)]
            for p in range(len(rows) - 1, 0, -1):
                if not q or rows[p][q] == rows[p - 1][q]:
                    continue
                q = int(np.searchsorted(rows[p][: q + 1], rows[p][q]))
                yield head + part * step + p - 1, head + q - 1
                q -= 1

    def mark(self, out: list[int], a: int, b: int, i: int, j: int) -> None:
        """The match of two subtrees whose first nodes are i and j."""
        if a == b:
            out[j : j + self.sizes[b]] = range(i, i + self.sizes[a])
            return
        out[j] = i
        x, y = ([*accumulate((self.sizes[c] for c in self.children[t]), initial=at + 1)] for t, at in ((a, i), (b, j)))
        for p, q in self.pairs(a, b):
            c, d = self.children[a][p], self.children[b][q]
            self.mark(out, c, d, x[p], y[q])


_aligned: dict[int, np.ndarray] = {}
_held = [0]


def aligned(reference: str, page: str) -> np.ndarray:
    """Simple tree matching of two trees in JSON: for each node of the page, in order, the reference's node or -1.

    Trees of any size: equal subtrees are matched once, and children row by row in arrays, so the work
    is at most that of the pairs of nodes with equal keys, without those in equal ends of two lists of children.
    """
    name = xxhash.xxh3_128_intdigest(f"{reference}\0{page}")
    if name not in _aligned:
        _deep()
        matcher = Matcher()
        a, b = matcher.number(json.loads(reference)), matcher.number(json.loads(page))
        out = [-1] * matcher.sizes[b]
        if matcher.weight(a, b):
            matcher.mark(out, a, b, 0, 0)
        if _held[0] > CACHED_NODES:
            _aligned.clear()
            _held[0] = 0
        _aligned[name] = np.array(out, dtype=np.int32)
        _held[0] += len(out)
    return _aligned[name]


def blocks_of(root: Node, keep: set[int] | None, slots: dict[int, Slots], order: dict[int, int]) -> list[str]:
    """Texts of the blocks of the main part, in page order; ``keep``: slots that aren't template, None: all.

    In an article, template goes only from elements whose names, or those of an element around them there, hint at it.
    """
    _deep()
    tops = _main_parts(root)
    in_article = tops[0].tag == "article"
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = SPACE.sub(" ", "".join(run)).strip()
        if text:
            out.append(text)
        run.clear()

    def walk(node: Node, cut: bool) -> None:
        block = node.tag in BLOCKS
        if block:
            flush()
        cut = cut or node.hints()
        wanted = keep is None or not cut or order[id(slots[id(node)])] in keep
        for x in node.inside:
            if isinstance(x, str):
                if wanted:
                    run.append(x)
                elif x.isspace():
                    run.append(" ")
            elif x.tag == "br" or x.tag == "wbr":
                run.append(" " if x.tag == "br" else "")
            elif x.tag in RAW:
                continue
            elif x.is_aside(in_article):
                if x.tag == "header" and node.tag in ("article", "main", "section"):
                    walk_headings(x, cut)
                elif x.tag in BLOCKS:
                    flush()
            else:
                walk(x, cut)
        if block:
            flush()

    def walk_headings(node: Node, cut: bool) -> None:
        for x in node.inside:
            if isinstance(x, Node):
                walk(x, cut) if x.tag in HEADINGS else walk_headings(x, cut)

    for top in tops:
        flush()
        walk(top, not in_article)
        flush()
    return out


def _main_parts(root: Node) -> list[Node]:
    """Outermost articles, or else main parts, or else the body, or else the whole page.

    Articles and main parts are sought outside of marked elements, and, where there is neither, also in
    those that only a layout word marks, as ``search-page`` around a whole page.
    """
    for layout in (False, True):
        for wanted in (lambda x: x.tag == "article", lambda x: x.tag == "main" or x.attrs.get("role") == "main"):
            if found := _outermost(root, wanted, layout):
                return found
    return _outermost(root, lambda x: x.tag == "body", False) or [root]


def _outermost(root: Node, wanted: Callable[[Node], bool], layout: bool) -> list[Node]:
    found: list[Node] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if wanted(node):
            found.append(node)
            continue
        stack += [x for x in reversed(node.inside) if isinstance(x, Node) and (x.tag in ("body", "html") or not x.is_aside() or layout and x.tag not in ASIDE_TAGS and x.marked() == "layout")]
    return found


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def page_trees(pages: DataFrame) -> DataFrame:
    """``(host, shape, page, slots)`` of each page: its tree in JSON, a digest of its main part's text, and digests of its slots in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes, digests, whole = [], [], []
            for text in batch.column(1).to_pylist():
                root, at = parse(text or ""), {}
                tree = collapse([root], at)
                texts = slot_texts(in_order(tree))
                shapes.append(json.dumps(tree.shape(), separators=(",", ":")))
                digests.append([_digest(t) for t in texts])
                whole.append(xxhash.xxh3_64_intdigest("\0".join(blocks_of(root, None, at, {}))) - (1 << 63))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shapes, pa.string()), pa.array(whole, pa.int64()), pa.array(digests, pa.list_(pa.int64()))], names=["host", "shape", "page", "slots"])

    return pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, shape string, page long, slots array<long>")


def _can_be_sent(found: DataFrame) -> bool:
    return rows_are_few(found, BROADCAST_HOSTS) and (found.agg(F.sum(F.length("reference"))).first()[0] or 0) <= BROADCAST_CHARS


def wrappers(pages: DataFrame, *, support: int = SUPPORT) -> DataFrame:
    """``(host, reference, template)``: the reference tree, and nodes of it with the digest of their template text.

    A digest is template if ``support`` different pages have it in that node, and more than SHARE of
    the pages with text there; one page with another text changes nothing on the others.
    The reference is, of the host's trees, the one most pages have.  Only pages that differ in
    the text of their main part count, for trees and texts, each once, so copies are no evidence, whatever
    menus or adverts surround them.  Hosts without enough pages have an empty template.
    """
    trees = saved(page_trees(pages), "trees")
    different = trees.groupBy("host", "page").agg(F.min(F.struct("shape", "slots")).alias("x")).select("host", "x.*")
    shapes = different.groupBy("host", "shape").agg(F.count("*").alias("n"))
    references = shapes.groupBy("host").agg(F.max(F.struct("n", "shape")).alias("r")).select("host", F.col("r.shape").alias("reference"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for host, reference, shape, slots in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = aligned(reference, shape).tolist()
                rows += [(host, node, digest) for node, digest in zip(at, slots, strict=True) if node >= 0 and digest is not None]
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64()), strict=True)], names=["host", "node", "digest"])

    references = saved(references, "references")
    few = _can_be_sent(references)
    joined = different.join(F.broadcast(references) if few else references, "host").select("host", "reference", "shape", "slots")
    counts = joined.mapInArrow(align, "host string, node int, digest long").groupBy("host", "node", "digest").agg(F.count("*").alias("n"))
    slots = counts.groupBy("host", "node").agg(F.sum("n").alias("pages"), F.max(F.struct("n", "digest")).alias("top"))
    constant = slots.where((F.col("top.n") >= support) & (F.col("top.n") > SHARE * F.col("pages")))
    template = constant.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("node", "top.digest"))).alias("template"))
    return saved(references.join(template, "host", "left").select("host", "reference", F.coalesce("template", F.array().cast("array<struct<node:int,digest:long>>")).alias("template")), "wrappers")


def extract(pages: DataFrame, found: DataFrame) -> DataFrame:
    """``(page_id, url, text)`` by the wrappers of ``wrappers``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, reference, template in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                root, slots = parse(page or ""), {}
                tree = collapse([root], slots)
                nodes = in_order(tree)
                numbered = {id(s): i for i, s in enumerate(nodes)}
                keep = None
                if reference and template:
                    shape = json.dumps(tree.shape(), separators=(",", ":"))
                    at = aligned(reference, shape).tolist()
                    constant = {x["node"]: x["digest"] for x in template}
                    keep = {i for i, t in enumerate(slot_texts(nodes)) if at[i] not in constant or _digest(t) != constant[at[i]]}
                texts.append("\n\n".join(blocks_of(root, keep, slots, numbered)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    few = _can_be_sent(found)
    rows = pages.select("page_id", "url", "html").withColumn("host", host_of(F.col("url"))).join(F.broadcast(found) if few else found, "host", "left")
    return rows.select("page_id", "url", "html", "reference", "template").mapInArrow(run, "page_id long, url string, text string")


def main_text(pages: DataFrame, *, support: int = SUPPORT) -> DataFrame:
    """``(page_id, url, text)`` for each row of ``pages(page_id, url, html)``.

    Null or empty html gives an empty text, a null url counts to a host of its own, repeated rows
    stay; other columns are ignored; an empty table gives no rows.
    """
    return extract(pages, wrappers(pages, support=support))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of all pages."""
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
